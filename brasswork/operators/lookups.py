"""Joins with short dimension lists, set operations between frames, and audits of published numbers."""

from __future__ import annotations

import datetime
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brasswork.functions.numbers import ratio

#: Lists longer than this are refused rather than broadcast.
MAX_LIST = 10_000


def _short(frame: DataFrame, rows: Sequence[tuple], schema: str) -> DataFrame:
    if len(rows) > MAX_LIST:
        raise ValueError(f"at most {MAX_LIST} rows")
    return F.broadcast(frame.sparkSession.createDataFrame(list(rows), schema))


def in_campaigns(sales: DataFrame, campaigns: Sequence[tuple[str, datetime.date, datetime.date]]) -> DataFrame:
    """Lines with the campaigns whose days (both ends included) they fall in; a line in none has null, one in several is repeated."""
    ranges = _short(sales, campaigns, "campaign string, low date, high date")
    return sales.join(ranges, F.col("date").between(F.col("low"), F.col("high")), "left").drop("low", "high")


def with_holidays(sales: DataFrame, holidays: Sequence[tuple[datetime.date, str]]) -> DataFrame:
    """Adds holiday (its name or null) and is_holiday."""
    days = _short(sales, holidays, "date date, holiday string")
    return sales.join(days, "date", "left").withColumn("is_holiday", F.when(F.col("holiday").isNull(), 0).otherwise(1))


def aligned(actual: DataFrame, forecast: DataFrame, key: str) -> DataFrame:
    """Both sides by key, with nulls where one has no row."""
    return actual.join(forecast, key, "full")


def purchased(customers: DataFrame, later: DataFrame) -> DataFrame:
    """customers with bought: whether a later line is theirs."""
    buyers = later.select("customer_id").distinct().withColumn("bought_", F.lit(True))
    return customers.join(buyers, "customer_id", "left").withColumn("bought", F.col("bought_").isNotNull()).drop("bought_")


def missing_from(frame: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Keys of a frame that the other lacks."""
    return frame.select(key).distinct().join(other.select(key).distinct(), key, "left_anti")


def chosen_or_best(scores: DataFrame, chosen: DataFrame) -> DataFrame:
    """For each horizon the row of the chosen model, or that of least wape where the choice names none."""
    best = scores.groupBy("horizon").agg(F.min_by("model", F.struct("wape", "model")).alias("best"))
    picked = best.join(chosen.select("horizon", F.col("model").alias("choice")), "horizon", "left").select("horizon", F.coalesce("choice", "best").alias("model"))
    return scores.join(picked, ["horizon", "model"], "left_semi")


def target_audit(kpis: DataFrame, expected: Sequence[tuple[str, float]], tolerance: float = 1e-9) -> DataFrame:
    """metric, expected, value, meets: published numbers beside what they should be; a missing one doesn't meet."""
    wanted = _short(kpis, expected, "metric string, expected double")
    value = F.expr("try_cast(value AS DOUBLE)")
    near = F.abs(value - F.col("expected")) <= tolerance * F.greatest(F.abs("expected"), F.lit(1.0))
    return wanted.join(kpis, "metric", "left").select("metric", "expected", value.alias("value"), F.coalesce(near, F.lit(False)).alias("meets"))


def largest_movers(mix: DataFrame, n: int = 1) -> DataFrame:
    """direction, value, shift: the values whose shares rose and fell most."""
    up = mix.where("shift > 0").orderBy(F.desc("shift"), "value").limit(n).select(F.lit("up").alias("direction"), "value", "shift")
    down = mix.where("shift < 0").orderBy("shift", "value").limit(n).select(F.lit("down").alias("direction"), "value", "shift")
    return up.unionByName(down)


def filtered(frame: DataFrame, predicate: str, args: dict[str, object]) -> DataFrame:
    """Rows for which a SQL predicate with named parameters (:name) holds; values are bound, never spliced into the text."""
    return frame.sparkSession.sql(f"SELECT * FROM {{rows_}} WHERE {predicate}", args=args, rows_=frame)


def leaders_share(frame: DataFrame, value: str, n: int = 2) -> DataFrame:
    """The share of the whole that the n largest rows hold; rows that tie with the n-th add the same, whichever is taken."""
    top = frame.select(value).orderBy(F.desc(value)).limit(n).agg(F.sum(value).alias("top"))
    return top.crossJoin(F.broadcast(frame.agg(F.sum(value).alias("whole")))).select(ratio(F.col("top").cast("double"), F.col("whole")).alias("share"))


def season_dummies(frame: DataFrame, week: str = "week_start_date", drop_first: bool = False) -> DataFrame:
    """frame with one 0/1 column for each ISO week, 1 to 53."""
    number = F.weekofyear(week)
    return frame.withColumns({f"week_{i}": (number == i).cast("int") for i in range(2 if drop_first else 1, 54)})
