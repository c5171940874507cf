"""Point-in-time customer features and labelled churn snapshots."""

from __future__ import annotations

import datetime
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brasswork.functions.dates import window_start
from brasswork.functions.numbers import ratio
from brasswork.session import cut

FEATURES = ("recency_days", "frequency", "monetary", "units", "lines", "categories", "promo_share", "mean_discount_pct", "online_share", "tenure_days", "units_per_line", "avg_basket_value")
#: Names with these beginnings would give away what comes after a snapshot.
FORBIDDEN = ("future_", "next_", "label_", "target_")
LABELS = ("churn",)
#: At most so many snapshots are sent to all executors for the range join.
MAX_SNAPSHOTS = 10_000


class LeakageError(ValueError):
    """A feature frame knows more than it may."""


def _snapshots(spark: SparkSession, dates: Sequence[datetime.date]) -> DataFrame:
    if len(dates) > MAX_SNAPSHOTS:
        raise ValueError(f"at most {MAX_SNAPSHOTS} snapshots at once")
    return spark.createDataFrame([(d,) for d in sorted(set(dates))], "snapshot_date date")


def transactions(sales: DataFrame, online: Sequence[str] = ("1-URGENT", "2-HIGH")) -> DataFrame:
    """One row for each customer, transaction and day, with sums over its lines and the set of its categories: what features are made of."""
    return sales.groupBy("customer_id", "transaction_id", "date").agg(
        F.count("*").alias("lines"), F.sum("sales_amount").alias("amount"), F.sum("quantity_sold").alias("units"), F.sum("is_promotion").alias("promo"),
        F.sum("discount_pct").alias("discount"), F.count("discount_pct").alias("discounts"), F.sum(F.col("channel").isin(*online).cast("int")).alias("online"), F.collect_set("product_category").alias("categories"),
    )


def _seen(bought: DataFrame, dates: Sequence[datetime.date], window_days: int, label_days: int) -> DataFrame:
    """bought, once for each snapshot_date it may tell something of; what lies before every window comes once, without a date."""
    spans = F.broadcast(bought.sparkSession.createDataFrame([(d,) for d in [None, *dates]], "snapshot_date date"))
    day, snapshot = F.col("date"), F.col("snapshot_date")
    past = day < window_start(F.lit(min(dates, default=None)).cast("date"), window_days)
    return bought.join(spans, F.when(past, snapshot.isNull()).otherwise(day <= F.date_add(snapshot, label_days)))


def _at_snapshots(bought: DataFrame, dates: Sequence[datetime.date], window_days: int, label_days: int) -> DataFrame:
    """Features and `later` (whether a transaction follows in label_days) from transactions, in one range join and two aggregations.

    Rows reach the join already summed by transaction, and one column alone is counted distinct, so no row is multiplied
    but by the snapshots it belongs to. They are dealt by customer before that, so that what is multiplied isn't shuffled.
    What lies before every window tells the first and the last day alone: a row for each customer is left of it, which
    goes to all snapshots.
    """
    dates = sorted(set(dates))
    snapshots = F.broadcast(_snapshots(bought.sparkSession, dates))
    day, snapshot = F.col("date"), F.col("snapshot_date")
    seen = _seen(bought.repartition("customer_id"), dates, window_days, label_days)
    known = F.coalesce(day <= snapshot, F.lit(True))
    inside = (day <= snapshot) & (day >= window_start(snapshot, window_days))
    within = lambda value: F.when(inside, value)
    lines = F.sum(within(F.col("lines")))
    kinds = F.size(F.array_distinct(F.flatten(F.collect_set(within(F.col("categories"))))))
    parts = seen.groupBy("snapshot_date", "customer_id").agg(
        F.min(F.when(known, day)).alias("first_purchase"), F.max(F.when(known, day)).alias("last_purchase"),
        F.count_distinct(within(F.col("transaction_id"))).alias("frequency"), F.sum(within(F.col("amount"))).cast("double").alias("monetary"),
        F.sum(within(F.col("units"))).cast("long").alias("units"), F.coalesce(lines, F.lit(0)).cast("long").alias("lines"),
        F.nullif(kinds, F.lit(0)).cast("long").alias("categories"),
        ratio(F.sum(within(F.col("promo"))).cast("double"), lines).alias("promo_share"), F.round(ratio(F.sum(within(F.col("discount"))), F.sum(within(F.col("discounts")))), 6).alias("mean_discount_pct"),
        ratio(F.sum(within(F.col("online"))).cast("double"), lines).alias("online_share"), F.coalesce(F.max(day > snapshot), F.lit(False)).alias("later"),
    )
    # of the two rows of a snapshot and customer at most, only the one with the date has any values but the days
    values = [c for c in parts.columns if c not in ("snapshot_date", "customer_id", "first_purchase")]
    both = parts.withColumnRenamed("snapshot_date", "own").join(snapshots, F.col("own").isNull() | (F.col("own") == snapshot))
    out = both.groupBy("snapshot_date", "customer_id").agg(F.min("first_purchase").alias("first_purchase"), *[F.max(c).alias(c) for c in values]).where("first_purchase is not null")
    return out.withColumns({
        "recency_days": F.datediff("snapshot_date", "last_purchase"), "tenure_days": F.datediff("snapshot_date", "first_purchase"),
        "units_per_line": ratio(F.col("units").cast("double"), F.col("lines")), "avg_basket_value": ratio(F.col("monetary"), F.col("frequency")), "feature_as_of": F.col("snapshot_date"),
    })


def rfm_features(sales: DataFrame, as_of: Sequence[datetime.date], window_days: int = 90, include_unconverted: bool = True, online: Sequence[str] = ("1-URGENT", "2-HIGH")) -> DataFrame:
    """One row for each snapshot and customer who bought by then, from lines up to the snapshot alone.

    Window aggregates cover the trailing window_days, the snapshot's day included. A customer without lines in it keeps
    frequency and lines 0 and nulls elsewhere, or is left out if include_unconverted is False. Lines are read once.
    """
    out = _at_snapshots(transactions(sales, online), as_of, window_days, 0).drop("later")
    return out if include_unconverted else out.where("lines > 0")


def split_observable(sales: DataFrame, dates: Sequence[datetime.date], label_days: int = 90) -> tuple[list[datetime.date], list[tuple[datetime.date, str]]]:
    """Snapshots whose label window ends within the data, and those dropped with the reason."""
    last = sales.agg(F.max("date").alias("last")).first()["last"]
    kept, dropped = [], []
    for day in sorted(set(dates)):
        end = day + datetime.timedelta(days=label_days)
        if last is not None and end <= last:
            kept.append(day)
        else:
            dropped.append((day, f"label window ends {end}, data end {last}"))
    return kept, dropped


def churn_snapshots(sales: DataFrame, dates: Sequence[datetime.date], window_days: int = 90, label_days: int = 90, include_unconverted: bool = True, online: Sequence[str] = ("1-URGENT", "2-HIGH")) -> DataFrame:
    """Features at each observable snapshot, and churn: 1 if the customer buys nothing in the label_days after it.

    Sales are read once, summed by transaction and written; the last day, the features and the labels come from that table.
    """
    bought = cut(transactions(sales, online))
    kept, _ = split_observable(bought, dates, label_days)
    out = _at_snapshots(bought, kept, window_days, label_days).withColumn("churn", F.when(F.col("later"), 0).otherwise(1)).drop("later")
    return out if include_unconverted else out.where("lines > 0")


def leaks(frame: DataFrame, snapshot: str = "snapshot_date", allow_labels: bool = False) -> DataFrame:
    """Rows with a date after their snapshot."""
    dates = [f.name for f in frame.schema if f.dataType.typeName() in ("date", "timestamp", "timestamp_ntz") and f.name != snapshot]
    wrong = F.lit(False)
    for name in dates:
        wrong = wrong | F.coalesce(F.col(name).cast("date") > F.col(snapshot), F.lit(False))
    return frame.where(wrong)


def assert_no_leakage(frame: DataFrame, snapshot: str = "snapshot_date", allow_labels: bool = False) -> None:
    """Raises LeakageError for names that tell the future, labels among features, and dates after the snapshot."""
    named = [c for c in frame.columns if c.lower().startswith(FORBIDDEN) or not allow_labels and c.lower() in LABELS]
    if named:
        raise LeakageError(f"columns {named} are not known at the snapshot")
    n = leaks(frame, snapshot).limit(1).count()
    if n:
        raise LeakageError("a row holds a date after its snapshot")


def feature_matrix(frame: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """Key, provenance and those of the features that are there."""
    return frame.select([c for c in ("customer_id", "snapshot_date", "feature_as_of", *features) if c in frame.columns])


def model_matrix(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """These columns as doubles; raises ValueError if one is missing or isn't a number."""
    kinds = dict(frame.dtypes)
    wrong = [c for c in columns if not kinds.get(c, "missing").startswith(("int", "bigint", "smallint", "tinyint", "double", "float", "decimal"))]
    if wrong:
        raise ValueError(f"not numbers: {[(c, kinds.get(c, 'missing')) for c in wrong]}")
    return frame.select(*[F.col(c).cast("double").alias(c) for c in columns])
