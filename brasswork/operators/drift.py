"""Distribution drift between two periods."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brasswork.functions.numbers import ratio
from brasswork.operators.ranges import quantiles
from brasswork.session import cut

FLOOR = 1e-6


def split_periods(frame: DataFrame, reference: int, current: int, year: str = "year") -> DataFrame:
    """Rows of two years with `period` (reference or current); raises ValueError if a year has none."""
    both = frame.where(F.col(year).isin(reference, current)).withColumn("period", F.when(F.col(year) == reference, "reference").otherwise("current"))
    there = {r["period"] for r in both.select("period").distinct().collect()}
    if len(there) < 2:
        raise ValueError(f"only {sorted(there)} of {reference} and {current} have rows")
    return both


def psi(both: DataFrame, columns: Sequence[str], bins: int = 10, open_ended: bool = False) -> DataFrame:
    """feature, psi for numeric columns: population stability over quantile bins of the reference.

    Edges are interpolated and repeated ones dropped; bins are closed on the right, the lowest edge belongs to the first.
    Values outside the reference's range are left out of the current period's shares, or with open_ended counted in the
    outer bins. Without rows on a side it is null. Rows are first counted by value, and edges found in two levels, so that
    no task holds all values of a column. Texts that aren't numbers count as missing.
    """
    numeric = both.select("period", *[F.col(c).try_cast("double").alias(c) for c in columns])
    tall = numeric.unpivot(["period"], list(columns), "feature", "x").where(F.col("x").isNotNull())
    tall = cut(tall.groupBy("feature", "period", "x").agg(F.count("*").alias("n_")))
    found = quantiles(tall.where("period = 'reference'").select("feature", "x", "n_"), ["feature"], "x", "n_", [i / bins for i in range(bins + 1)])
    edges = found.select("feature", F.array_distinct("quantiles").alias("edges"))  # a row for each column
    x = F.col("x")
    low, high = F.element_at("edges", 1), F.element_at("edges", -1)
    inner = F.when(x == low, 1).otherwise(F.size(F.filter("edges", lambda e: e < x)))
    last = F.greatest(F.size("edges") - 1, F.lit(1))
    inside = (x >= low) & (x <= high)
    bucket = F.least(F.greatest(inner, F.lit(1)), last) if open_ended else F.when(inside, F.least(F.greatest(inner, F.lit(1)), last))
    counted = tall.join(F.broadcast(edges), "feature").withColumn("bucket", bucket).where("bucket is not null")
    side = lambda p: F.sum(F.when(F.col("period") == p, F.col("n_")).otherwise(0))
    by_bucket = counted.groupBy("feature", "bucket").agg(side("reference").alias("r"), side("current").alias("c"))
    whole = by_bucket.groupBy("feature").agg(F.sum("r").alias("all_r"), F.sum("c").alias("all_c"))
    shares = by_bucket.join(F.broadcast(whole), "feature").select("feature", F.greatest(ratio(F.col("r").cast("double"), F.col("all_r")), F.lit(FLOOR)).alias("r"), F.greatest(ratio(F.col("c").cast("double"), F.col("all_c")), F.lit(FLOOR)).alias("c"), "all_c")
    return shares.groupBy("feature").agg(F.when(F.max("all_c") > 0, F.round(F.sum((F.col("c") - F.col("r")) * F.log(F.col("c") / F.col("r"))), 6)).alias("psi"))


def verdict(value: Column) -> Column:
    return F.when(value.isNull() | F.isnan(value), "insufficient data").when(value >= 0.2, "significant").when(value >= 0.1, "moderate").otherwise("stable")


def category_shift(both: DataFrame, column: str) -> DataFrame:
    """One row: half the sum of absolute share differences, and the value that moved most (the first by name on ties)."""
    shares = share_table(both, column)
    moved = F.min_by("value", F.struct(-F.round(F.abs("shift"), 12), "value"))
    return shares.agg(F.lit(column).alias("feature"), F.round(F.sum(F.abs("shift")) / 2, 6).alias("distance"), moved.alias("largest_mover"), F.count("*").alias("values"))


def share_table(both: DataFrame, column: str, weight: str | None = None) -> DataFrame:
    """value, reference, current, shift: shares of each period by value; 0 where a value is missing on one side."""
    amount = F.lit(1) if weight is None else F.col(weight)
    side = lambda p: F.sum(F.when(F.col("period") == p, amount).otherwise(0)).cast("double")
    counted = both.groupBy(F.col(column).cast("string").alias("value")).agg(side("reference").alias("r"), side("current").alias("c"))
    whole = counted.agg(F.sum("r").alias("all_r"), F.sum("c").alias("all_c"))
    out = counted.crossJoin(F.broadcast(whole))
    return out.select("value", ratio(F.col("r"), F.col("all_r")).alias("reference"), ratio(F.col("c"), F.col("all_c")).alias("current")).withColumn("shift", F.col("current") - F.col("reference"))


def category_mix(both: DataFrame, column: str, weight: str) -> DataFrame:
    """share_table with each value's own term of the stability index."""
    r, c = F.greatest("reference", F.lit(FLOOR)), F.greatest("current", F.lit(FLOOR))
    return share_table(both, column, weight).withColumn("term", F.round((c - r) * F.log(c / r), 8))


def numeric_summary(both: DataFrame, columns: Sequence[str]) -> DataFrame:
    """feature, psi, means and medians of both periods, verdict."""
    tall = both.select("period", *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(["period"], list(columns), "feature", "x")
    at = lambda f, p, name: F.round(f(F.when(F.col("period") == p, F.col("x"))), 6).alias(name)
    stats = tall.groupBy("feature").agg(at(F.avg, "reference", "mean_reference"), at(F.avg, "current", "mean_current"))
    counted = tall.where("x is not null").groupBy("feature", "period", "x").agg(F.count("*").alias("n_"))
    middle = quantiles(counted, ["feature", "period"], "x", "n_", [0.5]).select("feature", "period", F.round(F.col("quantiles")[0], 6).alias("median_"))
    medians = middle.groupBy("feature").agg(*[F.max(F.when(F.col("period") == p, F.col("median_"))).alias(f"median_{p}") for p in ("reference", "current")])
    return psi(both, columns).join(stats, "feature").join(medians, "feature").withColumn("verdict", verdict(F.col("psi")))


def report(both: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """One row for each watched column, numeric or categorical."""
    out = numeric_summary(both, numeric)
    for column in categorical:
        row = category_shift(both, column).withColumn("verdict", verdict(F.col("distance")))
        out = out.unionByName(row, allowMissingColumns=True)
    return out


def overall(summary: DataFrame) -> DataFrame:
    """verdict: 'drift detected' if a column's verdict is moderate or significant, and which columns those are."""
    moved = F.col("verdict").isin("moderate", "significant")
    out = summary.agg(F.array_join(F.array_sort(F.collect_list(F.when(moved, F.col("feature")))), ",").alias("drifted"), F.sum(F.when(moved, 1).otherwise(0)).alias("n"))
    return out.select(F.when(F.col("n") > 0, "drift detected").otherwise("stable").alias("verdict"), "drifted")
