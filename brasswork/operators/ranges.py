"""Ranks, running sums and quantiles of whole tables in two levels, so that no task sorts or holds all rows.

Rows are dealt to ranges of their order by bounds from a bounded sample, ranked and summed within each range, and raised
by what lies in the ranges before: a list of at most as many numbers as there are ranges.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brasswork.session import cut

PARTS = 64
SAMPLE_ROWS = 20_000  # keys of the order that the driver gets to choose bounds from


def _range_of(frame: DataFrame, key: Column, parts: int, sample_rows: int) -> Column:
    """How many bounds lie below a row's key. Equal keys of a sample by hash stay together, and any bounds give right results."""
    few = frame.select(key.alias("key")).orderBy(F.xxhash64("key"), "key").limit(sample_rows).orderBy("key")
    kinds = {f.name: f.dataType for f in few.schema["key"].dataType}
    rows = [r["key"] for r in few.collect()]
    chosen = list(dict.fromkeys(rows[len(rows) * i // parts] for i in range(1, parts) if rows))
    if not chosen:
        return F.lit(0)
    bounds = F.array(*[F.struct(*[F.lit(b[n]).cast(kind).alias(n) for n, kind in kinds.items()]) for b in chosen])
    return F.size(F.filter(bounds, lambda b: b < key))


def running(frame: DataFrame, order: Sequence[Column], sums: Mapping[str, str] | None = None, rank: str = "rank", parts: int = PARTS, sample_rows: int = SAMPLE_ROWS) -> tuple[DataFrame, dict]:
    """frame with its rank, from 1, in ascending order, and running sums: {new column: summed column}; and the totals of both.

    The order should be total, or which of equal rows is first is open. frame should be cheap to read: it is read three times.
    """
    sums = dict(sums or {})
    key = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)])
    ranged = frame.withColumn("range_", _range_of(frame, key, parts, sample_rows))
    found = ranged.groupBy("range_").agg(F.count("*").alias(rank), *[F.sum(c).alias(name) for name, c in sums.items()]).orderBy("range_").collect()
    names = [rank, *sums]
    before: dict[str, dict[int, object]] = {n: {} for n in names}
    totals: dict = {n: 0 for n in names}
    for row in found:
        for n in names:
            before[n][row["range_"]] = totals[n]
            totals[n] += row[n] or 0
    within = Window.partitionBy("range_").orderBy(key)
    upto = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def raised(name: str, value: Column) -> Column:
        if not found:
            return value
        offsets = F.create_map(*[F.lit(x) for place, amount in before[name].items() for x in (place, amount)])
        return value + offsets[F.col("range_")]

    out = ranged.withColumns({rank: raised(rank, F.row_number().over(within)).cast("long")} | {n: raised(n, F.sum(c).over(upto)) for n, c in sums.items()})
    return out.drop("range_"), totals


def top_rows(frame: DataFrame, order: Sequence[Column], share: float, n_top: Callable[[float], int] = round) -> DataFrame:
    """The first max(1, n_top(share times rows)) rows in an order, where that number grows with the rows: no task gathers them."""
    run, totals = running(cut(frame), order, rank="rank_")
    return run.where(F.col("rank_") <= max(1, n_top(share * totals["rank_"]))).drop("rank_")


def quantiles(counted: DataFrame, keys: Sequence[str], value: str, n: str, at: Sequence[float]) -> DataFrame:
    """keys and `quantiles` (in the order of `at`, interpolated) from how often (n) each value occurs by keys."""
    counted = cut(counted)
    run, _ = running(counted, [*map(F.col, keys), F.col(value)], {"upto_": n})
    run = run.withColumn("before_", F.col("upto_") - F.col(n))
    sizes = run.groupBy(*keys).agg(F.min("before_").alias("start_"), F.sum(n).alias("size_"))
    want = sizes.select(*keys, "start_", "size_", F.posexplode(F.array(*[F.lit(float(q)) for q in at])).alias("place_", "q_"))
    want = want.withColumn("pos_", (F.col("size_") - 1) * F.col("q_")).withColumns({"low_": F.floor("pos_"), "high_": F.ceil("pos_")})
    # a row for each key and quantile; keys are few (columns of a frame, periods)
    told = F.broadcast(want.select(*[F.col(k).alias(f"of_{k}") for k in keys], "start_", "place_", "pos_", "low_", "high_"))
    first, last = F.col("before_") - F.col("start_"), F.col("upto_") - F.col("start_")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"of_{k}"))
    met = run.join(told, same & (first <= F.col("high_")) & (last > F.col("low_")))
    holds = lambda place: F.max(F.when((first <= F.col(place)) & (last > F.col(place)), F.col(value)))
    each = met.groupBy(*keys, "place_").agg(holds("low_").alias("a_"), holds("high_").alias("b_"), F.max(F.col("pos_") - F.col("low_")).alias("part_"))
    each = each.withColumn("x_", F.col("a_") + (F.col("b_") - F.col("a_")) * F.col("part_"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("place_", "x_"))), lambda s: s["x_"])
    return each.groupBy(*keys).agg(listed.alias("quantiles"))


def column_quantiles(frame: DataFrame, columns: Sequence[str], at: Sequence[float]) -> DataFrame:
    """column, quantiles (in the order of `at`) of each column's values, told from how often each occurs; columns without a value have no row."""
    tall = frame.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], list(columns), "column", "x")
    return quantiles(tall.where("x is not null").groupBy("column", "x").agg(F.count("*").alias("n")), ["column"], "x", "n", at)
