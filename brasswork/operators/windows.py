"""Window features of dense panels and ranked frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brasswork.functions.numbers import quantile_bucket
from brasswork.operators.ranges import running
from brasswork.session import cut


def panel_features(panel: DataFrame, keys: Sequence[str] = ("store_id", "product_id"), week: str = "week_start_date", value: str = "units_sold", lags: Sequence[int] = (1, 2, 4), width: int = 4) -> DataFrame:
    """Lags, and mean, maximum and sample deviation of the rows before the current one, by series.

    Lags count rows, so the panel must be dense. A mean needs one earlier row, a deviation two.
    """
    series = Window.partitionBy(*keys).orderBy(week)
    earlier = series.rowsBetween(-width, -1)
    out = panel
    for k in lags:
        out = out.withColumn(f"lag_{k}", F.lag(value, k).over(series))
    return out.withColumns({
        f"mean_{width}": F.avg(value).over(earlier), f"max_{width}": F.max(value).over(earlier), f"std_{width}": F.stddev_samp(value).over(earlier),
        "series_index": F.row_number().over(series) - 1, "zero_demand": (F.col(value) == 0).cast("int"), "stockout": (F.col("stockout_count") > 0).cast("int"),
    })


def expanding(frame: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """Mean and sample variance of all earlier rows of a series, the current one left out."""
    earlier = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return frame.withColumns({"past_mean": F.avg(value).over(earlier), "past_var": F.var_samp(value).over(earlier), "past_rows": F.count(value).over(earlier)})


def last_rows(frame: DataFrame, keys: Sequence[str], order: str, n: int) -> DataFrame:
    """The last n rows of each series."""
    window = Window.partitionBy(*keys).orderBy(F.desc(order))
    return frame.withColumn("from_end_", F.row_number().over(window)).where(F.col("from_end_") <= n).drop("from_end_")


def week_gaps(frame: DataFrame, keys: Sequence[str], week: str) -> DataFrame:
    """Rows whose week doesn't follow the series' last one by seven days."""
    before = F.lag(week).over(Window.partitionBy(*keys).orderBy(week))
    return frame.select(*keys, week, F.datediff(week, before).alias("days")).where("days <> 7")


def rfm_quartiles(customers: DataFrame, columns: dict[str, bool], key: str = "customer_id") -> DataFrame:
    """Quartiles 1 to 4 of columns by ranks (ties by key); True turns a column's order round, so that 4 is the smallest.

    The input and what each column adds are written, as ranks in two levels read their rows three times.
    """
    out = cut(customers)
    for column, reverse in columns.items():
        ranked, totals = running(out, [F.col(column), F.col(key)], rank="rank_")
        bucket = quantile_bucket(F.col("rank_"), F.lit(totals["rank_"]), 4)
        out = cut(ranked.withColumn(f"{column}_quartile", (5 - bucket if reverse else bucket).cast("int")).drop("rank_"))
    return out


def global_rank(frame: DataFrame, column: str, tie: str, name: str) -> DataFrame:
    """Adds the rank, from 1, in ascending order of a column and then of a tie breaker, without a window over all rows."""
    return running(cut(frame), [F.col(column), F.col(tie)], rank=name)[0]


#: Segment names by recency and frequency quartile (4 is best).
QUARTILE_SEGMENTS = {
    (1, 1): "Dormant", (1, 2): "Dormant", (1, 3): "Cannot lose them", (1, 4): "Cannot lose them",
    (2, 1): "At risk", (2, 2): "At risk", (2, 3): "At risk", (2, 4): "At risk",
    (3, 1): "Needs attention", (3, 2): "Needs attention", (3, 3): "Potential loyalist", (3, 4): "Potential loyalist",
    (4, 1): "New / promising", (4, 2): "New / promising", (4, 3): "Champions", (4, 4): "Champions",
}


def quartile_segments(customers: DataFrame) -> DataFrame:
    """Adds quartiles of recency (4 is most recent), frequency and monetary, and the segment that the first two name."""
    scored = rfm_quartiles(customers, {"recency_days": True, "frequency": False, "monetary": False})
    pairs = [F.lit(x) for (r, f), name in QUARTILE_SEGMENTS.items() for x in (f"{r}{f}", name)]
    code = F.concat(F.col("recency_days_quartile").cast("string"), F.col("frequency_quartile").cast("string"))
    return scored.withColumn("segment", F.create_map(*pairs)[code])
