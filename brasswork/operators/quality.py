"""Contracts and data-quality checks. Rules of a frame are fused into one aggregation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brasswork.functions.dates import strict_date, weekday_name
from brasswork.functions.numbers import count_if, price_band, ratio
from brasswork.operators.ranges import column_quantiles, quantiles

#: The columns of the two contracts, in their order.
SALES_COLUMNS = (
    "date", "customer_id", "store_id", "product_id", "product_category", "quantity_sold", "unit_price", "discount", "promotion",
    "inventory_level", "sales_amount", "city", "discount_pct", "is_promotion", "transaction_id", "product_name", "region", "weekday",
    "is_weekend", "is_holiday", "year_month", "week_of_year", "quarter", "price_band", "customer_segment", "loyalty_tier", "channel",
)
PANEL_COLUMNS = (
    "week_start_date", "year", "week_of_year", "store_id", "city", "region", "product_id", "product_category", "units_sold", "revenue",
    "avg_unit_price", "avg_discount_pct", "is_promo_week", "stockout_count", "on_hand_end",
)
NULLABLE = {"promotion"}
#: Cell texts that stand for nothing, in lower case.
NULL_TOKENS = ("", "na", "n/a", "nan", "null", "none", "-", "?")


class ContractViolation(ValueError):
    """A frame breaks a rule: its name, and by how many rows."""

    def __init__(self, rule: str, rows: int | str):
        super().__init__(f"{rule}: {rows}")
        self.rule, self.rows = rule, rows


def sales_rules(tolerance: float = 0.011) -> dict[str, Column]:
    """What a row of sales must not be, by rule, in the order in which breaches are reported."""
    c = F.col
    day = c("date")
    return {
        "sales_amount": F.abs(c("sales_amount") - c("quantity_sold") * (c("unit_price") - c("discount"))) > tolerance,
        "discount_over_price": c("discount") > c("unit_price") + 1e-9,
        "discount_pct": F.abs(c("discount_pct") - F.coalesce(ratio(c("discount"), c("unit_price")) * 100, F.lit(0.0))) > tolerance,
        "is_promotion": c("is_promotion") != F.when(c("promotion").isNull(), 0).otherwise(1),
        "discount_without_promotion": c("promotion").isNull() & (c("discount") != 0),
        "negative_quantity": c("quantity_sold") < 0,
        "negative_inventory": c("inventory_level") < 0,
        "lost_demand_with_stock": (c("quantity_sold") == 0) & (c("inventory_level") != 0),
        "weekday": c("weekday") != weekday_name(day),
        "is_weekend": c("is_weekend") != F.when(F.weekday(day) >= 5, 1).otherwise(0),
        "year_month": c("year_month") != F.date_format(day, "yyyy-MM"),
        "week_of_year": c("week_of_year") != F.weekofyear(day),
        "quarter": c("quarter") != F.concat(F.lit("Q"), F.quarter(day).cast("string")),
        "price_band": c("price_band") != price_band(c("unit_price")),
    }


def panel_rules() -> dict[str, Column]:
    c = F.col
    return {
        "negative_measure": (c("units_sold") < 0) | (c("revenue") < 0) | (c("stockout_count") < 0) | (c("on_hand_end") < 0),
        "week_start": F.weekday("week_start_date") != 0,
        "revenue_in_zero_week": (c("units_sold") == 0) & (c("revenue") != 0),
        "selling_week_without_revenue": (c("units_sold") > 0) & (c("revenue") <= 0),
    }


def breaches(frame: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One row: for each rule, how many rows break it. A comparison with null doesn't."""
    return frame.agg(*[F.coalesce(count_if(F.coalesce(rule, F.lit(False))), F.lit(0)).alias(name) for name, rule in rules.items()])


def null_counts(frame: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """column, nulls: of all columns in one pass."""
    names = list(columns or frame.columns)
    return frame.agg(*[F.coalesce(count_if(F.col(c).isNull()), F.lit(0)).alias(c) for c in names]).unpivot([], names, "column", "nulls")


def _check(frame: DataFrame, columns: Sequence[str], rules: dict[str, Column], rows: int | None) -> int:
    if list(frame.columns) != list(columns):
        raise ContractViolation("columns", f"expected {list(columns)}, found {frame.columns}")
    nulls = {f"null {c}": F.col(c).isNull() for c in columns if c not in NULLABLE}
    found = breaches(frame, nulls | rules).crossJoin(frame.agg(F.count("*").alias("rows_"))).first().asDict()
    n = found.pop("rows_")
    if rows is not None and n != rows:
        raise ContractViolation("row count", f"expected {rows}, found {n}")
    for rule, count in found.items():
        if count:
            raise ContractViolation(rule, count)
    return n


def validate_sales(frame: DataFrame, rows: int | None = None, tolerance: float = 0.011, sample: int | None = None) -> int:
    """Raises ContractViolation for the first broken rule; gives the number of rows. With sample, some so many rows alone are checked."""
    frame = frame if sample is None else frame.limit(sample)
    return _check(frame, SALES_COLUMNS, sales_rules(tolerance), rows)


def validate_panel(frame: DataFrame, rows: int | None = None) -> int:
    n = _check(frame, PANEL_COLUMNS, panel_rules(), rows)
    twice = duplicates(frame, ["store_id", "product_id", "week_start_date"]).first()["extra_rows"]
    if twice:
        raise ContractViolation("grain", twice)
    return n


def duplicates(frame: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """One row: keys that occur several times, and rows beyond the first of each."""
    grouped = frame.groupBy(*(keys or frame.columns)).agg(F.count("*").alias("n_")).where("n_ > 1")
    return grouped.agg(F.count("*").alias("repeated_keys"), F.coalesce(F.sum(F.col("n_") - 1), F.lit(0)).cast("long").alias("extra_rows"))


def dependency_breaches(frame: DataFrame, key: Sequence[str], determined: str) -> DataFrame:
    """keys that stand with several values of a column that they should determine."""
    # two values at least are a least and a greatest that differ, which takes no table of distinct values
    grouped = frame.groupBy(*key).agg(F.min(determined).alias("least_"), F.max(determined).alias("most_")).where("least_ < most_")
    return grouped.agg(F.count("*").alias("broken_keys"))


def text_audit(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, empty, padded, null_like: cells without text, with space around it, or that spell out nothing."""
    measures = []
    for c in columns:
        text = F.col(c)
        bare = F.trim(text)
        measures.append(F.struct(F.lit(c).alias("column"), count_if(text.isNotNull() & (bare == "")).alias("empty"), count_if(text != bare).alias("padded"), count_if(F.lower(bare).isin(*NULL_TOKENS)).alias("null_like")).alias(c))
    return frame.agg(*measures).select(F.inline(F.array(*[F.col(c) for c in columns])))


def calendar_gaps(frame: DataFrame, day: str) -> DataFrame:
    """Days between the first and the last on which no row falls."""
    bounds = frame.agg(F.min(day).alias("first"), F.max(day).alias("last"))
    days = bounds.select(F.explode(F.sequence("first", "last")).alias("missing_day"))
    return days.join(frame.select(F.col(day).alias("missing_day")).distinct(), "missing_day", "left_anti")


def bad_dates(frame: DataFrame, column: str) -> DataFrame:
    """Rows whose text isn't a date of the form 2024-01-31."""
    return frame.where(F.col(column).isNotNull() & strict_date(F.col(column)).isNull())


def numeric_sanity(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, least, most, p50, p99 (interpolated), negative, zero, not_finite: counts in one pass, percentiles in two levels."""
    rows = []
    for c in columns:
        x = F.col(c).cast("double")
        rows.append(F.struct(F.lit(c).alias("column"), F.min(x).alias("least"), F.max(x).alias("most"), count_if(x < 0).alias("negative"), count_if(x == 0).alias("zero"), count_if(F.isnan(x) | (F.abs(x) == float("inf"))).alias("not_finite")).alias(c))
    counts = frame.agg(*rows).select(F.inline(F.array(*[F.col(c) for c in columns])))
    found = counts.join(column_quantiles(frame, columns, (0.5, 0.99)), "column", "left")
    return found.select("column", "least", "most", F.round(F.col("quantiles")[0], 6).alias("p50"), F.round(F.col("quantiles")[1], 6).alias("p99"), "negative", "zero", "not_finite")


def profile(frame: DataFrame) -> DataFrame:
    """column, kind, nulls, distinct: a description of all columns."""
    kinds = dict(frame.dtypes)
    rows = [F.struct(F.lit(c).alias("column"), F.lit(kinds[c]).alias("kind"), count_if(F.col(c).isNull()).alias("nulls"), F.count_distinct(F.col(c)).alias("distinct")).alias(c) for c in frame.columns]
    return frame.agg(*rows).select(F.inline(F.array(*[F.col(c) for c in frame.columns])))


def contract_report(frame: DataFrame, columns: Sequence[str], rules: dict[str, Column]) -> dict[str, object]:
    """What a contract finds, without raising: rows, missing and further columns, breaches by rule (nulls included), and whether all holds."""
    missing, further = [c for c in columns if c not in frame.columns], [c for c in frame.columns if c not in columns]
    if missing:
        return {"rows": frame.count(), "missing": missing, "further": further, "breaches": {}, "valid": False}
    nulls = {f"null {c}": F.col(c).isNull() for c in columns if c not in NULLABLE}
    found = breaches(frame, nulls | rules).crossJoin(frame.agg(F.count("*").alias("rows_"))).first().asDict()
    n = found.pop("rows_")
    broken = {rule: count for rule, count in found.items() if count}
    return {"rows": n, "missing": [], "further": further, "breaches": broken, "valid": not broken and not further}


def contract_rows(frame: DataFrame, columns: Sequence[str], rules: dict[str, Column]) -> DataFrame:
    """finding, rows, holds: what a contract finds as a table. Columns that are missing or not of the contract, nulls by column, and breaches by rule.

    Rows are counted in one pass; a missing column counts all rows, and rules wait until none is missing.
    """
    missing, further = [c for c in columns if c not in frame.columns], [c for c in frame.columns if c not in columns]
    counts = {f"missing {c}": F.lit(True) for c in missing} | {f"further {c}": F.lit(False) for c in further}
    counts |= {f"null {c}": F.col(c).isNull() for c in columns if c not in NULLABLE and c not in missing}
    counts |= {} if missing else rules
    found = frame.agg(F.count("*").alias("rows_"), *[count_if(when).alias(f"f{i}") for i, when in enumerate(counts.values())])
    each = [F.struct(F.lit(name).alias("finding"), F.col(f"f{i}").cast("long").alias("rows"), ((F.col(f"f{i}") == 0) & (not name.startswith(("missing", "further")))).alias("holds")) for i, name in enumerate(counts)]
    whole = F.struct(F.lit("rows").alias("finding"), F.col("rows_").alias("rows"), F.lit(True).alias("holds"))
    return found.select(F.inline(F.array(whole, *each)))


def weekday_balance(frame: DataFrame, day: str) -> DataFrame:
    """weekday, rows, share, chi: each weekday's part of the chi-square statistic against an even week."""
    counted = frame.groupBy(weekday_name(F.col(day)).alias("weekday")).agg(F.count("*").alias("rows"))
    whole = counted.agg(F.sum("rows").alias("all_"))
    even = F.col("all_") / 7
    return counted.crossJoin(F.broadcast(whole)).select("weekday", "rows", F.round(F.col("rows") / F.col("all_"), 8).alias("share"), F.round((F.col("rows") - even) * (F.col("rows") - even) / even, 6).alias("chi"))


def weekend_uplift(sales: DataFrame, day: str = "date", value: str = "sales_amount") -> DataFrame:
    """weekend_mean, weekday_mean, uplift: mean daily sums on Saturdays and Sundays against other days."""
    daily = sales.groupBy(F.col(day).alias("day")).agg(F.sum(value).cast("double").alias("x"))
    weekend = F.weekday("day") >= 5
    out = daily.agg(F.round(F.avg(F.when(weekend, F.col("x"))), 4).alias("weekend_mean"), F.round(F.avg(F.when(~weekend, F.col("x"))), 4).alias("weekday_mean"))
    return out.withColumn("uplift", F.round(ratio(F.col("weekend_mean"), F.col("weekday_mean")), 6))


def size_percentiles(frame: DataFrame, group: str, at: Sequence[float] = (0.1, 0.5, 0.9, 0.99)) -> DataFrame:
    """quantile, size: of the number of rows by group, told from how often each size occurs."""
    sizes = frame.groupBy(group).agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("n"))
    found = quantiles(sizes.withColumn("all_", F.lit(1)), ["all_"], "size", "n", at)
    return found.select(F.explode(F.arrays_zip(F.array(*[F.lit(float(q)) for q in at]).alias("quantile"), F.col("quantiles").alias("size"))).alias("s")).select("s.*").toDF("quantile", "size")


def correlation(frame: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """left, right, r: Pearson correlations of pairs of columns in one pass; null where a column doesn't vary."""
    cells = [F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.round(F.corr(F.col(a).cast("double"), F.col(b).cast("double")), 6).alias("r")).alias(f"{a}_{b}") for a, b in pairs]
    return frame.agg(*cells).select(F.inline(F.array(*[F.col(f"{a}_{b}") for a, b in pairs])))


def outlier_counts(frame: DataFrame, columns: Sequence[str], reach: float = 1.5) -> DataFrame:
    """column, low, high, outliers: rows beyond `reach` quartile ranges of the quartiles."""
    q1, q3 = F.col("quantiles")[0], F.col("quantiles")[1]
    fences = column_quantiles(frame, columns, (0.25, 0.75)).select("column", (q1 - reach * (q3 - q1)).alias("low"), (q3 + reach * (q3 - q1)).alias("high"))  # a row for each column
    tall = frame.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], list(columns), "column", "x")
    out = tall.join(F.broadcast(fences), "column").groupBy("column")
    return out.agg(F.round(F.first("low"), 6).alias("low"), F.round(F.first("high"), 6).alias("high"), count_if((F.col("x") < F.col("low")) | (F.col("x") > F.col("high"))).alias("outliers"))


def orphans(frame: DataFrame, key: str, other: DataFrame, other_key: str) -> DataFrame:
    """One row: rows whose key the other frame lacks, and how many such keys."""
    known = other.select(F.col(other_key).alias("known_")).distinct()
    lost = frame.where(F.col(key).isNotNull()).join(known, F.col(key) == F.col("known_"), "left_anti")
    return lost.agg(F.count("*").alias("rows"), F.count_distinct(key).alias("keys"))


def reconcile(panel: DataFrame, sales: DataFrame, first: str, end: str) -> DataFrame:
    """bucket, lines, units: where each sales line stands against the panel; each line is in one bucket."""
    known = panel.select("product_id").distinct().withColumn("known_", F.lit(True))
    day = F.col("date")
    inside = (day >= F.lit(first).cast("date")) & (day < F.lit(end).cast("date"))
    bucket = F.when(~inside, "partial week").when(F.col("known_").isNull(), "product not in panel").when(F.col("quantity_sold") == 0, "lost demand").otherwise("in panel")
    return sales.join(known, "product_id", "left").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("lines"), F.sum("quantity_sold").cast("long").alias("units"))


def facts_differences(measured: DataFrame, expected: dict[str, float]) -> list[tuple[str, float, float]]:
    """Facts (one row) that differ from what is expected: name, expected, found."""
    row = measured.first().asDict()
    return [(k, v, row.get(k)) for k, v in expected.items() if row.get(k) != v]
