"""Descriptions of frames and short lists for reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brasswork.functions.numbers import total
from brasswork.operators.ranges import column_quantiles


def describe(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, n, mean, std, least, q25, q50, q75, most: sums of all columns in one pass; quartiles are interpolated, and taken in two levels."""
    rows = []
    for c in columns:
        x = F.col(c).cast("double")
        rows.append(F.struct(F.lit(c).alias("column"), F.count(x).alias("n"), F.round(F.avg(x), 6).alias("mean"), F.round(F.stddev_samp(x), 6).alias("std"), F.min(x).alias("least"), F.max(x).alias("most")).alias(c))
    sums = frame.agg(*rows).select(F.inline(F.array(*[F.col(c) for c in columns])))
    found = sums.join(column_quantiles(frame, columns, (0.25, 0.5, 0.75)), "column", "left")
    return found.select("column", "n", "mean", "std", "least", *[F.round(F.col("quantiles")[k], 6).alias(name) for k, name in enumerate(("q25", "q50", "q75"))], "most")


def spread(frame: DataFrame, value: str) -> DataFrame:
    """least, median, mean and most of a column."""
    x = F.col(value).cast("double")
    return frame.agg(F.min(x).alias("least"), F.round(F.median(x), 6).alias("median"), F.round(F.avg(x), 6).alias("mean"), F.max(x).alias("most"))


def top_by_revenue(sales: DataFrame, key: str, n: int = 10) -> DataFrame:
    """The n keys of most revenue with their units; ties go by key."""
    sums = sales.groupBy(key).agg(total("sales_amount").alias("revenue"), F.sum("quantity_sold").cast("long").alias("units"))
    return sums.orderBy(F.desc("revenue"), key).limit(n)


def summary(sales: DataFrame) -> DataFrame:
    """One row: lines, first and last day, distinct transactions, customers, stores and products, units and revenue."""
    n = lambda c: F.count_distinct(c)
    return sales.agg(
        F.count("*").alias("lines"), F.min("date").alias("first_day"), F.max("date").alias("last_day"), n("transaction_id").alias("transactions"), n("customer_id").alias("customers"),
        n("store_id").alias("stores"), n("product_id").alias("products"), F.sum("quantity_sold").cast("long").alias("units"), total("sales_amount").alias("revenue"),
    )


def json_field(frame: DataFrame, column: str, schema: str) -> DataFrame:
    """frame with the fields of a JSON text, read by a schema, in place of the text; a text that isn't JSON gives nulls."""
    return frame.withColumn("parsed_", F.from_json(column, schema)).select(*[c for c in frame.columns if c != column], "parsed_.*")


def as_json(frame: DataFrame, name: str = "json") -> DataFrame:
    """Each row as one JSON text, nulls kept."""
    return frame.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias(name))


def movers(mix: DataFrame, n: int = 10) -> DataFrame:
    """The n values of a share table that moved most in either direction; ties go by value."""
    return mix.withColumn("moved", F.round(F.abs("shift"), 12)).orderBy(F.desc("moved"), "value").limit(n).drop("moved")


def most_common(frame: DataFrame, column: str, n: int = 10) -> DataFrame:
    """value, n: the most frequent values, null among them; ties go by value."""
    counted = frame.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return counted.orderBy(F.desc("n"), F.asc_nulls_first("value")).limit(n)


def to_columns(frame: DataFrame, keys: Sequence[str], names: Sequence[str], fill: float = 0.0) -> DataFrame:
    """Keys and exactly these columns: those that are missing are filled, others go."""
    return frame.select(*keys, *[F.coalesce(F.col(c).cast("double"), F.lit(fill)).alias(c) if c in frame.columns else F.lit(fill).alias(c) for c in names])


def latest(frame: DataFrame, day: str = "snapshot_date") -> DataFrame:
    """The rows of the last day."""
    last = frame.agg(F.max(day).alias("last_"))
    return frame.join(F.broadcast(last), F.col(day) == F.col("last_"), "left_semi")


def basket_products(sales: DataFrame, least: int = 2) -> DataFrame:
    """transaction_id, products (their distinct products in order), n: of baskets of at least so many."""
    own = sales.groupBy("transaction_id").agg(F.array_sort(F.collect_set("product_id")).alias("products"))
    return own.withColumn("n", F.size("products")).where(F.col("n") >= least)


def look(frame: DataFrame, days: Sequence[str] = (), head: int = 5) -> dict[str, object]:
    """A first look at a table: rows, columns with their kinds, the first rows as texts, and first and last of the given days.

    One aggregation, and a read of `head` rows.
    """
    found = frame.agg(F.count("*").alias("rows"), *[f(c).cast("string").alias(f"{n}_{c}") for c in days for n, f in (("first", F.min), ("last", F.max))]).first()
    rows = [[None if v is None else str(v) for v in row] for row in frame.limit(head).collect()]
    return {"rows": found["rows"], "columns": dict(frame.dtypes), "head": rows, "days": {c: (found[f"first_{c}"], found[f"last_{c}"]) for c in days}}
