"""Typed readers and sinks for the contract's files."""

from __future__ import annotations

import json
from collections import OrderedDict
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brasswork.operators.quality import PANEL_COLUMNS, SALES_COLUMNS, contract_report, duplicates, facts_differences, panel_rules, sales_rules, validate_panel, validate_sales
from brasswork.operators.rollup import facts

#: The contract's columns that aren't texts, by type.
_KINDS = {
    T.DateType(): {"date", "week_start_date"},
    T.IntegerType(): {"quantity_sold", "inventory_level", "is_promotion", "is_weekend", "is_holiday", "week_of_year", "year", "units_sold", "is_promo_week", "stockout_count", "on_hand_end"},
    T.DoubleType(): {"unit_price", "discount", "sales_amount", "discount_pct", "revenue", "avg_unit_price", "avg_discount_pct"},
}


def schema_of(columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, next((k for k, names in _KINDS.items() if c in names), T.StringType())) for c in columns])


SALES_SCHEMA, PANEL_SCHEMA = schema_of(SALES_COLUMNS), schema_of(PANEL_COLUMNS)


def read_csv(spark: SparkSession, path: str, schema: T.StructType, typed: bool = True) -> DataFrame:
    """A file with a header, whose order is checked; a malformed row stops the read. Untyped, all columns are text."""
    if not typed:
        schema = T.StructType([T.StructField(f.name, T.StringType()) for f in schema])
    return spark.read.schema(schema).csv(path, header=True, enforceSchema=False, nullValue="None" if typed else None, mode="FAILFAST")


def load_sales(spark: SparkSession, path: str, rows: int | None = None) -> DataFrame:
    frame = read_csv(spark, path, SALES_SCHEMA)
    validate_sales(frame, rows)
    return frame


def load_panel(spark: SparkSession, path: str, rows: int | None = None) -> DataFrame:
    frame = read_csv(spark, path, PANEL_SCHEMA)
    validate_panel(frame, rows)
    return frame


def ingest(spark: SparkSession, sales_path: str, panel_path: str, counts: tuple[int, int] | None = None, expected: dict[str, float] | None = None) -> tuple[DataFrame, DataFrame, dict]:
    """Both files, and a report of what their contracts find: counts are the rows that they should have, expected the facts.

    Nothing is raised for breaches; the report's `valid` tells whether everything holds.
    """
    sales, panel = read_csv(spark, sales_path, SALES_SCHEMA), read_csv(spark, panel_path, PANEL_SCHEMA)
    found = {"sales": contract_report(sales, SALES_COLUMNS, sales_rules()), "panel": contract_report(panel, PANEL_COLUMNS, panel_rules())}
    found["panel"]["repeated"] = duplicates(panel, ["store_id", "product_id", "week_start_date"]).first()["extra_rows"]
    lines = sales.withColumns({"discount_value": F.col("quantity_sold") * F.col("discount"), "sku_id": F.col("product_id")})
    found["differences"] = facts_differences(facts(lines), expected) if expected else []
    short = [name for name, rows in zip(("sales", "panel"), counts or (), strict=False) if found[name]["rows"] != rows]
    found["valid"] = all(found[n]["valid"] for n in ("sales", "panel")) and not found["panel"]["repeated"] and not found["differences"] and not short
    return sales, panel, found | {"wrong_counts": short}


class TableCache:
    """Tables kept by path as long as their files stay the same: the same paths, sizes and modification times.

    Files are listed by Spark, so paths may be in any store, and their contents aren't read for it; what is compared is one
    row. A table whose files changed is read anew and its old rows are freed, and so is the table that has waited longest
    when more than `most` are kept.
    """

    def __init__(self, spark: SparkSession, most: int = 32):
        self.spark, self.most = spark, most
        self._held: OrderedDict[str, tuple[tuple, DataFrame]] = OrderedDict()

    def mark(self, path: str) -> tuple[int, int, int]:
        """Number of files, bytes, and a sum of hashes of their paths, sizes and times. Raises FileNotFoundError if there is nothing."""
        try:
            files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "modificationTime", "length")
            n, size, code = files.agg(F.count("*"), F.sum("length"), F.sum(F.xxhash64("path", "modificationTime", "length").cast("decimal(38,0)"))).first()
        except AnalysisException as e:
            raise FileNotFoundError(f"nothing to read at {path}; run the stages that publish it") from e
        if not n:
            raise FileNotFoundError(f"no files in {path}; run the stages that publish it")
        return n, size, int(code)

    def read(self, path: str, reader: Callable[[SparkSession, str], DataFrame] = lambda spark, path: spark.read.parquet(path)) -> DataFrame:
        mark = self.mark(path)
        held = self._held.get(path)
        if held and held[0] == mark:
            self._held.move_to_end(path)
            return held[1]
        self.forget(path)
        frame = reader(self.spark, path).persist()
        self._held[path] = mark, frame
        while len(self._held) > self.most:
            self.forget(next(iter(self._held)))
        return frame

    def forget(self, path: str) -> None:
        held = self._held.pop(path, None)
        if held:
            held[1].unpersist()


def ordered_sales(frame: DataFrame) -> DataFrame:
    return frame.orderBy("date", "transaction_id", "product_id")


def read_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True)


def markdown_headings(spark: SparkSession, path: str) -> DataFrame:
    """place, level, title of the headings of each file, outside fenced code. Files are read whole, one row each."""
    files = spark.read.text(path, wholetext=True)
    bare = F.regexp_replace("value", r"(?ms)^ {0,3}(```+|~~~+).*?(^ {0,3}\1[`~]*\s*$|\z)", "")
    found = F.regexp_extract_all(bare, F.lit(r"(?m)^(#{1,6})[ \t]+(.+?)[ \t]*#*[ \t]*$"), F.lit(0))
    lines = files.select(F.posexplode(found).alias("place", "line"))
    return lines.select("place", F.length(F.regexp_extract("line", r"^(#+)", 1)).alias("level"), F.regexp_replace("line", r"^#+[ \t]+|[ \t]*#*[ \t]*$", "").alias("title"))


def write_csv(frame: DataFrame, path: str, one_file: bool = False) -> None:
    """CSV with a header; one_file is for small published tables only."""
    (frame.coalesce(1) if one_file else frame).write.mode("overwrite").csv(path, header=True)


def write_table(frame: DataFrame, path: str) -> None:
    frame.write.mode("overwrite").parquet(path)


def write_json(spark: SparkSession, document: dict, path: str) -> None:
    """A small document as the one file of a folder, in any place that Spark writes to; read_json reads it back."""
    text = json.dumps(document, indent=2)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
