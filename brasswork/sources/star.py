"""Retail views over a star schema of orders and line items, and the same views as SQL text for checks.

sales: one row for each order line, at the order's date. panel: one row for each store, product and Monday week, with
weeks without a sale filled in. Money is exact (decimals), so that sums don't depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brasswork.functions.dates import monday, weekday_name
from brasswork.operators.dense import dense_grid
from brasswork.session import cut

#: The weeks that are whole by the order dates: from first_monday up to end_monday.
SPAN_SQL = """
span AS (
  SELECT CAST(date_trunc('week', min(CAST(o_orderdate AS DATE)) + 6) AS DATE) AS first_monday, CAST(date_trunc('week', max(CAST(o_orderdate AS DATE)) + 1) AS DATE) AS end_monday FROM orders
)"""
FIRST_MONDAY, END_MONDAY = "(SELECT first_monday FROM span)", "(SELECT end_monday FROM span)"

SALES_SQL = """
sales AS (
  SELECT CAST(o.o_orderdate AS DATE) AS date, o.o_orderkey AS transaction_id, o.o_custkey AS customer_id,
    s.s_nationkey AS store_id, n.n_name AS city, r.r_name AS region, p.p_brand AS product_id, l.l_partkey AS sku_id,
    'CAT' || CAST(CAST(substr(p.p_brand, 7) AS INT) % 5 AS VARCHAR) AS product_category,
    CAST(l.l_quantity AS INT) AS quantity_sold, l.l_extendedprice / l.l_quantity AS unit_price,
    l.l_extendedprice / l.l_quantity * l.l_discount AS discount, 100 * l.l_discount AS discount_pct,
    CAST(CAST(l.l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l.l_discount AS DECIMAL(4,2))) AS DECIMAL(18,4)) AS sales_amount,
    CAST(CAST(l.l_extendedprice AS DECIMAL(12,2)) * CAST(l.l_discount AS DECIMAL(4,2)) AS DECIMAL(18,4)) AS discount_value,
    CASE WHEN l.l_discount > 0 THEN 'Deal ' || CAST(CAST(round(100 * l.l_discount) AS INT) AS VARCHAR) END AS promotion,
    CASE WHEN l.l_discount > 0 THEN 1 ELSE 0 END AS is_promotion,
    o.o_orderpriority AS channel, c.c_mktsegment AS customer_segment
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
    JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation n ON s.s_nationkey = n.n_nationkey
    JOIN region r ON n.n_regionkey = r.r_regionkey JOIN part p ON l.l_partkey = p.p_partkey
)"""

PANEL_SQL = f"""
weekly AS (
  SELECT store_id, product_id, CAST(date_trunc('week', date) AS DATE) AS week_start_date, sum(quantity_sold) AS units, sum(sales_amount) AS amount,
    max(is_promotion) AS promo
  FROM sales WHERE date >= {FIRST_MONDAY} AND date < {END_MONDAY} GROUP BY ALL
), pairs AS (SELECT DISTINCT store_id, product_id FROM weekly),
weeks AS (SELECT CAST(unnest(range(CAST(first_monday AS TIMESTAMP), CAST(end_monday AS TIMESTAMP), INTERVAL 7 DAY)) AS DATE) AS week_start_date FROM span),
panel AS (
  SELECT p.store_id, p.product_id, 'CAT' || CAST(CAST(substr(p.product_id, 7) AS INT) % 5 AS VARCHAR) AS product_category, k.week_start_date,
    CAST(year(k.week_start_date) AS INT) AS year, CAST(coalesce(w.units, 0) AS BIGINT) AS units_sold, CAST(coalesce(w.amount, 0) AS DECIMAL(18,4)) AS revenue,
    CASE WHEN w.units > 0 THEN CAST(w.amount AS DOUBLE) / w.units ELSE 0.0 END AS avg_unit_price, coalesce(w.promo, 0) AS is_promo_week,
    CAST((p.store_id * 7 + CAST(substr(p.product_id, 7) AS INT) * 3 + date_diff('day', {FIRST_MONDAY}, k.week_start_date) // 7) % 20 AS INT) AS on_hand_end,
    CASE WHEN (p.store_id * 7 + CAST(substr(p.product_id, 7) AS INT) * 3 + date_diff('day', {FIRST_MONDAY}, k.week_start_date) // 7) % 20 = 0 THEN 1 ELSE 0 END AS stockout_count
  FROM pairs p CROSS JOIN weeks k LEFT JOIN weekly w ON p.store_id = w.store_id AND p.product_id = w.product_id AND k.week_start_date = w.week_start_date
)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def span(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """The first Monday whose week the order dates cover, and the Monday after the last such week; both the same if none is.

    One row of the order dates. Raises ValueError without orders.
    """
    day = F.col("o_orderdate").cast("date")
    first, end = table(spark, sf_dir, "orders").agg(monday(F.date_add(F.min(day), 6)), monday(F.date_add(F.max(day), 1))).first()
    if first is None:
        raise ValueError("no orders, so no weeks")
    return str(first), str(max(first, end))


def brand_number(brand: str):
    return F.substring(F.col(brand), 7, 10).cast("int")


def net_amount():
    """A line's price less its discount, exact to four decimals."""
    return (F.col("l_extendedprice").cast("decimal(12,2)") * (1 - F.col("l_discount").cast("decimal(4,2)"))).cast("decimal(18,4)")


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with the columns of the sales contract that the star schema can give."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    # nation and region are tables of fixed size; the planner decides on the others by their sizes, which it doesn't know of
    # what a join gives: suppliers therefore meet lines as they are, and their places come last. Orders meet their customers
    # before the lines do, which are several times as many.
    places = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    bought = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    joined = (
        lines.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .join(bought, F.col("l_orderkey") == F.col("o_orderkey")).join(F.broadcast(places), F.col("s_nationkey") == F.col("n_nationkey"))
    )
    price, share = F.col("l_extendedprice").cast("decimal(12,2)"), F.col("l_discount").cast("decimal(4,2)")
    return joined.select(
        F.col("o_orderdate").cast("date").alias("date"), F.col("o_orderkey").alias("transaction_id"), F.col("o_custkey").alias("customer_id"),
        F.col("s_nationkey").alias("store_id"), F.col("n_name").alias("city"), F.col("r_name").alias("region"),
        F.col("p_brand").alias("product_id"), F.col("l_partkey").alias("sku_id"), F.concat(F.lit("CAT"), (brand_number("p_brand") % 5).cast("string")).alias("product_category"),
        F.col("l_quantity").cast("int").alias("quantity_sold"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"),
        (F.col("l_extendedprice") / F.col("l_quantity") * F.col("l_discount")).alias("discount"), (100 * F.col("l_discount")).alias("discount_pct"),
        net_amount().alias("sales_amount"), (price * share).cast("decimal(18,4)").alias("discount_value"),
        F.when(F.col("l_discount") > 0, F.concat(F.lit("Deal "), F.round(100 * F.col("l_discount")).cast("int").cast("string"))).alias("promotion"),
        F.when(F.col("l_discount") > 0, 1).otherwise(0).alias("is_promotion"),
        F.col("o_orderpriority").alias("channel"), F.col("c_mktsegment").alias("customer_segment"),
    )


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of sales that features of customers read, from lines, orders and parts alone.

    As keys of orders and lines occur in the other dimensions, a foreign key's promise, joins with these change nothing and
    are left out.
    """
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    joined = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select(
        F.col("o_orderdate").cast("date").alias("date"), F.col("o_orderkey").alias("transaction_id"), F.col("o_custkey").alias("customer_id"),
        F.concat(F.lit("CAT"), (brand_number("p_brand") % 5).cast("string")).alias("product_category"), F.col("l_quantity").cast("int").alias("quantity_sold"),
        (100 * F.col("l_discount")).alias("discount_pct"), net_amount().alias("sales_amount"), F.when(F.col("l_discount") > 0, 1).otherwise(0).alias("is_promotion"), F.col("o_orderpriority").alias("channel"),
    )


def with_calendar(frame: DataFrame) -> DataFrame:
    """Adds the calendar columns of the contract to sales."""
    day = F.col("date")
    return frame.select(
        "*", weekday_name(day).alias("weekday"), F.when(F.weekday(day) >= 5, 1).otherwise(0).alias("is_weekend"),
        F.date_format(day, "yyyy-MM").alias("year_month"), F.weekofyear(day).alias("week_of_year"), F.concat(F.lit("Q"), F.quarter(day).cast("string")).alias("quarter"),
    )


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dense weekly panel of stores and brands. Stock columns are a fixed surrogate: the schema holds no stock."""
    first, end = span(spark, sf_dir)
    within = sales(spark, sf_dir).where((F.col("date") >= F.lit(first).cast("date")) & (F.col("date") < F.lit(end).cast("date")))
    weekly = within.groupBy("store_id", "product_id", monday(F.col("date")).alias("week_start_date")).agg(
        F.sum("quantity_sold").alias("units"), F.sum("sales_amount").alias("amount"), F.max("is_promotion").alias("promo")
    )
    # the weekly sums are few, and both sides of the grid and every reader of the panel want them: the joins run once
    dense = dense_grid(cut(weekly), ["store_id", "product_id"], "week_start_date", first, end)
    number = brand_number("product_id")
    stock = ((F.col("store_id") * 7 + number * 3 + (F.datediff("week_start_date", F.lit(first).cast("date")) / 7).cast("int")) % 20).cast("int")
    return dense.select(
        "store_id", "product_id", F.concat(F.lit("CAT"), (number % 5).cast("string")).alias("product_category"), "week_start_date", F.year("week_start_date").alias("year"),
        F.coalesce("units", F.lit(0)).cast("long").alias("units_sold"), F.coalesce("amount", F.lit(0)).cast("decimal(18,4)").alias("revenue"),
        F.when(F.col("units") > 0, F.col("amount").cast("double") / F.col("units")).otherwise(0.0).alias("avg_unit_price"), F.coalesce("promo", F.lit(0)).alias("is_promo_week"),
        stock.alias("on_hand_end"), F.when(stock == 0, 1).otherwise(0).alias("stockout_count"),
    )
