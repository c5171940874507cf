"""Registered roll-up queries over the star schema, each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import functions as F

from brasswork.operators import rollup as R
from brasswork.plans.registry import register
from brasswork.sources import star
from brasswork.sources.star import END_MONDAY, FIRST_MONDAY, PANEL_SQL, SALES_SQL, SPAN_SQL, sales

WITH = f"WITH {SALES_SQL.strip()},\n{SPAN_SQL.strip()}"
PANEL = f"{WITH},\n{PANEL_SQL.strip()}"
MONDAY = "CAST(date_trunc('week', date) AS DATE)"
WHOLE = f"date >= {FIRST_MONDAY} AND date < {END_MONDAY}"
BRANDS = [f"Brand#{i}" for i in range(1, 26)]


def whole_weeks(spark, sf_dir):
    """Sales of the weeks that the order dates cover wholly."""
    first, end = star.span(spark, sf_dir)
    return R.before(sales(spark, sf_dir), end).where(F.col("date") >= F.lit(first).cast("date"))


register("weekly_revenue", lambda s, d: R.weekly_revenue(whole_weeks(s, d)), f"""{WITH}
SELECT {MONDAY} AS week_start_date, CAST(sum(sales_amount) AS DOUBLE) AS revenue, CAST(sum(quantity_sold) AS BIGINT) AS units,
  count(DISTINCT transaction_id) AS transactions, count(DISTINCT customer_id) AS customers, CAST(sum(sales_amount) AS DOUBLE) / count(DISTINCT transaction_id) AS avg_basket_value
FROM sales WHERE {WHOLE} GROUP BY 1""")

_ROLL = """count(*) AS lines, count(DISTINCT transaction_id) AS transactions, count(DISTINCT customer_id) AS customers, CAST(sum(quantity_sold) AS BIGINT) AS units,
  CAST(sum(sales_amount) AS DOUBLE) AS revenue, CAST(sum(discount_value) AS DOUBLE) AS discount_value, CAST(count(*) FILTER (quantity_sold = 0) AS BIGINT) AS stockout_lines,
  count(DISTINCT date) AS days_covered, CAST(sum(sales_amount) AS DOUBLE) / count(*) AS avg_line_value"""
register("rollup_daily", lambda s, d: R.aggregate(sales(s, d), "daily"), f"{WITH} SELECT date AS period, {_ROLL} FROM sales GROUP BY 1")
_COMPLETE = f"complete AS (SELECT {MONDAY} AS week FROM sales GROUP BY 1 HAVING count(DISTINCT date) = 7)"
register("rollup_weekly_complete", lambda s, d: R.aggregate(sales(s, d), "weekly"), f"{WITH}, {_COMPLETE} SELECT {MONDAY} AS period, {_ROLL} FROM sales WHERE {MONDAY} IN (SELECT week FROM complete) GROUP BY 1")
register("rollup_weekly_by_region", lambda s, d: R.aggregate(sales(s, d), "weekly", ["region"]), f"{WITH}, {_COMPLETE} SELECT {MONDAY} AS period, region, {_ROLL} FROM sales WHERE {MONDAY} IN (SELECT week FROM complete) GROUP BY 1, 2")
register("rollup_weekly_all", lambda s, d: R.aggregate(sales(s, d), "weekly", drop_partial=False), f"{WITH} SELECT {MONDAY} AS period, {_ROLL} FROM sales GROUP BY 1")
register("sku_mix", lambda s, d: R.sku_mix(sales(s, d)), f"""{WITH}
SELECT product_category, product_id, CAST(sum(sales_amount) AS DOUBLE) AS revenue, CAST(sum(quantity_sold) AS BIGINT) AS units, count(*) AS lines, round(avg(unit_price), 6) AS avg_unit_price,
  round(avg(discount_pct), 6) AS avg_discount_pct, CAST(sum(sales_amount) AS DOUBLE) / (SELECT CAST(sum(sales_amount) AS DOUBLE) FROM sales) AS revenue_share
FROM sales GROUP BY 1, 2""")
_MONTHLY = """monthly AS (SELECT product_category, month(date) AS month, CAST(sum(quantity_sold) AS BIGINT) AS units, CAST(sum(sales_amount) AS DOUBLE) AS revenue FROM sales GROUP BY 1, 2),
shares AS (SELECT *, CAST(units AS DOUBLE) / sum(units) OVER (PARTITION BY product_category) AS unit_share FROM monthly),
peaks AS (SELECT * FROM shares QUALIFY row_number() OVER (PARTITION BY product_category ORDER BY unit_share DESC, month) = 1)"""
register("category_seasonality", lambda s, d: R.category_seasonality(sales(s, d)), f"""{WITH}, {_MONTHLY}
SELECT s.product_category, CAST(s.month AS INT) AS month, s.units, s.revenue, s.unit_share, CAST(p.month AS INT) AS peak_month, p.unit_share AS peak_share, p.units AS peak_units, p.revenue AS peak_revenue
FROM shares s JOIN peaks p USING (product_category)""")
register("kpis", lambda s, d: R.kpis(sales(s, d)), f"""{WITH}, k AS (
SELECT CAST(sum(sales_amount) AS DOUBLE) AS revenue, CAST(sum(quantity_sold) AS DOUBLE) AS units, CAST(count(DISTINCT transaction_id) AS DOUBLE) AS transactions, CAST(count(DISTINCT customer_id) AS DOUBLE) AS customers,
  CAST(count(DISTINCT product_id) AS DOUBLE) AS products, CAST(count(DISTINCT store_id) AS DOUBLE) AS stores, CAST(count(*) FILTER (quantity_sold = 0) AS DOUBLE) / count(*) AS zero_line_share,
  (SELECT CAST(count(*) FILTER (n > 1) AS DOUBLE) / count(*) FROM (SELECT count(DISTINCT date) AS n FROM sales GROUP BY customer_id)) AS repeat_rate FROM sales)
UNPIVOT k ON COLUMNS(*) INTO NAME metric VALUE value""")
register("promotion_lift", lambda s, d: R.promotion_lift(sales(s, d)), f"""{WITH}, l AS (
SELECT CAST(count(*) FILTER (is_promotion = 1) AS BIGINT) AS promo_lines, CAST(count(*) FILTER (is_promotion = 0) AS BIGINT) AS plain_lines,
  CAST(sum(quantity_sold) FILTER (is_promotion = 1) AS DOUBLE) / count(*) FILTER (is_promotion = 1) AS promo_units_per_line, CAST(sum(quantity_sold) FILTER (is_promotion = 0) AS DOUBLE) / count(*) FILTER (is_promotion = 0) AS plain_units_per_line,
  CAST(sum(sales_amount) FILTER (is_promotion = 1) AS DOUBLE) / count(*) FILTER (is_promotion = 1) AS promo_revenue_per_line, CAST(sum(sales_amount) FILTER (is_promotion = 0) AS DOUBLE) / count(*) FILTER (is_promotion = 0) AS plain_revenue_per_line,
  round(avg(CAST(sales_amount AS DOUBLE) / nullif(quantity_sold, 0)) FILTER (is_promotion = 1), 4) AS promo_realised_price, round(avg(CAST(sales_amount AS DOUBLE) / nullif(quantity_sold, 0)) FILTER (is_promotion = 0), 4) AS plain_realised_price,
  count(DISTINCT date) FILTER (is_promotion = 1) AS promo_days FROM sales)
SELECT *, promo_units_per_line / plain_units_per_line AS volume_lift, promo_revenue_per_line / plain_revenue_per_line AS value_lift FROM l""")
register("store_product_matrix", lambda s, d: R.store_product_matrix(star.panel(s, d), BRANDS), f"""{PANEL} SELECT store_id, {", ".join(f"CAST(coalesce(sum(units_sold) FILTER (product_id = '{b}'), 0) AS BIGINT) AS \"{b}\"" for b in BRANDS)} FROM panel GROUP BY 1""")
register("top_store_products", lambda s, d: R.top_store_products(star.panel(s, d)), f"{PANEL} SELECT store_id, product_id, CAST(sum(units_sold) AS BIGINT) AS units FROM panel GROUP BY 1, 2 ORDER BY units DESC, store_id, product_id LIMIT 20")
_DIST = """u AS (SELECT store_id, product_id, CAST(sum(units_sold) AS BIGINT) AS units FROM panel GROUP BY 1, 2),
dist AS (SELECT *, row_number() OVER o AS rank, CAST(sum(units) OVER o AS BIGINT) AS cumulative, CAST(CAST(sum(units) OVER o AS BIGINT) AS DOUBLE) / (SELECT sum(units) FROM u) AS value_share,
  CAST(row_number() OVER o AS DOUBLE) / (SELECT count(*) FROM u) AS row_share FROM u WINDOW o AS (ORDER BY units DESC, store_id, product_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""
register("demand_distribution", lambda s, d: R.demand_distribution(star.panel(s, d)), f"{PANEL}, {_DIST} SELECT * FROM dist")
register("concentration", lambda s, d: R.concentration(R.demand_distribution(star.panel(s, d))), f"{PANEL}, {_DIST} SELECT coalesce(max(value_share) FILTER (row_share <= 0.2), min(value_share)) AS head_value_share, count(*) AS \"rows\" FROM dist")


def _sku_units(s, d):
    return sales(s, d).groupBy("sku_id").agg(F.sum("quantity_sold").cast("long").alias("units"))


register("pareto_skus", lambda s, d: R.rows_for_share(R.running_share(_sku_units(s, d), "units", ["sku_id"]), 0.8), f"""{WITH}, u AS (SELECT sku_id, sum(quantity_sold) AS units FROM sales GROUP BY 1),
c AS (SELECT CAST(sum(units) OVER (ORDER BY units DESC, sku_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) / (SELECT sum(units) FROM u) AS share FROM u),
n AS (SELECT count(*) FILTER (share < 0.8) + 1 AS needed, count(*) AS n FROM c)
SELECT CAST(least(needed, n) AS BIGINT) AS rows_needed, n AS "rows", CAST(least(needed, n) AS DOUBLE) / n AS row_share FROM n""")
register("monthly_growth", lambda s, d: R.monthly_growth(sales(s, d)), f"""{WITH}, m AS (SELECT year(date) AS year, month(date) AS month, CAST(sum(sales_amount) AS DOUBLE) AS revenue, CAST(sum(quantity_sold) AS BIGINT) AS units FROM sales GROUP BY 1, 2)
SELECT CAST(a.year AS INT) AS year, CAST(a.month AS INT) AS month, a.revenue, a.units, b.revenue AS last_revenue, a.revenue / b.revenue - 1 AS growth FROM m a LEFT JOIN m b ON a.year = b.year + 1 AND a.month = b.month""")
register("by_place", lambda s, d: R.by_place(sales(s, d)), f"""{WITH}, g AS (SELECT region, city, grouping(region) AS r, sum(sales_amount) AS exact, CAST(sum(quantity_sold) AS BIGINT) AS units, count(DISTINCT transaction_id) AS transactions FROM sales GROUP BY GROUPING SETS ((region), (city)))
SELECT CASE WHEN r = 0 THEN 'region' ELSE 'city' END AS level, coalesce(region, city) AS place, CAST(exact AS DOUBLE) AS revenue, units, transactions, CAST(exact AS DOUBLE) / CAST((SELECT sum(sales_amount) FROM sales) AS DOUBLE) AS revenue_share FROM g""")
register("by_category", lambda s, d: R.by_category(sales(s, d)), f"""{WITH} SELECT product_category, count(*) AS lines, CAST(count(*) FILTER (quantity_sold > 0) AS BIGINT) AS selling_lines, CAST(sum(quantity_sold) AS BIGINT) AS units, CAST(sum(sales_amount) AS DOUBLE) AS revenue, count(DISTINCT sku_id) AS skus,
  CAST(sum(quantity_sold) AS DOUBLE) / count(*) FILTER (quantity_sold > 0) AS units_per_selling_line FROM sales GROUP BY 1""")
register("weekday_lift", lambda s, d: R.weekday_lift(sales(s, d)), f"""{WITH}, daily AS (SELECT date, CAST(sum(quantity_sold) AS BIGINT) AS units, CAST(count(*) FILTER (discount_pct >= 5) AS DOUBLE) / count(*) AS share FROM sales GROUP BY 1),
g AS (SELECT CAST(isodow(date) - 1 AS INT) AS weekday, CAST(sum(units) FILTER (share > 0.5) AS DOUBLE) / nullif(count(*) FILTER (share > 0.5), 0) AS campaign_units, CAST(sum(units) FILTER (NOT share > 0.5) AS DOUBLE) / nullif(count(*) FILTER (NOT share > 0.5), 0) AS plain_units,
  CAST(count(*) FILTER (share > 0.5) AS BIGINT) AS campaign_days, CAST(count(*) FILTER (NOT share > 0.5) AS BIGINT) AS plain_days FROM daily GROUP BY 1)
SELECT *, campaign_units / plain_units AS lift FROM g""")
register("mix_by_month", lambda s, d: R.mix_by_month(sales(s, d)), f"""{WITH}, monthly AS (SELECT product_category, month(date) AS month, sum(quantity_sold) AS units FROM sales GROUP BY 1, 2),
shares AS (SELECT *, CAST(units AS DOUBLE) / sum(units) OVER (PARTITION BY month) AS share FROM monthly),
hi AS (SELECT * FROM shares QUALIFY row_number() OVER (PARTITION BY product_category ORDER BY share DESC, month) = 1), lo AS (SELECT * FROM shares QUALIFY row_number() OVER (PARTITION BY product_category ORDER BY share, month) = 1),
v AS (SELECT product_category, CAST(sum(units) AS BIGINT) AS units, CAST(sum(units) AS DOUBLE) / (SELECT sum(units) FROM monthly) AS volume_share FROM monthly GROUP BY 1)
SELECT v.product_category, v.units, v.volume_share, CAST(hi.month AS INT) AS peak_month, hi.share AS peak_share, CAST(lo.month AS INT) AS trough_month, lo.share AS trough_share, hi.share / lo.share AS swing, v.volume_share < 0.02 AS noisy
FROM v JOIN hi USING (product_category) JOIN lo USING (product_category)""")
register("lost_demand", lambda s, d: R.lost_demand(sales(s, d).withColumn("inventory_level", (F.col("sku_id") % 7).cast("int")).withColumn("quantity_sold", F.when(F.col("sku_id") % 21 == 0, 0).otherwise(F.col("quantity_sold")))), f"""{WITH}
SELECT product_category, count(*) AS lines, CAST(count(*) FILTER (sku_id % 21 = 0) AS BIGINT) AS lost_lines, CAST(count(*) FILTER (sku_id % 7 = 0 AND sku_id % 21 <> 0) AS BIGINT) AS last_unit_lines,
  CAST(count(*) FILTER (sku_id % 21 = 0) AS DOUBLE) / count(*) AS lost_share FROM sales GROUP BY 1""")
register("lost_demand_hotspots", lambda s, d: R.lost_demand_hotspots(star.panel(s, d)), f"""{PANEL} SELECT store_id, product_id, CAST(sum(stockout_count) AS BIGINT) AS stockouts, CAST(sum(units_sold) AS BIGINT) AS units, count(*) AS weeks, CAST(sum(stockout_count) AS DOUBLE) / count(*) AS stockouts_per_week
FROM panel GROUP BY 1, 2 HAVING sum(stockout_count) > 0 ORDER BY stockouts DESC, store_id, product_id LIMIT 10""")
register("basket_sizes", lambda s, d: R.basket_sizes(sales(s, d)), f"""{WITH}, b AS (SELECT count(*) AS size FROM sales GROUP BY transaction_id), o AS (SELECT size, row_number() OVER (ORDER BY size) - 1 AS i, count(*) OVER () AS n FROM b)
SELECT min(size) FILTER (i = n // 2) AS median_lines, max(size) AS max_lines, count(*) AS baskets, CAST(count(*) FILTER (size > 1) AS DOUBLE) / count(*) AS multi_share FROM o""")
register("baskets", lambda s, d: R.baskets(sales(s, d)).select("transaction_id", F.size("lines").cast("long").alias("n"), F.array_join(F.transform("lines", lambda x: F.concat_ws(":", x["sku_id"], x["quantity_sold"])), ",").alias("spelled")), f"""{WITH}
SELECT transaction_id, count(*) AS n, string_agg(sku_id || ':' || quantity_sold, ',' ORDER BY sku_id, quantity_sold, sales_amount) AS spelled FROM sales GROUP BY 1""")
register("facts", lambda s, d: R.facts(sales(s, d)), f"""{WITH} SELECT count(*) AS lines, CAST(sum(quantity_sold) AS BIGINT) AS units, CAST(sum(sales_amount) AS DOUBLE) AS revenue, CAST(sum(discount_value) AS DOUBLE) AS discount_value, count(DISTINCT transaction_id) AS transactions,
  count(DISTINCT customer_id) AS customers, count(DISTINCT sku_id) AS skus, count(DISTINCT store_id) AS stores, count(DISTINCT region) AS regions, min(date) AS first_date, max(date) AS last_date, count(DISTINCT date) AS days,
  CAST(count(*) FILTER (is_promotion = 1) AS BIGINT) AS promoted_lines, CAST(count(*) FILTER (quantity_sold = 0) AS BIGINT) AS lost_lines, max(quantity_sold) AS max_quantity FROM sales""")
register("channel_shares", lambda s, d: R.value_shares(sales(s, d), "channel"), f"{WITH} SELECT channel AS value, count(*) AS n, CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM sales) AS share FROM sales GROUP BY 1")
register("promotion_shares", lambda s, d: R.value_shares(sales(s, d), "promotion"), f"{WITH} SELECT promotion AS value, count(*) AS n, CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM sales) AS share FROM sales GROUP BY 1")
register("calendar_columns", lambda s, d: star.with_calendar(sales(s, d)).groupBy("weekday", "is_weekend", "year_month", "week_of_year", "quarter").agg(F.count("*").alias("n")), f"""{WITH}
SELECT dayname(date) AS weekday, CASE WHEN isodow(date) >= 6 THEN 1 ELSE 0 END AS is_weekend, strftime(date, '%Y-%m') AS year_month, CAST(weekofyear(date) AS INT) AS week_of_year, 'Q' || quarter(date) AS quarter, count(*) AS n FROM sales GROUP BY ALL""")
register("panel_dense", lambda s, d: star.panel(s, d).groupBy("store_id", "year").agg(F.count("*").alias("cells"), F.sum("units_sold").cast("long").alias("units"), F.sum("revenue").cast("double").alias("revenue"), F.sum((F.col("units_sold") == 0).cast("int")).cast("long").alias("zero_cells")), f"""{PANEL}
SELECT store_id, year, count(*) AS cells, CAST(sum(units_sold) AS BIGINT) AS units, CAST(sum(revenue) AS DOUBLE) AS revenue, CAST(count(*) FILTER (units_sold = 0) AS BIGINT) AS zero_cells FROM panel GROUP BY 1, 2""")
