"""Registered queries of dimension joins, set operations and audits."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from brasswork.operators import drift as D
from brasswork.operators import lookups as L
from brasswork.operators import rollup as R
from brasswork.plans.registry import register
from brasswork.plans.rollup_queries import PANEL, WITH
from brasswork.sources.star import panel, sales, table

CAMPAIGNS = [("spring", dt.date(1999, 3, 1), dt.date(1999, 4, 15)), ("easter", dt.date(1999, 4, 1), dt.date(1999, 4, 10)), ("autumn", dt.date(1999, 10, 1), dt.date(1999, 10, 31))]
HOLIDAYS = [(dt.date(y, 12, 25), "Christmas") for y in range(1995, 2001)] + [(dt.date(y, 1, 1), "New Year") for y in range(1996, 2002)]
_CAMPAIGNS = "(VALUES " + ", ".join(f"('{n}', DATE '{a}', DATE '{b}')" for n, a, b in CAMPAIGNS) + ") c(campaign, low, high)"
_HOLIDAYS = "(VALUES " + ", ".join(f"(DATE '{d}', '{n}')" for d, n in HOLIDAYS) + ") h(day, holiday)"

register("campaign_lines", lambda s, d: L.in_campaigns(sales(s, d), CAMPAIGNS).groupBy("campaign").agg(F.count("*").alias("lines"), F.sum("quantity_sold").cast("long").alias("units")), f"""{WITH}
SELECT campaign, count(*) AS lines, CAST(sum(quantity_sold) AS BIGINT) AS units FROM sales LEFT JOIN {_CAMPAIGNS} ON date BETWEEN low AND high GROUP BY 1""")
register("holiday_lines", lambda s, d: L.with_holidays(sales(s, d), HOLIDAYS).groupBy("holiday", "is_holiday").agg(F.count("*").alias("lines")), f"""{WITH}
SELECT holiday, CASE WHEN holiday IS NULL THEN 0 ELSE 1 END AS is_holiday, count(*) AS lines FROM sales LEFT JOIN {_HOLIDAYS} ON date = day GROUP BY 1, 2""")
register("repurchase", lambda s, d: L.purchased(sales(s, d).where("date < DATE '1998-01-01'").select("customer_id").distinct(), sales(s, d).where("date >= DATE '1998-01-01'")).groupBy("bought").agg(F.count("*").alias("customers")), f"""{WITH},
a AS (SELECT DISTINCT customer_id FROM sales WHERE date < DATE '1998-01-01'), b AS (SELECT DISTINCT customer_id FROM sales WHERE date >= DATE '1998-01-01')
SELECT b.customer_id IS NOT NULL AS bought, count(*) AS customers FROM a LEFT JOIN b USING (customer_id) GROUP BY 1""")
register("customers_without_orders", lambda s, d: L.missing_from(table(s, d, "customer").withColumnRenamed("c_custkey", "customer_id"), sales(s, d), "customer_id"), f"{WITH} SELECT c_custkey AS customer_id FROM customer WHERE c_custkey NOT IN (SELECT customer_id FROM sales)")
register("target_audit", lambda s, d: L.target_audit(R.kpis(sales(s, d)), [("products", 25.0), ("stores", 25.0), ("absent", 1.0)]), f"""{WITH}, k AS (SELECT 'products' AS metric, CAST(count(DISTINCT product_id) AS DOUBLE) AS value FROM sales UNION ALL SELECT 'stores', CAST(count(DISTINCT store_id) AS DOUBLE) FROM sales)
SELECT metric, expected, value, coalesce(value = expected, FALSE) AS meets FROM (VALUES ('products', 25.0::DOUBLE), ('stores', 25.0::DOUBLE), ('absent', 1.0::DOUBLE)) w(metric, expected) LEFT JOIN k USING (metric)""")
register("largest_movers", lambda s, d: L.largest_movers(D.share_table(D.split_periods(panel(s, d), 1999, 2000), "product_category", "units_sold")), f"""{PANEL},
g AS (SELECT product_category AS value, CAST(sum(units_sold) FILTER (year = 1999) AS DOUBLE) AS r, CAST(sum(units_sold) FILTER (year = 2000) AS DOUBLE) AS c FROM panel WHERE year IN (1999, 2000) GROUP BY 1),
m AS (SELECT value, c / (SELECT sum(c) FROM g) - r / (SELECT sum(r) FROM g) AS shift FROM g)
SELECT * FROM (SELECT 'up' AS direction, value, shift FROM m WHERE shift > 0 ORDER BY shift DESC, value LIMIT 1) UNION ALL SELECT * FROM (SELECT 'down' AS direction, value, shift FROM m WHERE shift < 0 ORDER BY shift, value LIMIT 1)""")
register("leaders_share", lambda s, d: L.leaders_share(R.by_category(sales(s, d)), "units"), f"{WITH}, g AS (SELECT sum(quantity_sold) AS u FROM sales GROUP BY product_category) SELECT CAST((SELECT sum(u) FROM (SELECT u FROM g ORDER BY u DESC LIMIT 2)) AS DOUBLE) / (SELECT sum(u) FROM g) AS share")
register("season_dummies", lambda s, d: L.season_dummies(panel(s, d).select("week_start_date").distinct()).agg(*[F.sum(f"week_{i}").cast("long").alias(f"week_{i}") for i in (1, 26, 52, 53)]), f"{PANEL} SELECT {', '.join(f'CAST(count(*) FILTER (weekofyear(week_start_date) = {i}) AS BIGINT) AS week_{i}' for i in (1, 26, 52, 53))} FROM weeks")
