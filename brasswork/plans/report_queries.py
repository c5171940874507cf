"""Registered queries of descriptions, short lists and statistical checks, each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import functions as F

from brasswork.operators import checks as K
from brasswork.operators import describe as E
from brasswork.operators import drift as D
from brasswork.operators import lookups as L
from brasswork.operators import quality as Q
from brasswork.operators import rollup as R
from brasswork.operators import windows as W
from brasswork.operators import forecast as P
from brasswork.operators import inventory as I  # noqa: E741
from brasswork.plans.panel_queries import _CR, _METRICS, _SERIES, DATES, _orders, _poisson_sql, _snaps, _weekly_total, snapshots
from brasswork.plans.registry import register
from brasswork.plans.rollup_queries import PANEL, WITH
from brasswork.sources.star import panel, sales, table, with_calendar

_WEEKS = f"{WITH}, wk AS (SELECT CAST(date_trunc('week', date) AS DATE) AS week, CAST(sum(sales_amount) AS DOUBLE) AS revenue FROM sales GROUP BY 1)"
register("weekly_spread", lambda s, d: E.spread(R.weekly_revenue(sales(s, d)), "revenue"), f"{_WEEKS} SELECT min(revenue) AS least, round(median(revenue), 6) AS median, round(avg(revenue), 6) AS mean, max(revenue) AS most FROM wk")
register("top_products", lambda s, d: E.top_by_revenue(sales(s, d), "product_id"), f"{WITH} SELECT product_id, CAST(sum(sales_amount) AS DOUBLE) AS revenue, CAST(sum(quantity_sold) AS BIGINT) AS units FROM sales GROUP BY 1 ORDER BY revenue DESC, 1 LIMIT 10")
_NUMBERS = ("l_quantity", "l_extendedprice", "l_discount")
register("describe_lines", lambda s, d: E.describe(table(s, d, "lineitem"), _NUMBERS), " UNION ALL ".join(f"SELECT '{c}' AS column, count(x) AS n, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, min(x) AS least, round(quantile_cont(x, 0.25), 6) AS q25, round(quantile_cont(x, 0.5), 6) AS q50, round(quantile_cont(x, 0.75), 6) AS q75, max(x) AS most FROM (SELECT CAST({c} AS DOUBLE) AS x FROM lineitem)" for c in _NUMBERS))
register("priority_movers", lambda s, d: E.movers(D.share_table(_orders(s, d), "o_orderpriority"), 3).select("value", F.round("shift", 8).alias("shift")), """WITH y AS (SELECT *, CASE WHEN year(o_orderdate) = 1999 THEN 'reference' ELSE 'current' END AS period FROM orders WHERE year(o_orderdate) IN (1999, 2000)),
g AS (SELECT o_orderpriority AS value, CAST(count(*) FILTER (period = 'reference') AS DOUBLE) AS r, CAST(count(*) FILTER (period = 'current') AS DOUBLE) AS c FROM y GROUP BY 1), h AS (SELECT value, c / sum(c) OVER () - r / sum(r) OVER () AS shift FROM g)
SELECT value, round(shift, 8) AS shift FROM h ORDER BY round(abs(h.shift), 12) DESC, value LIMIT 3""")
register("common_sources", lambda s, d: E.most_common(table(s, d, "documents"), "source", 5), "SELECT source AS value, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, 1 NULLS FIRST LIMIT 5")
register("share_leaders", lambda s, d: L.leaders_share(sales(s, d).groupBy("region").agg(F.sum("sales_amount").cast("double").alias("revenue")), "revenue").select(F.round("share", 8).alias("share")), f"{WITH}, g AS (SELECT CAST(sum(sales_amount) AS DOUBLE) AS v FROM sales GROUP BY region), t AS (SELECT v FROM g ORDER BY v DESC LIMIT 2) SELECT round((SELECT sum(v) FROM t) / (SELECT sum(v) FROM g), 8) AS share")
register("latest_snapshot", lambda s, d: E.latest(snapshots(s, d)).select("customer_id", "snapshot_date"), f"{WITH}, {_snaps(DATES[-1:])} SELECT DISTINCT s.customer_id, p.snapshot_date FROM sales s JOIN snaps p ON s.date <= p.snapshot_date")
register("basket_products", lambda s, d: E.basket_products(sales(s, d)).select("transaction_id", F.array_join("products", ",").alias("products"), F.col("n").cast("long").alias("n")), f"{WITH}, g AS (SELECT transaction_id, list_sort(list_distinct(list(product_id))) AS p FROM sales GROUP BY 1) SELECT transaction_id, array_to_string(p, ',') AS products, CAST(len(p) AS BIGINT) AS n FROM g WHERE len(p) >= 2")
register("panel_columns", lambda s, d: E.to_columns(panel(s, d), ["store_id", "product_id", "week_start_date"], ["units_sold", "not_there"]), f"{PANEL} SELECT store_id, product_id, week_start_date, CAST(units_sold AS DOUBLE) AS units_sold, 0.0::DOUBLE AS not_there FROM panel")

#: SQL of the rules that the star view can break.
_RULES = {
    "sales_amount": "abs(sales_amount - quantity_sold * (unit_price - discount)) > 0.011", "discount_over_price": "discount > unit_price + 1e-9",
    "is_promotion": "is_promotion <> CASE WHEN promotion IS NULL THEN 0 ELSE 1 END", "discount_without_promotion": "promotion IS NULL AND discount <> 0", "negative_quantity": "quantity_sold < 0",
    "weekday": "false", "is_weekend": "false", "year_month": "false", "week_of_year": "false", "quarter": "false",
}
register("sales_rule_breaches", lambda s, d: Q.breaches(with_calendar(sales(s, d)), {k: v for k, v in Q.sales_rules().items() if k in _RULES}), f"{WITH} SELECT " + ", ".join(f"count(*) FILTER ({sql}) AS {name}" for name, sql in _RULES.items()) + " FROM sales")
register("weekday_balance", lambda s, d: Q.weekday_balance(table(s, d, "orders"), "o_orderdate"), "WITH g AS (SELECT dayname(o_orderdate) AS weekday, count(*) AS rows FROM orders GROUP BY 1), t AS (SELECT sum(rows) AS n FROM g) SELECT weekday, rows, round(CAST(rows AS DOUBLE) / n, 8) AS share, round((rows - n / 7.0::DOUBLE) * (rows - n / 7.0::DOUBLE) / (n / 7.0::DOUBLE), 6) AS chi FROM g, t")
register("weekend_uplift", lambda s, d: Q.weekend_uplift(sales(s, d)), f"{WITH}, g AS (SELECT date, CAST(sum(sales_amount) AS DOUBLE) AS x FROM sales GROUP BY 1), m AS (SELECT round(avg(x) FILTER (isodow(date) >= 6), 4) AS weekend_mean, round(avg(x) FILTER (isodow(date) < 6), 4) AS weekday_mean FROM g) SELECT *, round(weekend_mean / nullif(weekday_mean, 0), 6) AS uplift FROM m")
register("basket_percentiles", lambda s, d: Q.size_percentiles(sales(s, d), "transaction_id"), f"{WITH}, g AS (SELECT count(*) AS n FROM sales GROUP BY transaction_id) SELECT unnest([0.1, 0.5, 0.9, 0.99])::DOUBLE AS quantile, unnest((SELECT quantile_cont(CAST(n AS DOUBLE), [0.1, 0.5, 0.9, 0.99]) FROM g)) AS size")
register("correlations", lambda s, d: Q.correlation(table(s, d, "lineitem"), [("l_quantity", "l_extendedprice"), ("l_discount", "l_quantity")]), "SELECT unnest(['l_quantity', 'l_discount']) AS left, unnest(['l_extendedprice', 'l_quantity']) AS right, unnest([round(corr(l_quantity, l_extendedprice), 6), round(corr(l_discount, l_quantity), 6)]) AS r FROM lineitem")
register("outliers", lambda s, d: Q.outlier_counts(table(s, d, "orders"), ["o_totalprice"]), "WITH q AS (SELECT quantile_cont(CAST(o_totalprice AS DOUBLE), 0.25) AS a, quantile_cont(CAST(o_totalprice AS DOUBLE), 0.75) AS b FROM orders), f AS (SELECT a - 1.5 * (b - a) AS low, b + 1.5 * (b - a) AS high FROM q) SELECT 'o_totalprice' AS column, round(low, 6) AS low, round(high, 6) AS high, count(*) FILTER (o_totalprice < low OR o_totalprice > high) AS outliers FROM orders, f GROUP BY ALL")
register("orphan_orders", lambda s, d: Q.orphans(table(s, d, "events"), "user_id", table(s, d, "customer"), "c_custkey"), "SELECT count(*) AS rows, count(DISTINCT user_id) AS keys FROM events WHERE user_id IS NOT NULL AND user_id NOT IN (SELECT c_custkey FROM customer)")
register("summary", lambda s, d: E.summary(sales(s, d)), f"{WITH} SELECT count(*) AS lines, min(date) AS first_day, max(date) AS last_day, count(DISTINCT transaction_id) AS transactions, count(DISTINCT customer_id) AS customers, count(DISTINCT store_id) AS stores, count(DISTINCT product_id) AS products, CAST(sum(quantity_sold) AS BIGINT) AS units, CAST(sum(sales_amount) AS DOUBLE) AS revenue FROM sales")
register("event_properties", lambda s, d: E.json_field(table(s, d, "events"), "props", "k long").groupBy("event_type").agg(F.sum("k").alias("total"), F.count("k").alias("n")), "SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total, count(json_extract_string(props, '$.k')) AS n FROM events GROUP BY 1")
register("regions_as_json", lambda s, d: E.as_json(table(s, d, "region").select("r_regionkey", "r_name")), "SELECT '{\"r_regionkey\":' || r_regionkey || ',\"r_name\":\"' || r_name || '\"}' AS json FROM region")
register("bound_filter", lambda s, d: L.filtered(table(s, d, "orders"), "o_orderstatus = :status AND o_totalprice >= :least", {"status": "F", "least": 1000.0}).groupBy("o_orderpriority").agg(F.count("*").alias("n")), "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 1000 GROUP BY 1")
register("rank_by_spend", lambda s, d: W.global_rank(sales(s, d).groupBy("customer_id").agg(F.sum("sales_amount").cast("double").alias("spend")), "spend", "customer_id", "rank"), f"{WITH}, g AS (SELECT customer_id, CAST(sum(sales_amount) AS DOUBLE) AS spend FROM sales GROUP BY 1) SELECT *, row_number() OVER (ORDER BY spend, customer_id) AS rank FROM g")

_CHECKS = f"""{WITH}, d AS (SELECT date AS day, count(*) AS lines, sum(quantity_sold) AS units, sum(is_promotion) AS promo FROM sales GROUP BY 1),
wk AS (SELECT avg(units) FILTER (isodow(day) = 6) / avg(units) FILTER (isodow(day) = 1) AS sat, avg(units) FILTER (isodow(day) = 7) / avg(units) FILTER (isodow(day) = 1) AS sun FROM d),
mo AS (SELECT date_trunc('month', day) AS m, avg(units) AS mean FROM d GROUP BY 1), yr AS (SELECT max(mean) / min(mean) AS peak, avg(mean) FILTER (month(m) IN (10, 11)) / avg(mean) FILTER (month(m) IN (5, 6, 7)) AS festive FROM mo),
cd AS (SELECT *, promo >= 0.95 * lines AS campaign FROM d), cs AS (SELECT avg(promo / lines) FILTER (campaign) / avg(promo / lines) FILTER (NOT campaign) AS share FROM cd),
cw AS (SELECT avg(units) FILTER (campaign) / avg(units) FILTER (NOT campaign) AS x FROM cd GROUP BY isodow(day)), cl AS (SELECT avg(x) AS lift FROM cw),
mx AS (SELECT month(date) AS m, product_category AS c, sum(quantity_sold) AS u FROM sales GROUP BY ALL), sh AS (SELECT c, u / sum(u) OVER (PARTITION BY m) AS share FROM mx), sw AS (SELECT max(x) AS swing FROM (SELECT max(share) / min(share) AS x FROM sh GROUP BY c)),
bs AS (SELECT count(*) AS size FROM sales GROUP BY transaction_id), hs AS (SELECT size, count(*) AS n FROM bs GROUP BY 1), tp AS (SELECT size AS mode FROM hs ORDER BY n DESC, size LIMIT 1),
hr AS (SELECT unnest(range((SELECT mode FROM tp), (SELECT max(size) FROM hs) + 1)) AS place), hd AS (SELECT place, coalesce(n, 0) AS n FROM hr LEFT JOIN hs ON hs.size = place),
hl AS (SELECT *, min(n) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS low FROM hd), va AS (SELECT greatest(0, coalesce(max(1 - low / n) FILTER (n >= 0.005 * (SELECT count(*) FROM bs) AND place > (SELECT mode FROM tp)), 0)) AS valley FROM hl),
bt AS (SELECT quantile_cont(CAST(size AS DOUBLE), 0.99) / quantile_cont(CAST(size AS DOUBLE), 0.9) AS tail, count(*) FILTER (size = 1) / count(*) AS single FROM bs),
cu AS (SELECT count(DISTINCT transaction_id) AS k FROM sales GROUP BY customer_id), rc AS (SELECT count(*) FILTER (k > 1) / count(*) AS repeat, median(CAST(k AS DOUBLE)) AS middle FROM cu),
pk AS (SELECT {", ".join(f"4 * count(*) FILTER (quantity_sold = {p}) / nullif(count(*) FILTER (quantity_sold IN ({p - 2}, {p - 1}, {p + 1}, {p + 2})), 0) AS p{p}" for p in K.PACKS)}, count(*) FILTER (quantity_sold = 0) / count(*) AS lost FROM sales),
v AS (SELECT unnest([{", ".join(f"'{k}'" for k in K.BOUNDS)}]) AS measure, unnest([{", ".join(f"{b}::DOUBLE" for b in K.BOUNDS.values())}]) AS bound,
  unnest([round(sat, 6), round(sun, 6), round(peak, 6), round(festive, 6), round(share, 6), round(lift, 6), round(swing, 6), round(valley, 6), round(tail, 6), round(single, 6), round(p6, 6), round(p12, 6), round(p24, 6), round(lost, 6), round(repeat, 6), middle]) AS value FROM wk, yr, cs, cl, sw, va, bt, rc, pk)
SELECT measure, value, bound, CASE WHEN measure = 'lost_lines' THEN value > bound ELSE value >= bound END AS holds FROM v"""
register("statistical_checks", lambda s, d: K.statistical_checks(sales(s, d), F.col("promo") >= 0.95 * F.col("lines")), _CHECKS)

_SIMPLE_TOTAL = f"""{_SERIES}, h AS (SELECT unnest([1, 2, 4]) AS horizon), e AS (SELECT *, max(t) OVER () AS last FROM w), b AS (SELECT horizon, avg(y) FILTER (t > last - horizon - 4 AND t <= last - horizon) AS recent_mean, max(y) FILTER (t = last - horizon) AS last_value FROM e, h GROUP BY ALL),
p AS (SELECT b.horizon, e.y, s.y AS seasonal_naive, b.last_value, b.recent_mean FROM e JOIN b ON e.t > e.last - b.horizon JOIN w s ON s.t = e.t - 52),
j AS (SELECT horizon, y, 'seasonal_naive' AS model, seasonal_naive AS f FROM p UNION ALL SELECT horizon, y, 'last_value', last_value FROM p UNION ALL SELECT horizon, y, 'recent_mean', recent_mean FROM p), scores AS (SELECT model, horizon, {_METRICS} FROM j GROUP BY ALL)"""


def _chosen(s, d):
    chosen = s.createDataFrame([(1, "recent_mean")], "horizon int, model string")
    return L.chosen_or_best(P.simple_holdout(_weekly_total(s, d)), chosen).select("horizon", "model", "wape")


register("chosen_or_best", _chosen, f"{_SIMPLE_TOTAL} SELECT horizon, model, wape FROM scores QUALIFY CASE WHEN horizon = 1 THEN model = 'recent_mean' ELSE row_number() OVER (PARTITION BY horizon ORDER BY wape, model) = 1 END")


def _aligned(s, d):
    """Weeks beside their seasonal naive forecast, and forecasts of weeks to come."""
    series = _weekly_total(s, d).select("t", "y")
    return L.aligned(series, series.select((F.col("t") + 52).alias("t"), F.col("y").alias("f")), "t")


register("aligned_forecast", _aligned, f"{_SERIES} SELECT CAST(coalesce(a.t, b.t) AS INT) AS t, a.y, b.y AS f FROM w a FULL JOIN (SELECT t + 52 AS t, y FROM w) b ON a.t = b.t")
register("poisson_safety", lambda s, d: I.poisson_safety_stock(panel(s, d).groupBy("store_id", "product_category").agg(F.round(F.avg("units_sold"), 8).alias("mean")), "mean", _CR), f"{PANEL}, g AS (SELECT store_id, product_category, round(avg(units_sold), 8) AS mean FROM panel GROUP BY 1, 2) SELECT store_id, product_category, mean, target, round(greatest(target - mean, 0), 6) AS safety FROM g JOIN {_poisson_sql('g', 'store_id, product_category', 'mean')} t USING (store_id, product_category)")
_CONTRACT = ("date", "customer_id", "store_id", "quantity_sold", "unit_price", "discount", "promotion", "sales_amount")


def _contract(s, d):
    lines = sales(s, d).select(*_CONTRACT, "is_promotion", "channel")
    rules = {k: v for k, v in Q.sales_rules().items() if k in ("sales_amount", "discount_over_price", "negative_quantity")}
    return Q.contract_rows(lines, _CONTRACT, rules)


register("contract_report", _contract, f"{WITH} SELECT unnest(['rows', 'further is_promotion', 'further channel', {', '.join(f"'null {c}'" for c in _CONTRACT if c != 'promotion')}, 'sales_amount', 'discount_over_price', 'negative_quantity']) AS finding, unnest([count(*), 0, 0, {', '.join(f'count(*) FILTER ({c} IS NULL)' for c in _CONTRACT if c != 'promotion')}, {', '.join(f'count(*) FILTER ({_RULES[k]})' for k in ('sales_amount', 'discount_over_price', 'negative_quantity'))}]) AS rows, unnest([TRUE, FALSE, FALSE, {', '.join(f'count(*) FILTER ({c} IS NULL) = 0' for c in _CONTRACT if c != 'promotion')}, {', '.join(f'count(*) FILTER ({_RULES[k]}) = 0' for k in ('sales_amount', 'discount_over_price', 'negative_quantity'))}]) AS holds FROM sales")
