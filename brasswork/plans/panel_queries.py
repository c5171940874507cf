"""Registered queries of windows, features, quality, metrics, drift, forecasts and inventory."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from brasswork.functions import metrics as M
from brasswork.functions.dates import month_ends
from brasswork.functions.numbers import grouped_rupees, normal_quantile, price_band
from brasswork.operators import boosting as B
from brasswork.operators import churn as C
from brasswork.operators import density as E
from brasswork.operators import drift as D
from brasswork.operators import features as X
from brasswork.operators import forecast as P
from brasswork.operators import inventory as I  # noqa: E741
from brasswork.operators import quality as Q
from brasswork.operators import rollup as R
from brasswork.operators import segmentation as S
from brasswork.operators import trees as T
from brasswork.operators import windows as W
from brasswork.plans.registry import register
from brasswork.plans.rollup_queries import PANEL, WITH
from brasswork.session import cut
from brasswork.sources.star import END_MONDAY, FIRST_MONDAY, panel, purchases, sales, span, table

DATES = month_ends("2000-08-01", "2001-04-30")


def _snaps(dates):
    return "snaps AS (SELECT unnest([" + ", ".join(f"DATE '{d}'" for d in dates) + "]) AS snapshot_date)"


_DATES_SQL = _snaps(DATES)
_IN = "date >= snapshot_date - 89"
_RFM = f"""seen AS (SELECT s.*, p.snapshot_date FROM sales s JOIN snaps p ON s.date <= p.snapshot_date),
rfm AS (SELECT snapshot_date, customer_id, min(date) AS first_purchase, max(date) AS last_purchase, count(DISTINCT transaction_id) FILTER ({_IN}) AS frequency, CAST(sum(sales_amount) FILTER ({_IN}) AS DOUBLE) AS monetary,
  CAST(sum(quantity_sold) FILTER ({_IN}) AS BIGINT) AS units, count(*) FILTER ({_IN}) AS lines, nullif(count(DISTINCT product_category) FILTER ({_IN}), 0) AS categories,
  CAST(sum(is_promotion) FILTER ({_IN}) AS DOUBLE) / nullif(count(*) FILTER ({_IN}), 0) AS promo_share, round(avg(discount_pct) FILTER ({_IN}), 6) AS mean_discount_pct,
  CAST(count(*) FILTER ({_IN} AND channel IN ('1-URGENT', '2-HIGH')) AS DOUBLE) / nullif(count(*) FILTER ({_IN}), 0) AS online_share, CAST(snapshot_date - max(date) AS INT) AS recency_days, CAST(snapshot_date - min(date) AS INT) AS tenure_days,
  CAST(sum(quantity_sold) FILTER ({_IN}) AS DOUBLE) / nullif(count(*) FILTER ({_IN}), 0) AS units_per_line, CAST(sum(sales_amount) FILTER ({_IN}) AS DOUBLE) / nullif(count(DISTINCT transaction_id) FILTER ({_IN}), 0) AS avg_basket_value, snapshot_date AS feature_as_of
  FROM seen GROUP BY snapshot_date, customer_id)"""
_CHURN = f"""buyers AS (SELECT DISTINCT p.snapshot_date, s.customer_id FROM sales s JOIN snaps p ON s.date > p.snapshot_date AND s.date <= p.snapshot_date + 90),
labelled AS (SELECT r.*, CASE WHEN b.customer_id IS NULL THEN 1 ELSE 0 END AS churn FROM rfm r LEFT JOIN buyers b USING (snapshot_date, customer_id))"""


def snapshots(s, d):
    return X.churn_snapshots(purchases(s, d), DATES)


register("rfm_features", lambda s, d: X.rfm_features(sales(s, d), DATES[:1]), f"{WITH}, {_snaps(DATES[:1])}, {_RFM} SELECT * FROM rfm")
register("rfm_features_active", lambda s, d: X.rfm_features(sales(s, d), DATES[:1], include_unconverted=False), f"{WITH}, {_snaps(DATES[:1])}, {_RFM} SELECT * FROM rfm WHERE lines > 0")
register("churn_snapshots", snapshots, f"{WITH}, {_DATES_SQL}, {_RFM}, {_CHURN} SELECT * FROM labelled")
register("churn_rates", lambda s, d: C.churn_rates(snapshots(s, d)), f"{WITH}, {_DATES_SQL}, {_RFM}, {_CHURN} SELECT snapshot_date, count(*) AS customers, CAST(sum(churn) AS DOUBLE) / count(*) AS churn_rate FROM labelled GROUP BY 1")
register("leakage_rows", lambda s, d: X.leaks(snapshots(s, d)).agg(F.count("*").alias("n")), "SELECT CAST(0 AS BIGINT) AS n")
register("temporal_split", lambda s, d: C.temporal_split(snapshots(s, d))[1].groupBy("snapshot_date").agg(F.count("*").alias("n")), f"{WITH}, {_DATES_SQL}, {_RFM} SELECT snapshot_date, count(*) AS n FROM rfm WHERE snapshot_date IN (SELECT snapshot_date FROM snaps ORDER BY 1 DESC LIMIT 3) GROUP BY 1")
_SCORED = f"{WITH}, {_DATES_SQL}, {_RFM}, {_CHURN}"
register("ranking_metrics", lambda s, d: M.ranking_metrics(_recency_scored(s, d), "churn_score", "churn", "customer_id"), f"""{_SCORED}, o AS (SELECT churn, row_number() OVER (ORDER BY recency_days DESC, customer_id) AS r, count(*) OVER () AS n FROM labelled WHERE snapshot_date = DATE '{DATES[-1]}'),
t AS (SELECT max(n) AS n, CAST(sum(churn) AS BIGINT) AS positives, CAST(greatest(1, round_even(0.2 * max(n), 0)) AS BIGINT) AS n_top FROM o), h AS (SELECT sum(churn) AS hits FROM o, t WHERE r <= n_top)
SELECT n, positives, n_top, CAST(hits AS DOUBLE) / n_top AS precision_at_k, CAST(hits AS DOUBLE) / positives AS recall_at_k, (CAST(hits AS DOUBLE) / n_top) / (CAST(positives AS DOUBLE) / n) AS lift_at_k FROM t, h""")
register("curve_metrics", lambda s, d: M.curve_metrics(_recency_scored(s, d), "churn_score", "churn"), f"""{_SCORED}, g AS (SELECT recency_days AS score, count(*) AS n, sum(churn) AS p FROM labelled WHERE snapshot_date = DATE '{DATES[-1]}' GROUP BY 1),
r AS (SELECT *, sum(n) OVER w AS nu, sum(p) OVER w AS pu, sum(n) OVER () AS a, sum(p) OVER () AS pos FROM g WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING))
SELECT round(sum(p * ((a - pos) - (nu - pu) + (n - p) / 2.0)) / CAST(max(pos * (a - pos)) AS DOUBLE), 8) AS roc_auc, round(sum(CAST(p AS DOUBLE) / pos * CAST(pu AS DOUBLE) / nu), 8) AS average_precision FROM r""")
register("confusion", lambda s, d: M.confusion(_recency_scored(s, d), "churn_score", "churn", 100.0), f"""{_SCORED}, c AS (SELECT CAST(count(*) FILTER (recency_days >= 100 AND churn = 1) AS BIGINT) AS tp, CAST(count(*) FILTER (recency_days >= 100 AND churn = 0) AS BIGINT) AS fp,
  CAST(count(*) FILTER (recency_days < 100 AND churn = 1) AS BIGINT) AS fn, CAST(count(*) FILTER (recency_days < 100 AND churn = 0) AS BIGINT) AS tn FROM labelled WHERE snapshot_date = DATE '{DATES[-1]}') SELECT *, 2.0 * CAST(tp AS DOUBLE) / (2 * tp + fp + fn) AS f1 FROM c""")
register("at_risk", lambda s, d: C.at_risk(_recency_scored(s, d), DATES[-1]).select("customer_id", "churn_score"), f"{_SCORED} SELECT customer_id, CAST(recency_days AS DOUBLE) AS churn_score FROM labelled WHERE snapshot_date = DATE '{DATES[-1]}' QUALIFY row_number() OVER (ORDER BY recency_days DESC, customer_id) <= greatest(1, CAST(floor(0.2 * count(*) OVER ()) AS BIGINT))")


def _recency_scored(s, d):
    """The last snapshot with recency as a score: a model that needs no fit."""
    last = F.col("snapshot_date") == F.lit(DATES[-1])
    return snapshots(s, d).where(last).select("customer_id", "snapshot_date", "churn", F.col("recency_days").cast("double").alias("churn_score"))


register("panel_features", lambda s, d: W.panel_features(panel(s, d)).select("store_id", "product_id", "week_start_date", "lag_1", "lag_2", "lag_4", F.round("mean_4", 8).alias("mean_4"), "max_4", F.round("std_4", 6).alias("std_4"), F.col("series_index").cast("long").alias("series_index"), "zero_demand", "stockout"), f"""{PANEL}
SELECT store_id, product_id, week_start_date, lag(units_sold, 1) OVER s AS lag_1, lag(units_sold, 2) OVER s AS lag_2, lag(units_sold, 4) OVER s AS lag_4, round(avg(units_sold) OVER e, 8) AS mean_4, max(units_sold) OVER e AS max_4, round(stddev_samp(units_sold) OVER e, 6) AS std_4,
  row_number() OVER s - 1 AS series_index, CASE WHEN units_sold = 0 THEN 1 ELSE 0 END AS zero_demand, CASE WHEN stockout_count > 0 THEN 1 ELSE 0 END AS stockout
FROM panel WINDOW s AS (PARTITION BY store_id, product_id ORDER BY week_start_date), e AS (PARTITION BY store_id, product_id ORDER BY week_start_date ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)""")
register("expanding_stats", lambda s, d: W.expanding(_weekly_total(s, d), [], "t", "y").select("t", F.round("past_mean", 6).alias("past_mean"), F.round("past_var", 3).alias("past_var"), "past_rows"), f"""{PANEL}, w AS (SELECT CAST(date_diff('day', {FIRST_MONDAY}, week_start_date) // 7 AS INT) AS t, CAST(sum(units_sold) AS DOUBLE) AS y FROM panel GROUP BY 1)
SELECT t, round(avg(y) OVER e, 6) AS past_mean, round(var_samp(y) OVER e, 3) AS past_var, count(y) OVER e AS past_rows FROM w WINDOW e AS (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
register("last_weeks", lambda s, d: W.last_rows(panel(s, d), ["store_id", "product_id"], "week_start_date", 8).groupBy("store_id", "product_id").agg(F.count("*").alias("n"), F.min("week_start_date").alias("first"), F.sum("units_sold").cast("long").alias("units")), f"""{PANEL},
l AS (SELECT * FROM panel QUALIFY row_number() OVER (PARTITION BY store_id, product_id ORDER BY week_start_date DESC) <= 8) SELECT store_id, product_id, count(*) AS n, min(week_start_date) AS first, CAST(sum(units_sold) AS BIGINT) AS units FROM l GROUP BY 1, 2""")
register("week_gaps", lambda s, d: W.week_gaps(panel(s, d), ["store_id", "product_id"], "week_start_date").agg(F.count("*").alias("n")), "SELECT CAST(0 AS BIGINT) AS n")


def _weekly_total(s, d):
    return P.build_series(panel(s, d))


def _active(s, d):
    return X.rfm_features(purchases(s, d), DATES[-1:], include_unconverted=False)


_ONE = f"{WITH}, {_snaps(DATES[-1:])}, {_RFM}, act AS (SELECT * FROM rfm WHERE lines > 0)"
_QCUT = lambda r: f"1 + CAST(1 + (n - 1) * 0.25 < {r} AS INT) + CAST(1 + (n - 1) * 0.5 < {r} AS INT) + CAST(1 + (n - 1) * 0.75 < {r} AS INT)"
_SEG = "CASE " + " ".join(f"WHEN rq = {r} AND fq = {f} THEN '{n}'" for (r, f), n in W.QUARTILE_SEGMENTS.items()) + " END"
_QUART = f"""{_ONE}, ranked AS (SELECT customer_id, monetary, row_number() OVER (ORDER BY recency_days, customer_id) AS rr, row_number() OVER (ORDER BY frequency, customer_id) AS fr, row_number() OVER (ORDER BY monetary, customer_id) AS mr, count(*) OVER () AS n FROM act),
q AS (SELECT customer_id, monetary, 5 - ({_QCUT('rr')}) AS rq, {_QCUT('fr')} AS fq, {_QCUT('mr')} AS mq FROM ranked)"""
register("rfm_quartiles", lambda s, d: W.quartile_segments(_active(s, d)).select("customer_id", "recency_days_quartile", "frequency_quartile", "monetary_quartile", "segment"), f"{_QUART} SELECT customer_id, CAST(rq AS INT) AS recency_days_quartile, CAST(fq AS INT) AS frequency_quartile, CAST(mq AS INT) AS monetary_quartile, {_SEG} AS segment FROM q")
register("segment_summary", lambda s, d: S.segment_summary(W.quartile_segments(_active(s, d))).select("segment", "customers", "customer_share", "median_recency", "median_frequency"), f"""{_QUART}, g AS (SELECT {_SEG} AS segment, act.* FROM q JOIN act USING (customer_id))
SELECT segment, count(*) AS customers, CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM act) AS customer_share, median(recency_days) AS median_recency, median(frequency) AS median_frequency FROM g GROUP BY 1""")
register("segment_profile", lambda s, d: S.against_population(W.quartile_segments(_active(s, d)), "segment", "At risk", ["recency_days", "frequency", "units", "lines"]), f"""{_QUART}, g AS (SELECT {_SEG} AS segment, act.* FROM q JOIN act USING (customer_id)),
t AS (SELECT segment, unnest(['recency_days', 'frequency', 'units', 'lines']) AS feature, unnest([CAST(recency_days AS DOUBLE), frequency, units, lines]) AS x FROM g)
SELECT feature, round(median(x) FILTER (segment = 'At risk'), 6) AS segment_median, round(median(x), 6) AS population_median FROM t GROUP BY 1""")
register("standardise", lambda s, d: S.standardise(_active(s, d), ["recency_days", "frequency"]).select("customer_id", F.round("z_recency_days", 6).alias("z_recency_days"), F.round("z_frequency", 6).alias("z_frequency")), f"""{_ONE}
SELECT customer_id, round((recency_days - avg(recency_days) OVER ()) / stddev_pop(recency_days) OVER (), 6) AS z_recency_days, coalesce(round((frequency - avg(frequency) OVER ()) / nullif(stddev_pop(frequency) OVER (), 0), 6), 0) AS z_frequency FROM act""")

register("null_counts", lambda s, d: Q.null_counts(table(s, d, "events"), ["event_id", "ts", "user_id", "event_type", "value", "props"]), "SELECT unnest(['event_id', 'ts', 'user_id', 'event_type', 'value', 'props']) AS column, unnest([count(*) - count(event_id), count(*) - count(ts), count(*) - count(user_id), count(*) - count(event_type), count(*) - count(value), count(*) - count(props)]) AS nulls FROM events")
register("duplicate_lines", lambda s, d: Q.duplicates(table(s, d, "lineitem"), ["l_orderkey", "l_linenumber"]), "SELECT count(*) AS repeated_keys, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS extra_rows FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)")
register("exact_duplicates", lambda s, d: Q.duplicates(table(s, d, "documents").select("text", "lang", "source")), "SELECT count(*) AS repeated_keys, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS extra_rows FROM (SELECT count(*) AS n FROM documents GROUP BY text, lang, source HAVING count(*) > 1)")
register("store_region_dependency", lambda s, d: Q.dependency_breaches(sales(s, d), ["store_id"], "region"), f"{WITH} SELECT count(*) AS broken_keys FROM (SELECT store_id FROM sales GROUP BY 1 HAVING count(DISTINCT region) > 1)")
register("transaction_dependency", lambda s, d: Q.dependency_breaches(sales(s, d), ["transaction_id"], "store_id"), f"{WITH} SELECT count(*) AS broken_keys FROM (SELECT transaction_id FROM sales GROUP BY 1 HAVING count(DISTINCT store_id) > 1)")
register("text_audit", lambda s, d: Q.text_audit(table(s, d, "documents"), ["text", "lang", "source"]), "SELECT unnest(['text', 'lang', 'source']) AS column, unnest([count(*) FILTER (trim(text) = ''), count(*) FILTER (trim(lang) = ''), count(*) FILTER (trim(source) = '')]) AS empty, unnest([count(*) FILTER (text <> trim(text)), count(*) FILTER (lang <> trim(lang)), count(*) FILTER (source <> trim(source))]) AS padded, unnest([count(*) FILTER (lower(trim(text)) IN ('', 'na', 'n/a', 'nan', 'null', 'none', '-', '?')), count(*) FILTER (lower(trim(lang)) IN ('', 'na', 'n/a', 'nan', 'null', 'none', '-', '?')), count(*) FILTER (lower(trim(source)) IN ('', 'na', 'n/a', 'nan', 'null', 'none', '-', '?'))]) AS null_like FROM documents")
register("calendar_gaps", lambda s, d: Q.calendar_gaps(sales(s, d).select("date"), "date"), f"{WITH}, b AS (SELECT min(date) AS a, max(date) AS z FROM sales) SELECT CAST(x AS DATE) AS missing_day FROM (SELECT unnest(generate_series(a, z, INTERVAL 1 DAY)) AS x FROM b) WHERE CAST(x AS DATE) NOT IN (SELECT date FROM sales)")
register("numeric_sanity", lambda s, d: Q.numeric_sanity(table(s, d, "lineitem"), ["l_quantity", "l_discount"]), "SELECT unnest(['l_quantity', 'l_discount']) AS column, unnest([min(l_quantity), min(l_discount)]) AS least, unnest([max(l_quantity), max(l_discount)]) AS most, unnest([round(quantile_cont(CAST(l_quantity AS DOUBLE), 0.5), 6), round(quantile_cont(CAST(l_discount AS DOUBLE), 0.5), 6)]) AS p50, unnest([round(quantile_cont(CAST(l_quantity AS DOUBLE), 0.99), 6), round(quantile_cont(CAST(l_discount AS DOUBLE), 0.99), 6)]) AS p99, unnest([count(*) FILTER (l_quantity < 0), count(*) FILTER (l_discount < 0)]) AS negative, unnest([count(*) FILTER (l_quantity = 0), count(*) FILTER (l_discount = 0)]) AS zero, unnest([0::BIGINT, 0::BIGINT]) AS not_finite FROM lineitem")
register("profile_customer", lambda s, d: Q.profile(table(s, d, "customer")).select("column", "nulls", "distinct"), "SELECT unnest(['c_custkey', 'c_name', 'c_nationkey', 'c_acctbal', 'c_mktsegment']) AS column, unnest([count(*) - count(c_custkey), count(*) - count(c_name), count(*) - count(c_nationkey), count(*) - count(c_acctbal), count(*) - count(c_mktsegment)]) AS nulls, unnest([count(DISTINCT c_custkey), count(DISTINCT c_name), count(DISTINCT c_nationkey), count(DISTINCT c_acctbal), count(DISTINCT c_mktsegment)]) AS distinct FROM customer")
register("reconcile_panel", lambda s, d: Q.reconcile(panel(s, d), sales(s, d), *span(s, d)), f"{WITH} SELECT CASE WHEN date < {FIRST_MONDAY} OR date >= {END_MONDAY} THEN 'partial week' WHEN quantity_sold = 0 THEN 'lost demand' ELSE 'in panel' END AS bucket, count(*) AS lines, CAST(sum(quantity_sold) AS BIGINT) AS units FROM sales GROUP BY 1")
register("panel_rule_breaches", lambda s, d: Q.breaches(panel(s, d), Q.panel_rules()), "SELECT CAST(0 AS BIGINT) AS negative_measure, CAST(0 AS BIGINT) AS week_start, CAST(0 AS BIGINT) AS revenue_in_zero_week, CAST(0 AS BIGINT) AS selling_week_without_revenue")
register("price_bands", lambda s, d: sales(s, d).groupBy(price_band(F.col("unit_price")).alias("band")).agg(F.count("*").alias("n")), f"{WITH} SELECT CASE WHEN unit_price < 299 THEN 'Budget' WHEN unit_price < 1000 THEN 'Mid' WHEN unit_price < 5000 THEN 'Premium' ELSE 'Luxury' END AS band, count(*) AS n FROM sales GROUP BY 1")
register("grouped_rupees", lambda s, d: table(s, d, "customer").select("c_custkey", grouped_rupees(F.floor(F.col("c_acctbal") * 1000)).alias("spelled")), r"""
SELECT c_custkey, CASE WHEN v < 0 THEN '-' ELSE '' END || CASE WHEN length(w) > 3 THEN reverse(rtrim(regexp_replace(reverse(w[:-4]), '(\d\d)', '\1,', 'g'), ',')) || ',' || right(w, 3) ELSE w END AS spelled
FROM (SELECT c_custkey, CAST(floor(c_acctbal * 1000) AS BIGINT) AS v, CAST(abs(CAST(floor(c_acctbal * 1000) AS BIGINT)) AS VARCHAR) AS w FROM customer)""")

_YEARS = "y AS (SELECT *, CASE WHEN year = 1999 THEN 'reference' ELSE 'current' END AS period FROM panel WHERE year IN (1999, 2000))"


def _both(s, d):
    return D.split_periods(panel(s, d), 1999, 2000)


def _orders(s, d):
    return D.split_periods(table(s, d, "orders").withColumn("year", F.year("o_orderdate")), 1999, 2000)


_O = "y AS (SELECT *, CASE WHEN year(o_orderdate) = 1999 THEN 'reference' ELSE 'current' END AS period FROM orders WHERE year(o_orderdate) IN (1999, 2000))"
_PSI = f"""WITH {_O}, e AS (SELECT list_distinct(quantile_cont(o_totalprice, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])) AS edges FROM y WHERE period = 'reference'),
b AS (SELECT period, CASE WHEN o_totalprice = list_min(edges) THEN 1 ELSE len(list_filter(edges, lambda q: q < o_totalprice)) END AS bucket FROM y, e WHERE o_totalprice BETWEEN list_min(edges) AND list_max(edges)),
c AS (SELECT bucket, CAST(count(*) FILTER (period = 'reference') AS DOUBLE) AS r, CAST(count(*) FILTER (period = 'current') AS DOUBLE) AS c FROM b GROUP BY 1),
s AS (SELECT greatest(r / sum(r) OVER (), 1e-6) AS r, greatest(c / sum(c) OVER (), 1e-6) AS c FROM c)
SELECT 'o_totalprice' AS feature, round(sum((c - r) * ln(c / r)), 6) AS psi FROM s"""
register("psi", lambda s, d: D.psi(_orders(s, d), ["o_totalprice"]), _PSI)
register("category_shift", lambda s, d: D.share_table(_orders(s, d), "o_orderpriority"), f"WITH {_O}, g AS (SELECT o_orderpriority AS value, CAST(count(*) FILTER (period = 'reference') AS DOUBLE) AS r, CAST(count(*) FILTER (period = 'current') AS DOUBLE) AS c FROM y GROUP BY 1) SELECT value, r / (SELECT sum(r) FROM g) AS reference, c / (SELECT sum(c) FROM g) AS current, c / (SELECT sum(c) FROM g) - r / (SELECT sum(r) FROM g) AS shift FROM g")
register("category_distance", lambda s, d: D.category_shift(_orders(s, d), "o_orderstatus").select("feature", "distance", "values"), f"WITH {_O}, g AS (SELECT o_orderstatus AS value, CAST(count(*) FILTER (period = 'reference') AS DOUBLE) AS r, CAST(count(*) FILTER (period = 'current') AS DOUBLE) AS c FROM y GROUP BY 1) SELECT 'o_orderstatus' AS feature, round(sum(abs(c / (SELECT sum(c) FROM g) - r / (SELECT sum(r) FROM g))) / 2, 6) AS distance, count(*) AS values FROM g")
register("category_mix", lambda s, d: D.category_mix(_both(s, d), "product_category", "units_sold").select("value", "reference", "current"), f"{PANEL}, {_YEARS}, g AS (SELECT product_category AS value, CAST(sum(units_sold) FILTER (period = 'reference') AS DOUBLE) AS r, CAST(sum(units_sold) FILTER (period = 'current') AS DOUBLE) AS c FROM y GROUP BY 1) SELECT value, r / (SELECT sum(r) FROM g) AS reference, c / (SELECT sum(c) FROM g) AS current FROM g")
_VERDICT = lambda x: f"CASE WHEN {x} IS NULL THEN 'insufficient data' WHEN {x} >= 0.2 THEN 'significant' WHEN {x} >= 0.1 THEN 'moderate' ELSE 'stable' END"
_TENTHS = ", ".join(str(i / 10) for i in range(11))


def _drift_sql(numeric, categorical):
    """CTEs that end in `drift`: the rows of a report of the panel's two years."""
    tall = " UNION ALL ".join(f"SELECT '{c}' AS feature, period, CAST({c} AS DOUBLE) AS x FROM y" for c in numeric)
    words = " UNION ALL ".join(f"SELECT '{c}' AS feature, period, CAST({c} AS VARCHAR) AS value FROM y" for c in categorical)
    return f"""{PANEL}, {_YEARS}, tall AS ({tall}), words AS ({words}),
e AS (SELECT feature, list_distinct(quantile_cont(x, [{_TENTHS}])) AS edges FROM tall WHERE period = 'reference' GROUP BY 1),
b AS (SELECT feature, period, CASE WHEN x = list_min(edges) THEN 1 ELSE len(list_filter(edges, lambda q: q < x)) END AS bucket FROM tall JOIN e USING (feature) WHERE x BETWEEN list_min(edges) AND list_max(edges)),
k AS (SELECT feature, bucket, CAST(count(*) FILTER (period = 'reference') AS DOUBLE) AS r, CAST(count(*) FILTER (period = 'current') AS DOUBLE) AS c FROM b GROUP BY 1, 2),
f AS (SELECT feature, greatest(r / sum(r) OVER w, 1e-6) AS r, greatest(c / sum(c) OVER w, 1e-6) AS c FROM k WINDOW w AS (PARTITION BY feature)),
i AS (SELECT feature, round(sum((c - r) * ln(c / r)), 6) AS psi FROM f GROUP BY 1),
m AS (SELECT feature, {", ".join(f"round({fn}(x) FILTER (period = '{p}'), 6) AS {n}_{p}" for fn, n in (("avg", "mean"), ("median", "median")) for p in ("reference", "current"))} FROM tall GROUP BY 1),
g AS (SELECT feature, value, CAST(count(*) FILTER (period = 'reference') AS DOUBLE) AS r, CAST(count(*) FILTER (period = 'current') AS DOUBLE) AS c FROM words GROUP BY 1, 2),
h AS (SELECT feature, value, abs(c / sum(c) OVER w - r / sum(r) OVER w) AS moved FROM g WINDOW w AS (PARTITION BY feature)),
v AS (SELECT feature, round(sum(moved) / 2, 6) AS distance, count(*) AS values FROM h GROUP BY 1),
u AS (SELECT feature, value AS largest_mover FROM h QUALIFY row_number() OVER (PARTITION BY feature ORDER BY round(moved, 12) DESC, value) = 1),
drift AS (SELECT feature, psi, mean_reference, mean_current, median_reference, median_current, {_VERDICT('psi')} AS verdict, NULL::DOUBLE AS distance, NULL::VARCHAR AS largest_mover, NULL::BIGINT AS values FROM i JOIN m USING (feature)
  UNION ALL SELECT feature, NULL, NULL, NULL, NULL, NULL, {_VERDICT('distance')}, distance, largest_mover, values FROM v JOIN u USING (feature))"""


register("drift_report", lambda s, d: D.report(_both(s, d), ["units_sold", "on_hand_end"], ["product_category", "store_id"]), f"{_drift_sql(['units_sold', 'on_hand_end'], ['product_category', 'store_id'])} SELECT * FROM drift")
register("drift_overall", lambda s, d: D.overall(D.report(_both(s, d), ["units_sold", "on_hand_end"], ["product_category"])), f"{_drift_sql(['units_sold', 'on_hand_end'], ['product_category'])}, moved AS (SELECT feature FROM drift WHERE verdict IN ('moderate', 'significant')) SELECT CASE WHEN count(*) > 0 THEN 'drift detected' ELSE 'stable' END AS verdict, coalesce(string_agg(feature, ',' ORDER BY feature), '') AS drifted FROM moved")

_SERIES = f"{PANEL}, w AS (SELECT CAST(date_diff('day', {FIRST_MONDAY}, week_start_date) // 7 AS INT) AS t, CAST(sum(units_sold) AS DOUBLE) AS y FROM panel GROUP BY 1)"
register("series_total", lambda s, d: P.build_series(panel(s, d)).select("t", "y"), f"{_SERIES} SELECT * FROM w")
register("series_category", lambda s, d: P.build_series(panel(s, d), "category"), f"{PANEL} SELECT product_category, week_start_date, CAST(date_diff('day', {FIRST_MONDAY}, week_start_date) // 7 AS INT) AS t, CAST(sum(units_sold) AS DOUBLE) AS y FROM panel GROUP BY ALL")
register("series_weights", lambda s, d: P.series_weights(panel(s, d), "store"), f"{PANEL} SELECT store_id, CAST(sum(units_sold) AS DOUBLE) AS units, CAST(sum(units_sold) AS DOUBLE) / (SELECT CAST(sum(units_sold) AS DOUBLE) FROM panel) AS share FROM panel GROUP BY 1")
_METRICS = "round(sum(abs(y - f)) / nullif(sum(abs(y)), 0), 6) AS wape, round(avg(CASE WHEN y > 0 THEN abs(y - f) / y END), 6) AS mape_nonzero, round(avg(CASE WHEN abs(y) + abs(f) > 0 THEN 2 * abs(y - f) / (abs(y) + abs(f)) END), 6) AS smape, round(avg(abs(y - f)), 6) AS mae, round(sqrt(avg((y - f) * (y - f))), 6) AS rmse, round(avg(y - f), 6) AS bias, count(*) AS n, CAST(count(*) FILTER (y <> 0) AS BIGINT) AS n_nonzero"
register("naive_holdout", lambda s, d: P.naive_holdout(_weekly_total(s, d)), f"{_SERIES}, j AS (SELECT h AS horizon, a.y, b.y AS f FROM w a JOIN w b ON b.t = a.t - 52, (SELECT unnest([1, 2, 4]) AS h) WHERE a.t > (SELECT max(t) FROM w) - h) SELECT horizon, {_METRICS} FROM j GROUP BY 1")
register("naive_holdout_by_store", lambda s, d: P.naive_holdout(P.build_series(panel(s, d), "store"), ["store_id"]), f"{PANEL}, w AS (SELECT store_id, CAST(date_diff('day', {FIRST_MONDAY}, week_start_date) // 7 AS INT) AS t, CAST(sum(units_sold) AS DOUBLE) AS y FROM panel GROUP BY 1, 2), j AS (SELECT a.store_id, h AS horizon, a.y, b.y AS f FROM w a JOIN w b ON b.t = a.t - 52 AND a.store_id = b.store_id, (SELECT unnest([1, 2, 4]) AS h) WHERE a.t > (SELECT max(t) FROM w) - h) SELECT store_id, horizon, {_METRICS} FROM j GROUP BY 1, 2")
register("seasonal_scale", lambda s, d: M.seasonal_scale(_weekly_total(s, d), "t", "y", 52).select(F.round("scale", 6).alias("scale")), f"{_SERIES} SELECT round(avg(abs(a.y - b.y)), 6) AS scale FROM w a JOIN w b ON b.t = a.t - 52")
_SIMPLE = f"""{PANEL}, w AS (SELECT store_id, CAST(date_diff('day', {FIRST_MONDAY}, week_start_date) // 7 AS INT) AS t, CAST(sum(units_sold) AS DOUBLE) AS y FROM panel GROUP BY ALL),
e AS (SELECT *, max(t) OVER (PARTITION BY store_id) AS last FROM w), h AS (SELECT unnest([1, 2, 4]) AS horizon),
b AS (SELECT store_id, horizon, avg(y) FILTER (t > last - horizon - 4 AND t <= last - horizon) AS recent_mean, max(y) FILTER (t = last - horizon) AS last_value FROM e, h GROUP BY ALL),
p AS (SELECT e.store_id, b.horizon, e.y, s.y AS seasonal_naive, b.last_value, b.recent_mean FROM e JOIN b ON b.store_id = e.store_id AND e.t > e.last - b.horizon JOIN e s ON s.store_id = e.store_id AND s.t = e.t - 52),
j AS (SELECT store_id, horizon, y, 'seasonal_naive' AS model, seasonal_naive AS f FROM p UNION ALL SELECT store_id, horizon, y, 'last_value', last_value FROM p UNION ALL SELECT store_id, horizon, y, 'recent_mean', recent_mean FROM p),
scores AS (SELECT store_id, model, horizon, {_METRICS} FROM j GROUP BY ALL)"""
_INVERTED = f"""{_SIMPLE}, inv AS (SELECT a.store_id, a.horizon AS short, c.horizon AS long, a.model AS better_short, b.model AS better_long, round(b.wape - a.wape, 6) AS gap_short, round(c.wape - d.wape, 6) AS gap_long
FROM scores a JOIN scores b ON a.store_id = b.store_id AND a.horizon = b.horizon AND a.wape < b.wape JOIN scores c ON c.store_id = a.store_id AND c.model = a.model JOIN scores d ON d.store_id = a.store_id AND d.model = b.model AND d.horizon = c.horizon AND d.wape < c.wape WHERE a.horizon < c.horizon)"""


def _simple_scores(s, d):
    return P.simple_holdout(P.build_series(panel(s, d), "store"), ["store_id"])


register("simple_holdout", _simple_scores, f"{_SIMPLE} SELECT * FROM scores")
register("ranking_inversions", lambda s, d: P.ranking_inversions(_simple_scores(s, d), ["store_id"]), f"{_INVERTED} SELECT * FROM inv")
register("rankings_agree", lambda s, d: P.rankings_agree(_simple_scores(s, d), ["store_id"]), f"{_INVERTED} SELECT s.store_id, count(inv.store_id) AS inversions, count(inv.store_id) > 0 AS inverted FROM (SELECT DISTINCT store_id FROM scores) s LEFT JOIN inv USING (store_id) GROUP BY 1")
register("forecast_backtest", lambda s, d: P.backtest(_weekly_total(s, d)))
register("forecast_selection", lambda s, d: P.select_models(P.backtest(_weekly_total(s, d))))
register("naive_by_store_part", lambda s, d: P.reconcile_down(_next_week(s, d).select("forecast"), P.series_weights(panel(s, d), "store")).select("store_id", "share", "forecast", "part"), f"{_SERIES}, v AS (SELECT store_id, CAST(sum(units_sold) AS DOUBLE) / (SELECT CAST(sum(units_sold) AS DOUBLE) FROM panel) AS share FROM panel GROUP BY 1) SELECT store_id, share, y AS forecast, y * share AS part FROM v, w WHERE t = (SELECT max(t) - 51 FROM w)")
register("model_matrix_wape", lambda s, d: P.backtest(_weekly_total(s, d)).groupBy("model").pivot("horizon", [1, 2, 4]).agg(F.first("wape")))


def _paths(s, d):
    series = _weekly_total(s, d)
    return P.forecast_paths(series, P.select_models(P.backtest(series)))


register("forecast_paths", _paths)

_PAIRS = f"""{PANEL}, last8 AS (SELECT * FROM panel QUALIFY row_number() OVER (PARTITION BY store_id, product_id ORDER BY week_start_date DESC) <= 8),
st AS (SELECT store_id, product_id, round(avg(units_sold), 8) AS recent_mean, round(coalesce(stddev_samp(units_sold), 0), 8) AS recent_std FROM last8 GROUP BY 1, 2),
sh AS (SELECT store_id, product_id, CAST(sum(units_sold) AS DOUBLE) / (SELECT CAST(sum(units_sold) AS DOUBLE) FROM panel) AS share FROM panel GROUP BY 1, 2),
pd AS (SELECT sh.store_id, sh.product_id, share, share * 10000.0::DOUBLE AS mean, recent_mean, recent_std FROM sh JOIN st USING (store_id, product_id)),
oh AS (SELECT store_id, product_id, avg(on_hand_end) AS on_hand FROM panel WHERE week_start_date = (SELECT max(week_start_date) FROM panel) GROUP BY 1, 2)"""
register("pair_demand", lambda s, d: I.pair_demand(panel(s, d), 10_000.0), f"{_PAIRS} SELECT * FROM pd")
register("last_on_hand", lambda s, d: I.last_on_hand(panel(s, d)), f"{_PAIRS} SELECT * FROM oh")
register("mean_price", lambda s, d: I.mean_price(panel(s, d)).select("store_id", "product_id", F.round("mean_price", 3).alias("mean_price"), F.round("mean_selling_price", 3).alias("mean_selling_price")), f"{PANEL} SELECT store_id, product_id, round(round(avg(avg_unit_price), 6), 3) AS mean_price, round(round(avg(avg_unit_price) FILTER (units_sold > 0), 6), 3) AS mean_selling_price FROM panel GROUP BY 1, 2")
_Z = normal_quantile(I.critical_ratio(1.0))
register("normal_reorder", lambda s, d: I.reorder_plan(panel(s, d), 10_000.0).select("store_id", "product_id", F.round("normal_point", 6).alias("normal_point"), F.round("normal_order", 6).alias("normal_order"), "on_hand"), f"{_PAIRS} SELECT pd.store_id, pd.product_id, round(mean + {_Z!r}::DOUBLE * recent_std, 6) AS normal_point, round(greatest(mean + {_Z!r}::DOUBLE * recent_std - on_hand, 0), 6) AS normal_order, on_hand FROM pd JOIN oh USING (store_id, product_id)")
_CR = I.critical_ratio(1.0)


def _poisson_sql(rows, keys, mean):
    """The least k whose cumulative probability reaches the critical ratio, by keys of `rows`; terms are taken in log space."""
    return f"""(SELECT {keys}, min(k) AS target FROM (SELECT {keys}, k, sum(exp(-m + k * ln(m) - lgamma(k + 1.0::DOUBLE))) OVER (PARTITION BY {keys} ORDER BY k) AS reached
  FROM (SELECT {keys}, m, unnest(generate_series(CAST(greatest(0, floor(m - 12 * sqrt(m) - 20)) AS BIGINT), CAST(ceil(m + 12 * sqrt(m) + 40) AS BIGINT))) AS k FROM (SELECT {keys}, greatest({mean}, 1e-9) AS m FROM {rows}))) WHERE reached >= {_CR!r}::DOUBLE GROUP BY {keys})"""


def _plan_sql(pairs):
    return f"""{pairs}, mp AS (SELECT store_id, product_id, round(avg(avg_unit_price), 6) AS mean_price FROM panel GROUP BY 1, 2),
plan AS (SELECT store_id, product_id, share, mean, recent_std, on_hand, mean_price, mean + {_Z!r}::DOUBLE * recent_std AS normal_point, greatest(mean + {_Z!r}::DOUBLE * recent_std - on_hand, 0) AS normal_order,
  target, greatest(target - mean, 0) AS safety, greatest(target - on_hand, 0) AS order_units, on_hand < target AS reorder
  FROM pd JOIN oh USING (store_id, product_id) JOIN mp USING (store_id, product_id) JOIN {_poisson_sql('pd', 'store_id, product_id', 'mean')} tg USING (store_id, product_id))"""


_PLAN = _plan_sql(_PAIRS)
_PLAN_DIGITS = {"share": 8, "mean": 6, "recent_std": 6, "mean_price": 3, "normal_point": 6, "normal_order": 6, "safety": 6}
_PLAN_COLUMNS = "store_id product_id share mean recent_std on_hand mean_price normal_point normal_order target safety order_units reorder".split()
_PLAN_SELECT = ", ".join(f"round({c}, {_PLAN_DIGITS[c]}) AS {c}" if c in _PLAN_DIGITS else c for c in _PLAN_COLUMNS)


def _plan(s, d, forecast=10_000.0):
    return I.reorder_plan(panel(s, d), forecast)


def _shown(plan):
    return plan.select(*[F.round(c, _PLAN_DIGITS[c]).alias(c) if c in _PLAN_DIGITS else c for c in _PLAN_COLUMNS])


def _next_week(s, d, whole=None):
    """The seasonal naive path of the pooled weeks, one week ahead: a forecast that SQL can say too."""
    series = P.build_series(panel(s, d) if whole is None else whole)
    last = series.agg(F.max("t").alias("last"))
    return series.join(F.broadcast(last), F.col("t") == F.col("last") - 51, "left_semi").select(F.lit(1).alias("horizon"), F.lit(1).alias("weeks_ahead"), F.col("y").alias("forecast"))


def _plan_of_forecast(s, d):
    """Forecast and plan from one panel, so that its joins run once."""
    whole = panel(s, d)
    return I.reorder_plan(whole, I.first_week(_next_week(s, d, whole)))


register("reorder_plan", lambda s, d: _shown(_plan(s, d)), f"{_PLAN} SELECT {_PLAN_SELECT} FROM plan")
register("reorder_from_forecast", lambda s, d: _shown(_plan_of_forecast(s, d)), f"{_plan_sql(_PAIRS.replace('share * 10000.0::DOUBLE', 'share * (SELECT CAST(sum(units_sold) AS DOUBLE) FROM panel WHERE week_start_date = (SELECT max(week_start_date) FROM panel) - 357)'))} SELECT {_PLAN_SELECT} FROM plan")
register("reorder_summary", lambda s, d: I.plan_summary(_plan(s, d)), f"{_PLAN} SELECT count(*) AS pairs, CAST(count(*) FILTER (reorder) AS BIGINT) AS reorder_pairs, round(sum(order_units) FILTER (reorder), 4) AS order_units, round(sum(order_units * mean_price * {I.COST!r}) FILTER (reorder), 2) AS order_value, {_CR!r}::DOUBLE AS critical_ratio FROM plan")
register("reorder_largest", lambda s, d: I.largest_orders(_plan(s, d)).select("store_id", "product_id", "target", "order_units"), f"{_PLAN} SELECT store_id, product_id, target, order_units FROM plan WHERE reorder ORDER BY order_units DESC, 1, 2 LIMIT 10")
register("reorder_by_store", lambda s, d: I.by_store(_plan(s, d)), f"{_PLAN} SELECT store_id, count(*) AS pairs, round(sum(order_units), 4) AS order_units FROM plan WHERE reorder GROUP BY 1")
_REPLAY = f"""{PANEL}, wk AS (SELECT week_start_date, CAST(sum(units_sold) AS DOUBLE) AS actual, count(*) FILTER (stockout_count > 0) AS censored FROM panel GROUP BY 1),
t AS (SELECT *, avg(actual) OVER (ORDER BY week_start_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm, row_number() OVER (ORDER BY week_start_date) AS place, count(*) OVER () AS n FROM wk),
h AS (SELECT *, round(censored * pm / (SELECT count(*) FROM (SELECT DISTINCT store_id, product_id FROM panel)), 4) AS unmet FROM t WHERE place > greatest(n - 13, 8))"""
register("inventory_replay_mean", lambda s, d: I.replay(panel(s, d)).where("policy = 'mean'").select("week_start_date", "forecast_units", F.round("unmet_units", 3).alias("unmet_units"), F.col("censored_pairs").cast("long").alias("censored_pairs"), F.round("overstock_units", 3).alias("overstock_units"), F.round("understock_units", 3).alias("understock_units")), f"{_REPLAY} SELECT week_start_date, round(pm, 4) AS forecast_units, round(unmet, 3) AS unmet_units, CAST(censored AS BIGINT) AS censored_pairs, round(round(greatest(pm - (actual + unmet), 0), 4), 3) AS overstock_units, round(round(greatest(actual + unmet - pm, 0), 4), 3) AS understock_units FROM h")
_POLICIES = f"""{_REPLAY.replace('AS pm,', 'AS pm, stddev_samp(actual) OVER (ORDER BY week_start_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ps,')},
held AS (SELECT h.*, greatest(target - greatest(pm, 1e-9), 0) AS poisson, {_Z!r}::DOUBLE * coalesce(ps, 0) AS normal FROM h JOIN {_poisson_sql('h', 'week_start_date', 'pm')} tg USING (week_start_date)),
every AS (SELECT *, 'mean' AS policy, 0.0::DOUBLE AS safety FROM held UNION ALL SELECT *, 'normal', normal FROM held UNION ALL SELECT *, 'poisson', poisson FROM held),
replayed AS (SELECT week_start_date, policy, round(pm, 4) AS forecast_units, round(safety, 4) AS safety_stock, actual, CAST(censored AS BIGINT) AS censored_pairs, unmet AS unmet_units,
  round(greatest(pm + safety - (actual + unmet), 0), 4) AS overstock_units, round(greatest(actual + unmet - (pm + safety), 0), 4) AS understock_units, round(pm + safety, 4) AS cover_units FROM every),
errors AS (SELECT policy, sum(overstock_units + understock_units) AS error FROM replayed GROUP BY 1)"""
_REPLAY_DIGITS = {"safety_stock": 3, "unmet_units": 3, "overstock_units": 3, "understock_units": 3, "cover_units": 3}
_REPLAY_COLUMNS = "week_start_date policy forecast_units safety_stock actual censored_pairs unmet_units overstock_units understock_units cover_units".split()
register("inventory_replay", lambda s, d: I.replay(panel(s, d)).select(*[F.round(c, _REPLAY_DIGITS[c]).alias(c) if c in _REPLAY_DIGITS else c for c in _REPLAY_COLUMNS]), f"{_POLICIES} SELECT {', '.join(f'round({c}, {_REPLAY_DIGITS[c]}) AS {c}' if c in _REPLAY_DIGITS else c for c in _REPLAY_COLUMNS)} FROM replayed")
register("replay_reduction", lambda s, d: I.error_reduction(I.replay(panel(s, d))), f"{_POLICIES}, b AS (SELECT error AS base FROM errors WHERE policy = 'mean'), r AS (SELECT policy, round(error, 2) AS error, CASE WHEN base = 0 THEN 0.0 ELSE round(100 * (base - errors.error) / nullif(base, 0), 2) END AS reduction_pct FROM errors, b) SELECT *, reduction_pct BETWEEN 25 AND 40 AS meets_target FROM r")
register("replay_policy_totals", lambda s, d: I.policy_totals(I.replay(panel(s, d))), f"{_POLICIES} SELECT policy, round(sum(overstock_units), 2) AS overstock, round(sum(understock_units), 2) AS understock, count(*) AS weeks FROM replayed GROUP BY 1")
_NAMED = """b AS (SELECT quantile_cont(monetary, 0.7) AS spend_high, quantile_cont(monetary, 0.3) AS spend_low, quantile_cont(frequency, 0.7) AS often, quantile_cont(frequency, 0.3) AS seldom, coalesce(median(monetary / frequency) FILTER (frequency > 0), 0) AS usual FROM k),
g AS (SELECT cluster, count(*) AS customers, median(recency_days) AS recency, median(frequency) AS visits, median(monetary) AS spend, avg(online_share) AS online_share, avg(promo_share) AS promo_share, avg(promo_share) AS p FROM k GROUP BY 1),
n AS (SELECT g.*, CASE WHEN recency >= 180 THEN CASE WHEN spend >= spend_low THEN 'Lapsed high value' ELSE 'Dormant' END WHEN recency >= 60 THEN CASE WHEN spend >= spend_low THEN 'At risk loyal' ELSE 'At risk' END
  WHEN spend >= spend_high AND visits >= often THEN 'Champions' WHEN spend <= spend_low AND visits <= seldom THEN 'One and done' WHEN spend / greatest(visits, 1) >= 1.5 * usual THEN 'Bulk buyers'
  WHEN visits >= often THEN CASE WHEN p > 0 THEN 'Loyal discount seekers' ELSE 'Frequent small baskets' END WHEN spend <= spend_low THEN 'Low spend' ELSE 'Occasional buyers' END AS name FROM g, b)"""
_TIED = """u AS (SELECT median(frequency) AS uv, median(promo_share) AS up FROM k),
t AS (SELECT *, count(*) OVER w > 1 AS tied, [max(online_share) OVER w - min(online_share) OVER w, max(promo_share) OVER w - min(promo_share) OVER w, max(visits) OVER w - min(visits) OVER w, max(recency) OVER w - min(recency) OVER w, max(spend) OVER w - min(spend) OVER w] AS widths FROM n WINDOW w AS (PARTITION BY name)),
x AS (SELECT *, list_position(widths, list_max(widths)) AS a, abs(visits - uv) / CASE WHEN abs(uv) > 1e-9 THEN abs(uv) ELSE 1 END AS gv, abs(promo_share - up) / CASE WHEN abs(up) > 1e-9 THEN abs(up) ELSE 1 END AS gp FROM t, u),
y AS (SELECT *, ['online share', 'promo share', 'frequency', 'recency', 'monetary'][a] AS axis_, CASE WHEN online_share >= 0.25 THEN 'online-heavy' WHEN online_share <= 0.1 THEN 'in-store' WHEN promo_share >= 0.25 THEN 'promo-driven' WHEN greatest(gv, gp) <= 0.5 THEN 'mixed'
  WHEN gv >= gp THEN CASE WHEN visits >= uv THEN 'high-frequency' ELSE 'low-frequency' END WHEN promo_share >= up THEN 'promo-driven' ELSE 'rarely-promoted' END AS trait_, [online_share, promo_share, visits, recency, spend][a] AS along FROM x),
z AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY along DESC, cluster) AS r FROM y)"""
register("named_segments", lambda s, d: S.name_segments(_active(s, d).withColumn("cluster", (F.col("customer_id") % 5).cast("int"))).select("cluster", "customers", "recency", "visits", "trait", "axis", "segment"), f"""{_ONE}, k AS (SELECT *, CAST(customer_id % 5 AS INT) AS cluster FROM act), {_NAMED}, {_TIED}
SELECT cluster, customers, recency, visits, CASE WHEN tied THEN trait_ END AS trait, CASE WHEN tied THEN axis_ END AS axis, CASE WHEN tied THEN name || ' (' || trait_ || ', ' || axis_ || ' ' || coalesce(['highest', 'high', 'mid', 'low', 'lowest'][r], '#' || r) || ')' ELSE name END AS segment FROM z""")
register("kmeans_segments", lambda s, d: S.profiles(S.fit_clusters(_active(s, d), k=6), "cluster", ["recency_days", "frequency", "monetary"]))


def _split(s, d):
    return C.temporal_split(cut(snapshots(s, d)))


def _churn_scores(s, d):
    """Metrics of Spark's own boosted trees, fitted on the first snapshots, over the rows of the others."""
    train, test = _split(s, d)
    return cut(C.evaluate(C.score(C.fit_model(train, test=test), test)))


register("churn_model", _churn_scores)


def _boosted(s, d, trees=300):
    train, test = _split(s, d)
    return B.fit_boosted(train, C.MODEL_FEATURES, settings=B.Settings(trees=trees)), test


def _boosted_scores(s, d):
    """The same of trees by gradients and hessians, with shrunk leaves and least hessians."""
    model, test = _boosted(s, d)
    return C.evaluate(T.scored(model, test, ("customer_id", "snapshot_date", "churn")))


register("churn_boosted", _boosted_scores)


def _explained(s, d):
    """The mean absolute contributions over all rows (no customer), and the reasons of the customers of highest score."""
    model, test = _boosted(s, d)
    place = F.row_number().over(Window.orderBy(F.desc("importance"), "feature")).alias("feature_rank")  # a row for each feature
    return C.local_reasons(model, test).unionByName(C.global_importance(model, test).select(place, "feature", F.col("importance").alias("contribution")), allowMissingColumns=True)


register("churn_explanations", _explained)


def _contributions(s, d):
    """Every row's contributions, which add to its log-odds; trees that a test can afford."""
    model, test = _boosted(s, d, 60)
    return C.contributions(model, test)


register("churn_contributions", _contributions)


def _reason_table(s, d):
    """The reasons of every customer of the last snapshot, by the table function."""
    model, test = _boosted(s, d, 60)
    rows = test.where(F.col("snapshot_date") == F.lit(DATES[-1])).select("customer_id", *C.MODEL_FEATURES)
    return T.reason_table(model)(rows.asTable(), F.lit("customer_id"), F.lit(3))


register("churn_reasons", _reason_table)


def _silhouettes(s, d):
    scores = S.silhouettes(_active(s, d))
    chosen = S.select_k(scores)
    return s.createDataFrame([(k, float(v), k == chosen) for k, v in scores.items()], "k int, silhouette double, chosen boolean")


register("silhouettes", _silhouettes)


def _density(s, d):
    """Every customer's density cluster."""
    return E.search(_active(s, d), S.CLUSTER_FEATURES)[1]


register("density_clusters", _density)
register("top_weeks", lambda s, d: R.weekly_revenue(sales(s, d)).orderBy(F.desc("revenue"), "week_start_date").limit(5).select("week_start_date", "revenue"), f"{WITH} SELECT CAST(date_trunc('week', date) AS DATE) AS week_start_date, CAST(sum(sales_amount) AS DOUBLE) AS revenue FROM sales GROUP BY 1 ORDER BY revenue DESC, 1 LIMIT 5")
_SCALE = "sc AS (SELECT avg(abs(a.y - b.y)) AS scale FROM w a JOIN w b ON b.t = a.t - 52 WHERE a.t <= (SELECT max(t) FROM w) - 4)"
_PAIRED = "j AS (SELECT a.y, b.y AS f FROM w a JOIN w b ON b.t = a.t - 52 WHERE a.t > (SELECT max(t) FROM w) - 4)"


def _bundle(s, d):
    """Metrics of the seasonal naive forecast of the last four weeks, scaled by the weeks before them."""
    series = _weekly_total(s, d)
    last = series.agg(F.max("t").alias("last"))
    before = series.select((F.col("t") + 52).alias("t"), F.col("y").alias("f"))
    pairs = series.join(before, "t").join(F.broadcast(last), F.col("t") > F.col("last") - 4, "left_semi")
    training = series.join(F.broadcast(last), F.col("t") <= F.col("last") - 4, "left_semi")
    return M.forecast_bundle(pairs, M.seasonal_scale(training, "t", "y", 52))


register("forecast_bundle", _bundle, f"{_SERIES}, {_SCALE}, {_PAIRED} SELECT {_METRICS}, round(CAST(count(*) FILTER (y <> 0) AS DOUBLE) / count(*), 6) AS nonzero_share, round(avg(abs(y - f)) / (SELECT nullif(scale, 0) FROM sc), 6) AS mase FROM j")
