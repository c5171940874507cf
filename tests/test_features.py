"""The point-in-time rules on a small sales table, by hand."""

import datetime as dt

import pytest

from brasswork.operators import features as X
from brasswork.operators import quality as Q
from brasswork.operators import rollup as R

LINES = [
    ("2025-01-05", "ALIVE", "A1", 2, 500.0, 0.0, None, "Web", "Grocery"),
    ("2025-01-20", "ALIVE", "A2", 4, 500.0, 100.0, "Weekend_Flash", "Web", "Beverages"),
    ("2025-04-10", "ALIVE", "A3", 1, 500.0, 0.0, None, "Store", "Grocery"),
    ("2025-01-06", "DORMANT", "D1", 3, 200.0, 0.0, None, "Store", "Grocery"),
    ("2025-01-25", "DORMANT", "D2", 1, 200.0, 0.0, None, "Store", "Bakery"),
    ("2025-02-10", "NEW", "N1", 5, 100.0, 0.0, None, "Store", "Grocery"),
    ("2025-11-05", "LATER", "L1", 2, 300.0, 0.0, None, "Store", "Grocery"),
    ("2025-12-20", "LATER", "L2", 6, 300.0, 0.0, None, "Store", "Bakery"),
]
COLUMNS = "date customer_id transaction_id quantity_sold unit_price discount promotion channel product_category".split()
DAY = dt.date(2025, 1, 31)


@pytest.fixture(scope="module")
def lines(spark):
    rows = [(dt.date.fromisoformat(r[0]), *r[1:], r[3] * (r[4] - r[5]), int(r[6] is not None), 100 * r[5] / r[4]) for r in LINES]
    schema = "date date, customer_id string, transaction_id string, quantity_sold int, unit_price double, discount double, promotion string, channel string, product_category string, sales_amount double, is_promotion int, discount_pct double"
    return spark.createDataFrame(rows, schema)


def by_customer(frame):
    return {r["customer_id"]: r for r in frame.collect()}


def test_features_up_to_the_snapshot(lines):
    found = by_customer(X.rfm_features(lines, [DAY], online=["Web"]))
    alive = found["ALIVE"]
    assert (alive["frequency"], alive["monetary"], alive["units_per_line"], alive["avg_basket_value"], alive["recency_days"]) == (2, 2600.0, 3.0, 1300.0, 11)
    assert "NEW" not in found and "LATER" not in found


def test_dormant_customers_stay(lines):
    day = dt.date(2025, 6, 15)
    dormant = by_customer(X.rfm_features(lines, [day]))["DORMANT"]
    assert (dormant["lines"], dormant["frequency"], dormant["monetary"]) == (0, 0, None)
    assert dormant["recency_days"] > 100 and dormant["last_purchase"] == dt.date(2025, 1, 25)
    assert "DORMANT" not in by_customer(X.rfm_features(lines, [day], include_unconverted=False))


@pytest.mark.parametrize("day, churn", [(DAY, {"ALIVE": 0, "DORMANT": 1}), (dt.date(2025, 1, 10), {"ALIVE": 0, "DORMANT": 0})])
def test_labels(lines, day, churn):
    found = by_customer(X.churn_snapshots(lines, [day]))
    assert {k: found[k]["churn"] for k in churn} == churn


def test_unobservable_snapshots_are_dropped(lines):
    kept, dropped = X.split_observable(lines, [DAY, dt.date(2025, 12, 1)])
    assert kept == [DAY] and [d for d, _ in dropped] == [dt.date(2025, 12, 1)]


def test_leakage_guard(lines):
    found = X.churn_snapshots(lines, [DAY])
    assert "Exchange hashpartitioning(snapshot_date" not in found._jdf.queryExecution().executedPlan().toString()  # what the join multiplies isn't shuffled
    X.assert_no_leakage(found, allow_labels=True)
    with pytest.raises(X.LeakageError):
        X.assert_no_leakage(found)
    with pytest.raises(X.LeakageError):
        X.assert_no_leakage(found.withColumnRenamed("units", "future_units"), allow_labels=True)
    with pytest.raises(X.LeakageError):
        X.assert_no_leakage(found.selectExpr("*", "date_add(snapshot_date, 1) AS seen"), allow_labels=True)


def test_matrices(lines):
    found = X.rfm_features(lines, [DAY])
    assert "customer_id" in X.feature_matrix(found).columns
    assert X.model_matrix(found, ["frequency"]).dtypes == [("frequency", "double")]
    with pytest.raises(ValueError):
        X.model_matrix(found, ["customer_id"])


def test_rollups(lines):
    daily = R.aggregate(lines, "daily")
    assert sum(r["units"] for r in daily.collect()) == 24
    assert R.aggregate(lines, "weekly").count() == 0
    assert R.aggregate(lines.limit(0), "daily").count() == 0
    with pytest.raises(ValueError):
        R.aggregate(lines, "monthly")
    with pytest.raises(ValueError):
        R.require(lines, ["units_sold"], "panel")
    with pytest.raises(KeyError):
        R.kpi_value(R.kpis(lines.selectExpr("*", "product_category AS product_id", "channel AS store_id")), "no such")


def contract_rows():
    days = [dt.date(2024, 1, d) for d in (1, 2, 3)]
    rows = []
    for day, q, price, off, promo, stock, txn, customer in zip(days, (3, 0, 2), (500.0, 250.0, 1200.0), (0.0, 0.0, 120.0), (None, None, "Weekend_Flash"), (40, 0, 10), ("T1", "T2", "T3"), ("C1", "C2", "C1"), strict=True):
        rows.append(dict(zip(Q.SALES_COLUMNS, (
            day, customer, "ST01", "PRD0001", "Grocery", q, price, off, promo, stock, round(q * (price - off), 2), "Pune", 100 * off / price, int(promo is not None), txn, "Rice", "West",
            day.strftime("%A"), int(day.weekday() >= 5), 0, day.strftime("%Y-%m"), day.isocalendar()[1], f"Q{(day.month + 2) // 3}", "Budget" if price < 299 else "Mid" if price < 1000 else "Premium", "Family", "Gold", "Store",
        ), strict=True)))
    return rows


@pytest.mark.parametrize("change, rule", [
    ({"sales_amount": 999.99}, "sales_amount"), ({"discount": 99999.0}, "sales_amount"), ({"discount_pct": 55.0}, "discount_pct"), ({"is_promotion": 1}, "is_promotion"),
    ({"quantity_sold": -3, "sales_amount": -1500.0}, "negative_quantity"), ({"inventory_level": -1}, "negative_inventory"), ({"weekday": "Funday"}, "weekday"), ({"year_month": "2024-13"}, "year_month"),
    ({"price_band": "Luxury"}, "price_band"), ({"is_weekend": 1}, "is_weekend"), ({"quantity_sold": 0, "sales_amount": 0.0}, "lost_demand_with_stock"), ({"city": None}, "null city"),
])
def test_contract(spark, change, rule):
    from brasswork.sources.files import SALES_SCHEMA

    rows = contract_rows()
    assert Q.validate_sales(spark.createDataFrame([tuple(r[c] for c in Q.SALES_COLUMNS) for r in rows], SALES_SCHEMA), 3) == 3
    rows[0] |= change
    with pytest.raises(Q.ContractViolation) as broken:
        Q.validate_sales(spark.createDataFrame([tuple(r[c] for c in Q.SALES_COLUMNS) for r in rows], SALES_SCHEMA))
    assert broken.value.rule == rule


def test_contract_columns_and_files(spark, tmp_path):
    from brasswork.sources import files

    frame = spark.createDataFrame([tuple(r[c] for c in Q.SALES_COLUMNS) for r in contract_rows()], files.SALES_SCHEMA)
    with pytest.raises(Q.ContractViolation):
        Q.validate_sales(frame.drop("city"))
    with pytest.raises(Q.ContractViolation):
        Q.validate_sales(frame, rows=4)
    frame.na.fill("None", ["promotion"]).coalesce(1).write.csv(str(tmp_path / "sales"), header=True)
    assert files.load_sales(spark, str(tmp_path / "sales"), 3).where("promotion IS NULL").count() == 2
    week = dict.fromkeys(Q.PANEL_COLUMNS, 1) | {"week_start_date": dt.date(2025, 1, 6), "store_id": "S1", "city": "c", "region": "r", "product_id": "P1", "product_category": "g"}
    week |= {c: 1.0 for c in ("revenue", "avg_unit_price", "avg_discount_pct")}
    panel = spark.createDataFrame([tuple(week[c] for c in Q.PANEL_COLUMNS)], files.PANEL_SCHEMA)
    panel.coalesce(1).write.csv(str(tmp_path / "panel"), header=True)
    sales, _, found = files.ingest(spark, str(tmp_path / "sales"), str(tmp_path / "panel"), counts=(3, 2))
    assert sales.count() == 3 and found["sales"]["breaches"] == {} and found["wrong_counts"] == ["panel"] and not found["valid"]
    assert files.ingest(spark, str(tmp_path / "sales"), str(tmp_path / "panel"), (3, 1), {"lines": 3})[2]["valid"]
    assert files.ingest(spark, str(tmp_path / "sales"), str(tmp_path / "panel"), expected={"lines": 4})[2]["differences"] == [("lines", 4, 3)]
    assert Q.validate_sales(frame, sample=2) == 2
    files.write_json(spark, {"a": [1, 2]}, str(tmp_path / "doc"))
    assert files.read_json(spark, str(tmp_path / "doc")).first()["a"] == [1, 2]
    (tmp_path / "a.md").write_text("# One\n```\n# not\n```\ntext\n## Two ##\n")
    assert [(r["level"], r["title"]) for r in files.markdown_headings(spark, str(tmp_path / "a.md")).collect()] == [(1, "One"), (2, "Two")]


def test_broken_dependencies_need_no_distinct_values(spark):
    frame = spark.createDataFrame([(1, 2), (1, 2), (2, 3), (2, 4), (3, None), (3, 1), (4, None)], "k int, v int")
    found = Q.dependency_breaches(frame, ["k"], "v")
    assert found.first()["broken_keys"] == 1
    assert "distinct" not in found._jdf.queryExecution().executedPlan().toString()


def test_what_lies_before_every_window_is_not_multiplied(spark):
    days = [dt.date(2001, m, 28) for m in (1, 2, 3)]
    rows = [(1, 10 + k, dt.date(2000, 1, 1) + dt.timedelta(k)) for k in range(100)] + [(1, 200, dt.date(2001, 2, 1)), (2, 201, dt.date(2000, 5, 5)), (3, 202, dt.date(2001, 4, 1)), (4, 203, None)]
    bought = spark.createDataFrame(rows, "customer_id long, transaction_id long, date date").selectExpr("*", "1L as lines", "cast(2 as decimal(18,4)) as amount", "3L as units", "0L as promo", "0.0D as discount", "1L as discounts", "0L as online", "array('A') as categories")
    assert X._seen(bought, days, 30, 30).count() == 101 + 3 + 1  # days before 2000-12-30 come once
    found = {(r["customer_id"], r["snapshot_date"].month): (r["first_purchase"], r["last_purchase"], r["frequency"], r["later"]) for r in X._at_snapshots(bought, days, 30, 30).collect()}
    first, last, new, lone = dt.date(2000, 1, 1), dt.date(2000, 4, 9), dt.date(2001, 2, 1), dt.date(2000, 5, 5)
    want = {(1, 1): (first, last, 0, True), (1, 2): (first, new, 1, False), (1, 3): (first, new, 0, False)} | {(2, m): (lone, lone, 0, False) for m in (1, 2, 3)}
    assert found == want
    assert X._at_snapshots(bought, [], 30, 30).count() == 0
