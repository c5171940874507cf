"""Statistical checks, trait names, cached tables and first looks, against plain versions."""

import datetime
import random
import statistics
import time
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from brasswork.operators import checks as K
from brasswork.operators import describe, quality
from brasswork.operators import segmentation as S
from brasswork.sources import files

FIELDS = "date date, product_category string, transaction_id long, customer_id long, quantity_sold int, is_promotion int"


def made_sales(seed=1):
    r = random.Random(seed)
    rows = []
    for day in range(400):
        date = datetime.date(2000, 1, 3) + datetime.timedelta(day)
        campaign = day % 50 < 6
        for k in range(r.randint(1, 3) + (2 if date.weekday() >= 5 else 0) + campaign):
            size = r.choice([1, 2, 2, 2, 3, 9, 10, 10])
            for _ in range(size):
                rows.append((date, r.choice(["A", "B"]) if date.month < 6 else r.choice("AAB"), day * 10 + k, r.randrange(60), r.choice([0, 1, 2, 5, 6, 6, 6, 7, 10, 11, 12, 12, 12, 24]), int(campaign or r.random() < 0.1)))
    return rows


def plain_checks(rows):
    by_day = defaultdict(lambda: [0, 0, 0])
    for date, _, _, _, q, p in rows:
        by_day[date][0] += q
        by_day[date][1] += 1
        by_day[date][2] += p
    mean = statistics.mean
    week = {w: mean(v[0] for d, v in by_day.items() if d.weekday() == w) for w in range(7)}
    months = defaultdict(list)
    for d, v in by_day.items():
        months[d.year, d.month].append(v[0])
    mm = {k: mean(v) for k, v in months.items()}
    campaign = {d: v[2] >= 0.8 * v[1] for d, v in by_day.items()}
    out = {
        "saturday_over_monday": week[5] / week[0], "sunday_over_monday": week[6] / week[0], "peak_over_trough_month": max(mm.values()) / min(mm.values()),
        "festive_over_midyear": mean(v for k, v in mm.items() if k[1] in (10, 11)) / mean(v for k, v in mm.items() if k[1] in (5, 6, 7)),
        "campaign_promo_share": mean(v[2] / v[1] for d, v in by_day.items() if campaign[d]) / mean(v[2] / v[1] for d, v in by_day.items() if not campaign[d]),
    }
    lifts = []
    for w in range(7):
        inside, outside = ([v[0] for d, v in by_day.items() if d.weekday() == w and campaign[d] == c] for c in (True, False))
        if inside and outside:
            lifts.append(mean(inside) / mean(outside))
    out["campaign_lift"] = mean(lifts)
    units, whole = Counter(), Counter()
    for date, c, _, _, q, _ in rows:
        units[c, date.month] += q
        whole[date.month] += q
    out["category_swing"] = max(max(s) / min(s) for s in ([units[c, m] / whole[m] for m in whole] for c in ("A", "B")))
    sizes = Counter(Counter(r[2] for r in rows).values())
    mode = min(sizes, key=lambda s: (-sizes[s], s))
    depths = [1 - min(sizes.get(k, 0) for k in range(mode, b)) / sizes[b] for b in sizes if b > mode and sizes[b] >= 0.005 * sum(sizes.values())]
    out["basket_valley"] = max([0, *depths])
    quantities = Counter(r[4] for r in rows)
    for p in (6, 12, 24):
        beside = sum(quantities[p + k] for k in (-2, -1, 1, 2))
        out[f"pack_spike_{p}"] = 4 * quantities[p] / beside if beside else None
    out["lost_lines"] = quantities[0] / len(rows)
    out["single_baskets"] = sizes[1] / sum(sizes.values())
    baskets = defaultdict(set)
    for r in rows:
        baskets[r[3]].add(r[2])
    out["repeat_customers"] = mean(len(b) > 1 for b in baskets.values())
    out["median_baskets"] = statistics.median(len(b) for b in baskets.values())
    return out


def test_checks_equal_a_plain_version(spark):
    rows = made_sales()
    found = K.statistical_checks(spark.createDataFrame(rows, FIELDS), F.col("promo") >= 0.8 * F.col("lines")).collect()
    got = {r["measure"]: r for r in found}
    want = plain_checks(rows)
    assert set(got) == set(K.BOUNDS)
    for name, value in want.items():
        assert got[name]["value"] == (None if value is None else pytest.approx(value, abs=2e-6)), name
        assert got[name]["holds"] == (None if value is None else value > 0 if name == "lost_lines" else round(value, 6) >= K.BOUNDS[name])


@pytest.mark.parametrize(("n", "depth"), [([5, 50, 20, 10, 5, 2], 0.0), ([5, 50, 20, 4, 20, 40, 3], 0.9), ([50, 0, 0, 30], 1.0), ([1000, 0, 0, 1], 0.0), ([7], 0.0)])
def test_valley_of_two_modes(spark, n, depth):
    sizes = spark.createDataFrame([(i + 1, c) for i, c in enumerate(n) if c], "size long, n long")
    assert K.valley(sizes).first()[0] == pytest.approx(depth)


def test_names_of_clusters_differ(spark):
    r = random.Random(3)
    rows = [(c * 1000 + i, c, 250 + 10 * c, 2, 10.0 + (c * 100 if c < 4 else 0), 0.05 * c, 0.3 if c == 2 else 0.0) for c in range(7) for i in range(r.randint(20, 40))]
    frame = spark.createDataFrame(rows, "customer_id long, cluster int, recency_days int, frequency int, monetary double, online_share double, promo_share double")
    named = {x["cluster"]: x for x in S.name_segments(frame).collect()}
    names = [x["segment"] for x in named.values()]
    assert len(set(names)) == 7 and all(x["trait"] for x in named.values())
    assert {x["axis"] for x in named.values() if x["segment"].startswith("Lapsed")} == {"monetary"}
    lapsed = sorted((x for x in named.values() if x["segment"].startswith("Lapsed")), key=lambda x: -x["spend"])
    assert [x["segment"].rsplit(" ", 1)[1][:-1] for x in lapsed] == [*S.RANK_WORDS, "#6", "#7"][: len(lapsed)]
    assert named[6]["trait"] == "online-heavy" and named[0]["trait"] == "in-store" and "in-store" in named[1]["segment"]
    alone = S.name_segments(frame.where("cluster = 3")).first()
    assert alone["trait"] is None and alone["axis"] is None and "(" not in alone["segment"]


def test_group_quantiles(spark):
    r = random.Random(6)
    rows = [(i, r.choice("ab"), r.randint(0, 30), None if i % 9 == 0 else r.random()) for i in range(500)]
    frame = spark.createDataFrame(rows, "id long, g string, x int, y double")
    found = {(q["group_"], q["feature"]): q["quantiles"] for q in S.group_quantiles(frame, "g", {"x": F.col("x"), "y": F.col("y")}, (0.3, 0.5)).collect()}
    for g in ("a", "b", None):
        for k, name in ((2, "x"), (3, "y")):
            values = sorted(row[k] for row in rows if row[k] is not None and g in (None, row[1]))
            assert found[g, name] == pytest.approx([values[int(p)] + (values[min(int(p) + 1, len(values) - 1)] - values[int(p)]) * (p % 1) for p in ((len(values) - 1) * 0.3, (len(values) - 1) * 0.5)])


def test_cached_tables_follow_their_files(spark, tmp_path):
    path, other = str(tmp_path / "t"), str(tmp_path / "u")
    reads = []

    def reader(session, where):
        reads.append(where)
        return session.read.parquet(where)

    cache = files.TableCache(spark, most=2)
    with pytest.raises(FileNotFoundError):
        cache.read(path, reader)
    spark.range(5).write.parquet(path)
    spark.range(3).write.parquet(other)
    assert cache.read(path, reader).count() == 5 and cache.read(path, reader).count() == 5 and reads == [path]
    time.sleep(0.05)
    spark.range(9).write.mode("overwrite").parquet(path)
    assert cache.read(path, reader).count() == 9 and reads == [path, path]
    assert cache.read(other, reader).count() == 3 and cache.read(path, reader).count() == 9 and reads == [path, path, other]
    spark.range(2).write.mode("append").parquet(path)
    assert cache.read(path, reader).count() == 11
    third = str(tmp_path / "v")
    spark.range(1).write.parquet(third)
    assert cache.read(third, reader).count() == 1 and cache.read(other, reader).count() == 3 and reads.count(other) == 2


def test_a_first_look(spark):
    frame = spark.createDataFrame([(1, datetime.date(2001, 1, 2), None), (2, datetime.date(2000, 5, 1), "x")], "a int, day date, t string")
    seen = describe.look(frame, ["day"], 1)
    assert seen["rows"] == 2 and seen["columns"] == {"a": "int", "day": "date", "t": "string"} and len(seen["head"]) == 1
    assert seen["days"] == {"day": ("2000-05-01", "2001-01-02")}


def test_contract_as_rows(spark):
    frame = spark.createDataFrame([(1, None, 2), (3, 4, -1)], "a int, b int, extra int")
    rows = {r["finding"]: (r["rows"], r["holds"]) for r in quality.contract_rows(frame, ["a", "b"], {"low": F.col("a") > 2}).collect()}
    assert rows == {"rows": (2, True), "further extra": (0, False), "null a": (0, True), "null b": (1, False), "low": (1, False)}
    rows = {r["finding"]: (r["rows"], r["holds"]) for r in quality.contract_rows(frame, ["a", "c"], {"low": F.col("c") > 2}).collect()}
    assert rows["missing c"] == (2, False) and "low" not in rows


def test_weeks_follow_the_tables(spark, sf, tmp_path):
    """Orders moved by some days and years give as many whole weeks, and none is left out or padded."""
    import duckdb

    from brasswork.plans import registry
    from brasswork.sources import star

    first, end = (datetime.date.fromisoformat(x) for x in star.span(spark, sf))
    days = spark.read.parquet(f"{sf}/orders.parquet").agg(F.min("o_orderdate").cast("date"), F.max("o_orderdate").cast("date")).first()
    assert first.weekday() == end.weekday() == 0 and days[0] <= first < days[0] + datetime.timedelta(7) and days[1] - datetime.timedelta(6) <= end <= days[1] + datetime.timedelta(1)
    moved = str(tmp_path)
    for name in ("region", "nation", "customer", "supplier", "part", "lineitem"):
        spark.read.parquet(f"{sf}/{name}.parquet").write.parquet(f"{moved}/{name}.parquet")
    spark.read.parquet(f"{sf}/orders.parquet").withColumn("o_orderdate", F.date_add(F.col("o_orderdate").cast("date"), 7 * 700 + 3)).write.parquet(f"{moved}/orders.parquet")
    con = duckdb.connect()
    for name in ("region", "nation", "customer", "supplier", "part", "lineitem", "orders"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{moved}/{name}.parquet/*.parquet'")
    frame = registry.queries()["series_total"](spark, moved)
    got = sorted((r["t"], r["y"]) for r in frame.collect())
    assert got == sorted((t, float(y)) for t, y in con.execute(f"SELECT t, y FROM ({registry.oracle_sql()['series_total']})").fetchall())
    whole = star.span(spark, moved)
    assert len(got) == (datetime.date.fromisoformat(whole[1]) - datetime.date.fromisoformat(whole[0])).days // 7 and sum(y for _, y in got) > 0


def test_a_panel_reads_the_lines_once(spark, sf):
    from brasswork.sources import star

    plan = star.panel(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan and "o_orderkey" not in plan
