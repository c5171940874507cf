"""Metrics, quantiles, models and rules, by hand-computed values."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from brasswork.functions import metrics as M
from brasswork.functions.numbers import normal_quantile, poisson_quantile, poisson_quantiles
from brasswork.operators import churn as C
from brasswork.operators import density, describe, ranges
from brasswork.operators import drift as D
from brasswork.operators import forecast as P
from brasswork.operators import inventory as I
from brasswork.operators import quality as Q
from brasswork.operators import segmentation as S
from brasswork.plans import config, stages
from brasswork.streaming.weekly import weekly_stream


def test_forecast_metrics(spark):
    pairs = spark.createDataFrame(list(zip([0.0, 0.0, 10.0, 20.0, 0.0, 40.0], [0.0, 5.0, 12.0, 18.0, 10.0, 30.0], strict=True)), "y double, f double")
    row = pairs.agg(*M.forecast_aggregates()).first()
    assert row["wape"] == round(29 / 70, 6) and row["mape_nonzero"] == round((0.2 + 0.1 + 0.25) / 3, 6)
    assert row["bias"] == round(-5 / 6, 6) and (row["n"], row["n_nonzero"]) == (6, 3)
    assert pairs.where("y = 0").agg(*M.forecast_aggregates()).first()["wape"] is None
    with pytest.raises(ValueError):
        M.check_pairs(pairs.limit(0))


def test_ranking(spark):
    scored = spark.createDataFrame([(i, float(10 - i), int(i in (0, 1, 5))) for i in range(10)], "id int, s double, l int")
    row = M.ranking_metrics(scored, "s", "l", "id").first()
    assert (row["n_top"], row["precision_at_k"], row["recall_at_k"]) == (2, 1.0, 2 / 3)
    curve = M.curve_metrics(scored, "s", "l").first()
    assert curve["roc_auc"] == round(18 / 21, 8) and curve["average_precision"] == round((1 + 1 + 3 / 6) / 3, 8)


def test_curves_of_more_pairs_than_an_integer_holds(spark):
    scored = spark.range(120_000).selectExpr("cast(id div 2 as double) as s", "cast(id % 2 as int) as l")
    curve = M.curve_metrics(scored, "s", "l").first()
    assert curve["roc_auc"] == 0.5 and curve["average_precision"] == 0.5


def test_quantiles():
    assert I.critical_ratio(1.0) == pytest.approx(0.9928400954653939, abs=1e-12)
    assert normal_quantile(0.9928400954653939) == pytest.approx(2.44913921067312, abs=1e-9)
    assert poisson_quantile(0.9928400954653939, 7500.736) == 7714
    assert poisson_quantile(0.9928400954653939, 1e-9) == 0 and poisson_quantile(0.9928400954653939, 2.2) == 7
    with pytest.raises(ValueError):
        I.critical_ratio(0.0)
    with pytest.raises(ValueError):
        I.poisson_safety(3.0, None)
    assert I.replay_weeks(104) == 91


def test_models():
    t = np.arange(160)
    y = 100 + 0.2 * t + 20 * np.sin(2 * np.pi * t / 52)
    for name, model in P.MODELS.items():
        forecast = model(y, 4)
        assert forecast.shape == (4,) and (forecast >= 0).all()
        if name != "ridge_seasonal":  # its unknown lags count as 0
            assert np.abs(forecast / (100 + 0.2 * np.arange(160, 164) + 20 * np.sin(2 * np.pi * np.arange(160, 164) / 52)) - 1).max() < 0.25
    assert np.abs(P.ridge_seasonal(y, 4, recursive=True) - y[-4:].mean()).max() < 40
    with pytest.raises(ValueError):
        P.seasonal_naive(y[:10], 1)


def test_backtest_keeps_failures(spark):
    series = spark.createDataFrame([(i, float(i)) for i in range(70)], "t int, y double")
    rows = P.backtest(series, models=["seasonal_naive", "ridge_seasonal"]).collect()
    assert len(rows) == 6 and all((r["error"] is None) == (r["model"] == "seasonal_naive") for r in rows)
    assert {r["model"] for r in P.select_models(P.backtest(series, models=["seasonal_naive"])).collect()} == {"seasonal_naive"}


def both(spark, reference, current):
    return spark.createDataFrame([("reference", float(x)) for x in reference] + [("current", float(x)) for x in current], "period string, x double")


def test_psi(spark):
    same = D.psi(both(spark, range(100), range(100)), ["x"]).first()
    assert same["psi"] == 0
    near, far = (D.psi(both(spark, range(100), [x + s for x in range(100)]), ["x"], open_ended=True).first()["psi"] for s in (5, 40))
    assert 0 < near < far
    away = D.psi(both(spark, range(100), range(200, 300)), ["x"])
    assert away.count() == 0 or away.first()["psi"] is None
    assert D.psi(both(spark, range(100), range(200, 300)), ["x"], open_ended=True).first()["psi"] > 0.2


@pytest.mark.parametrize("value, verdict", [(0.0, "stable"), (0.05, "stable"), (0.1, "moderate"), (0.15, "moderate"), (0.2, "significant"), (0.9, "significant"), (None, "insufficient data")])
def test_verdicts(spark, value, verdict):
    from pyspark.sql import functions as F

    assert spark.range(1).select(D.verdict(F.lit(value).cast("double")).alias("v")).first()["v"] == verdict


def test_periods_must_exist(spark):
    with pytest.raises(ValueError):
        D.split_periods(spark.createDataFrame([(1999,)], "year int"), 1999, 2000)


def test_choice_of_k():
    assert S.select_k({5: 0.2021, 6: 0.1998, 7: 0.1905, 8: 0.1714}) == 6
    assert S.select_k({5: 0.90, 6: 0.1998, 7: 0.1905}) == 5


def test_clusters():
    random = np.random.default_rng(1)
    x = np.concatenate([random.normal(0, 0.1, (60, 2)), random.normal(5, 0.1, (60, 2))])
    labels = S.lloyd(x, 2)
    assert len(set(labels[:60])) == len(set(labels[60:])) == 1 and S.silhouette(x, labels) > 0.9


def brute_density(x, ids, radius, least):
    near = ((x[:, None] - x[None]) ** 2).sum(2) <= radius * radius
    core = near.sum(1) >= least
    label = {int(i): int(i) for i in ids[core]}
    for _ in range(len(x)):
        for i in np.flatnonzero(core):
            label[int(ids[i])] = min(label[int(ids[j])] for j in np.flatnonzero(near[i] & core))
    for i in np.flatnonzero(~core):
        around = [label[int(ids[j])] for j in np.flatnonzero(near[i] & core)]
        if around:
            label[int(ids[i])] = min(around)
    order = sorted(set(label.values()))
    return {int(i): order.index(label[int(i)]) if int(i) in label else -1 for i in ids}


@pytest.mark.parametrize("block", [1024, 7])
def test_density_clusters_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(density, "BLOCK", block)
    random = np.random.default_rng(2)
    x = np.concatenate([random.normal(0, 0.3, (70, 4)), random.normal(4, 0.3, (60, 4)), random.uniform(-3, 7, (40, 4))])
    frame = spark.createDataFrame([(i, *map(float, row)) for i, row in enumerate(x)], "customer_id long, a double, b double, c double, d double")
    found = {r["customer_id"]: r["label"] for r in density.density_clusters(frame, list("abcd"), 0.5, 8).collect()}
    z = (x - x.mean(0)) / x.std(0)
    assert found == brute_density(z, np.arange(len(x)), 0.5, 8) and max(found.values()) >= 1 and -1 in found.values()
    radius, labels = density.search(frame, list("abcd"), least=8)
    assert radius > 0 and labels.count() == len(x) and labels.agg({"label": "max"}).first()[0] >= 1


def test_scaler_refuses_nulls(spark):
    frame = spark.createDataFrame([(1, None), (2, 3.0)], "customer_id int, a double")
    with pytest.raises(ValueError):
        S.standardise(frame, ["a"])
    with pytest.raises(ValueError):
        S.standardise(frame, ["b"])


def test_stages_stop_at_the_first_failure(spark, tmp_path):
    ran = []

    def good(s, d):
        ran.append("good")
        return {"t": s.range(3), "_own": s.range(1)}

    empty = stages.Stage("empty", lambda s, d: {"t": s.range(0)}, ("t",))
    all_ = [stages.Stage("good", good, ("t",)), empty, stages.Stage("later", good, ("t",))]
    with pytest.raises(stages.StageFailed) as failed:
        stages.run_stages(spark, "", str(tmp_path), stages=all_)
    assert failed.value.name == "empty" and ran == ["good"] and not (tmp_path / "good" / "_own").exists()
    assert sorted(r["id"] for r in stages.document(spark, str(tmp_path), [("good", "t")])["good"]["t"]) == [0, 1, 2]
    with pytest.raises(FileNotFoundError):
        stages.document(spark, str(tmp_path), [("later", "t")])
    assert stages.plain(float("nan")) is None


def test_stream_emits_whole_weeks(spark, tmp_path):
    import datetime as dt

    rows = [(dt.datetime(2024, 1, d, 12), "view", 1.0) for d in range(1, 20)]
    frame = spark.createDataFrame(rows, "ts timestamp_ntz, event_type string, value double")
    frame.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
    query = weekly_stream(stream).writeStream.format("memory").queryName("weeks").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    found = {r["week_start"].date(): r["n"] for r in spark.sql("SELECT * FROM weeks").collect()}
    assert found == {dt.date(2024, 1, 1): 7, dt.date(2024, 1, 8): 7}


def test_poisson_quantiles_of_a_column(spark):
    r = np.random.default_rng(4)
    rows = [(float(q), float(m)) for q, m in zip(r.uniform(0.01, 0.9999, 300), r.choice([0.0, 0.3, 4.0, 80.0, 5000.0, 2e5], 300) * r.uniform(0.5, 2, 300), strict=True)] + [(None, 1.0), (0.5, None), (0.5, -1.0)]
    found = spark.createDataFrame(rows, "q double, m double").select("q", "m", poisson_quantiles("q", "m").alias("k")).collect()
    assert [row["k"] for row in found] == [None if q is None or m is None else poisson_quantile(q, m) for q, m in rows]


def test_scaled_error(spark):
    y = [float(i % 4 * 3 + i // 4) for i in range(20)]
    series = spark.createDataFrame(list(enumerate(y)), "t int, y double")
    pairs = spark.createDataFrame([(y[i], y[i - 4]) for i in range(4, 20)], "y double, f double")
    scales = M.seasonal_scale(series, "t", "y", 4)
    assert M.mase(pairs, scales).first()["mase"] == 1.0
    bundle = M.forecast_bundle(pairs, scales).first()
    assert bundle["mase"] == 1.0 and bundle["nonzero_share"] == round(sum(v != 0 for v in y[4:]) / 16, 6) and bundle["mae"] == 1.0
    flat = M.seasonal_scale(spark.createDataFrame([(i, 2.0) for i in range(9)], "t int, y double"), "t", "y", 4)
    assert M.mase(pairs, flat).first()["mase"] is None


@pytest.mark.parametrize("parts, sample", [(64, 20_000), (5, 7), (1, 1)])
def test_ranges_equal_a_sort(spark, parts, sample):
    r = np.random.default_rng(5)
    rows = [(int(k), int(v)) for k, v in zip(r.permutation(400), r.choice([1, 1, 1, 2, 7, 40], 400), strict=True)]
    frame = spark.createDataFrame(rows, "id long, v long")
    out, totals = ranges.running(frame, [-F.col("v"), F.col("id")], {"upto": "v"}, parts=parts, sample_rows=sample)
    wanted, so_far = {}, 0
    for place, (k, v) in enumerate(sorted(rows, key=lambda x: (-x[1], x[0]))):
        so_far += v
        wanted[k] = (place + 1, so_far)
    assert {x["id"]: (x["rank"], x["upto"]) for x in out.collect()} == wanted and totals == {"rank": 400, "upto": so_far}
    counted = frame.groupBy((F.col("id") % 3).alias("g"), "v").agg(F.count("*").alias("n"))
    for row in ranges.quantiles(counted, ["g"], "v", "n", [0.0, 0.3, 0.5, 0.99, 1.0]).collect():
        assert np.allclose(row["quantiles"], np.quantile([v for k, v in rows if k % 3 == row["g"]], [0, 0.3, 0.5, 0.99, 1]))
    empty, nothing = ranges.running(frame.limit(0), [F.col("v")])
    assert empty.count() == 0 and nothing == {"rank": 0}


def test_index_of_texts_and_ties(spark):
    rows = [("reference", x) for x in "1 2 3.5 42 7 x".split()] + [("current", x) for x in "1 2 3.5 42 7".split()]
    assert D.psi(spark.createDataFrame(rows, "period string, c string"), ["c"], bins=4).first()["psi"] == 0.0
    both = spark.createDataFrame([("reference", "a"), ("reference", "b"), ("current", "b"), ("current", "c")], "period string, c string")
    assert D.category_shift(both, "c").first()["largest_mover"] == "a"


def test_descriptions(spark):
    frame = spark.createDataFrame([(1, "a", 2.0), (2, None, None), (3, "a", 4.0)], "id long, w string, x double")
    assert [tuple(r) for r in describe.most_common(frame, "w").collect()] == [("a", 2), (None, 1)]
    assert describe.to_columns(frame, ["id"], ["x", "z"]).where("id = 2").first().asDict() == {"id": 2, "x": 0.0, "z": 0.0}
    assert describe.describe(frame, ["x"]).first()["q50"] == 3.0 and describe.spread(frame, "x").first()["median"] == 3.0
    found = Q.contract_report(frame, ["id", "w", "x"], {"large": F.col("x") > 3})
    assert found == {"rows": 3, "missing": [], "further": [], "breaches": {"null w": 1, "null x": 1, "large": 1}, "valid": False}
    assert Q.contract_report(frame, ["id", "y"], {})["missing"] == ["y"]


def test_guards(spark):
    panel = spark.createDataFrame([(1, "p", datetime.date(2024, 1, 1 + 7 * i), 1, 0) for i in range(4)], "store_id int, product_id string, week_start_date date, units_sold int, stockout_count int")
    with pytest.raises(ValueError):
        I.replay(panel)
    paths = spark.createDataFrame([(1, 1, 5.0), (2, 1, 6.0), (2, 2, 7.0)], "horizon int, weeks_ahead int, forecast double")
    assert I.first_week(paths).first()["forecast"] == 5.0
    with pytest.raises(ValueError):
        I.first_week(paths.where("horizon = 2 and weeks_ahead = 2"))
    day = spark.createDataFrame([(datetime.date(2024, 1, 1), 1)], "snapshot_date date, churn int")
    with pytest.raises(ValueError):
        C.fit_model(day, test=day)


def test_stage_progress_and_large_documents(spark, tmp_path, monkeypatch):
    seen = []
    stage = stages.Stage("good", lambda s, d: {"t": s.range(3)}, ("t",))
    results = stages.run_stages(spark, "", str(tmp_path), stages=[stage], progress=seen.append)
    assert [r.name for r in seen] == ["good"] and stages.reports(spark, results).first()["tables"] == ["t"]
    monkeypatch.setattr(stages, "MAX_ROWS", 2)
    with pytest.raises(ValueError):
        stages.document(spark, str(tmp_path), [("good", "t")])


def test_settings(spark, tmp_path):
    (tmp_path / "own.json").write_text('{"label_days": 30, "horizons": [1, 3]}')
    own = config.load(spark, str(tmp_path / "own.json"))
    assert own.label_days == 30 and own.horizons == (1, 3) and own.snapshots()[0] == datetime.date(2000, 8, 31)
    (tmp_path / "bad.json").write_text('{"labels": 30}')
    with pytest.raises(ValueError):
        config.load(spark, str(tmp_path / "bad.json"))
    with pytest.raises(ValueError):
        config.Settings(horizons=(0,))
    assert [s.name for s in stages.stages_for(own)] == [s.name for s in stages.STAGES]


def test_ridge_follows_iso_weeks():
    """A year of 53 weeks moves the season by one place, but not by its week number."""
    first = datetime.date(2012, 1, 2)
    weeks = P.iso_weeks(first, 320)
    assert weeks[0] == 1 and 53 in weeks
    y = 100 + 50.0 * (weeks == 20)
    told = P.run_model("ridge_seasonal", y[:300], 4, first)
    blind = P.run_model("ridge_seasonal", y[:300], 4, None)
    assert len(told) == len(blind) == 4 and np.abs(told - y[300:304]).mean() <= np.abs(blind - y[300:304]).mean() + 1.0
