"""Boosted trees by gradients and hessians, and additive attributions, against plain versions."""

import datetime
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from brasswork.operators import boosting as B
from brasswork.operators import churn as C
from brasswork.operators import trees as T

NAMES = ("a", "b", "c")
DAY = datetime.date(2001, 1, 31)


def random_ensemble(seed, trees=3, depth=4, features=4):
    r = np.random.default_rng(seed)
    nodes, roots = [], []

    def grow(level, cover):
        at = len(nodes)
        nodes.append(None)
        if level == depth or r.random() < 0.2 * (level > 0):
            nodes[at] = (-1, 0.0, -1, -1, r.normal(), cover)
            return at
        share = r.uniform(0.1, 0.9)
        name, cut = int(r.integers(features)), float(r.integers(5))
        nodes[at] = (name, cut, grow(level + 1, cover * share), grow(level + 1, cover * (1 - share)), 0.0, cover)
        return at

    for _ in range(trees):
        roots.append(grow(0, 100.0))
    return T.TreeEnsemble(tuple(f"f{k}" for k in range(features)), np.zeros(features), 0.3, np.array(roots), *(np.array(c) for c in zip(*nodes, strict=True)))


def worth(e, x, known):
    """The log-odds when only the features in known are followed, by walking both ways at other splits."""

    def walk(at):
        if e.feature[at] < 0:
            return e.value[at]
        if e.feature[at] in known:
            return walk(e.left[at] if x[e.feature[at]] <= e.threshold[at] else e.right[at])
        return sum(walk(c) * e.cover[c] / e.cover[at] for c in (e.left[at], e.right[at]))

    return e.base + sum(walk(root) for root in e.roots)


@pytest.mark.parametrize("seed", range(4))
def test_attributions_equal_all_subsets(seed):
    e = random_ensemble(seed)
    x = np.random.default_rng(seed + 100).integers(-1, 6, (80, 4)).astype(float)
    found = e.attributions(x)
    m = 4
    for row, parts in zip(x[:12], found, strict=False):
        for k in range(m):
            others = [j for j in range(m) if j != k]
            want = sum(
                math.factorial(n) * math.factorial(m - 1 - n) / math.factorial(m) * (worth(e, row, {*s, k}) - worth(e, row, set(s)))
                for n in range(m) for s in itertools.combinations(others, n)
            )
            assert parts[k] == pytest.approx(want, abs=1e-12)
    assert np.abs(found.sum(1) + e.expected - e.log_odds(x)).max() < 1e-9
    assert e.expected == pytest.approx(worth(e, x[0], set()))


@pytest.mark.parametrize("most", (1, 30, 4096))
def test_a_tree_is_one_table_or_few(monkeypatch, most):
    """Rows look up a cell for a tree, not one for a leaf; smaller tables give the same."""
    e = random_ensemble(7, trees=5)
    x = np.append(np.random.default_rng(8).integers(-1, 6, (5000, 4)).astype(float), [[np.inf, -np.inf, 0.0, 9.0]], axis=0)
    want = e.attributions(x)
    monkeypatch.setattr(T, "MOST_CELLS", most)
    other = random_ensemble(7, trees=5)
    parts, odds = other.explained(x)
    leaves = int((e.feature < 0).sum())
    assert len(other.leaves.tables) == {1: leaves, 4096: 5}.get(most, len(other.leaves.tables)) and all(t.parts.shape[1] <= max(most, 2**4) for t in other.leaves.tables)
    assert np.abs(parts - want).max() < 1e-12 and np.abs(odds - e.log_odds(x)).max() < 1e-12


def test_ensembles_without_splits():
    none = T.TreeEnsemble(("f",), np.zeros(1), 0.7, *(np.empty(0, int),) * 2, np.empty(0), *(np.empty(0, int),) * 2, np.empty(0), np.empty(0))
    assert none.expected == 0.7 and none.log_odds(np.ones((2, 1))).tolist() == [0.7, 0.7] and none.attributions(np.ones((2, 1))).tolist() == [[0.0], [0.0]]
    leaf = T.TreeEnsemble(("f",), np.zeros(1), 0.0, np.array([0]), np.array([-1]), np.zeros(1), np.array([-1]), np.array([-1]), np.array([2.0]), np.array([5.0]))
    assert leaf.expected == 2.0 and leaf.attributions(np.ones((1, 1))).tolist() == [[0.0]]


def table(spark, n=900, seed=1, nulls=True):
    r = np.random.default_rng(seed)
    a, b, c = r.integers(0, 12, n), r.integers(0, 9, n), r.integers(0, 5, n)
    y = (r.random(n) < 1 / (1 + np.exp(-(np.where((a > 5) ^ (b > 4), 1.5, -1.5) + 0.3 * c - 0.8)))).astype(int)
    rows = [(i, DAY, None if nulls and i % 53 == 0 else float(x), float(z), int(w), int(t)) for i, (x, z, w, t) in enumerate(zip(a, b, c, y, strict=True))]
    return spark.createDataFrame(rows, "customer_id long, snapshot_date date, a double, b double, c int, churn int")


def plain_fit(rows, settings):
    """Log-odds of all rows by exact greedy splits over the values themselves."""
    y = np.array([r["churn"] for r in rows], float)
    x = np.array([[np.nan if r[c] is None else float(r[c]) for c in NAMES] for r in rows])
    for k in range(3):
        own = np.sort(x[~np.isnan(x[:, k]), k])
        x[np.isnan(x[:, k]), k] = own[(len(own) - 1) // 2]
    w = np.where(y == 1, (1 - y).sum() / y.sum(), 1.0)
    margin = np.zeros(len(y))
    for _ in range(settings.trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = (np.rint(v * B.SCALE) / B.SCALE for v in ((p - y) * w, p * (1 - p) * w))
        todo = [(np.arange(len(y)), 0)]
        add = np.zeros(len(y))
        while todo:
            at, level = todo.pop()
            lam, best = settings.reg_lambda, (1e-6, None)
            whole = g[at].sum() ** 2 / (h[at].sum() + lam)
            if level < settings.depth:
                for k in range(3):
                    for cut in np.unique(x[:, k])[:-1]:
                        low = at[x[at, k] <= cut]
                        high = at[x[at, k] > cut]
                        if min(h[low].sum(), h[high].sum()) < settings.min_child_weight:
                            continue
                        gain = g[low].sum() ** 2 / (h[low].sum() + lam) + g[high].sum() ** 2 / (h[high].sum() + lam) - whole
                        if gain > best[0] + 1e-12:
                            best = (gain, (low, high))
            if best[1] is None:
                add[at] = -g[at].sum() / (h[at].sum() + lam) * settings.step
            else:
                todo += [(part, level + 1) for part in best[1]]
        margin += add
    return margin


def test_equal_to_a_plain_version(spark):
    settings = B.Settings(trees=13, depth=3, step=0.3, min_child_weight=5.0, subsample=1.0, colsample=1.0)
    frame = table(spark)
    model = B.fit_boosted(frame, NAMES, settings=settings)
    rows = frame.collect()
    got = {r["customer_id"]: r["log_odds"] for r in T.attributed(model, frame, ("customer_id",)).collect()}
    want = plain_fit(rows, settings)
    assert max(abs(got[r["customer_id"]] - m) for r, m in zip(rows, want, strict=True)) < 1e-9


def test_rows_dealt_otherwise_give_the_same_model(spark):
    settings = B.Settings(trees=6, depth=3, min_child_weight=2.0)
    first, second = (B.fit_boosted(table(spark).repartition(n, "b"), NAMES, settings=settings) for n in (1, 5))
    for name in ("feature", "threshold", "value", "cover"):
        assert np.array_equal(getattr(first, name), getattr(second, name))


def test_levels_take_a_task_a_core_and_add_up_one_child(spark, monkeypatch):
    monkeypatch.setattr(B, "ROWS_PER_TASK", 20)
    grow, tasks, asked = B.grow, [], []

    def watched(sums, chosen, settings):
        def level_sums(tree, level):
            got = sums(tree, level)
            first = 2**level - 1
            there = [first + k for k in range(2**level) if not level or tree.feature[(first + k - 1) // 2] >= 0]
            asked.append(len(there))
            for k, part in zip(there, np.swapaxes(sums.added(tree, there), 0, 1), strict=True):
                assert np.array_equal(part, [x[k - first] for x in got])
            return got

        tasks.append(sums.blocks.getNumPartitions())
        return grow(level_sums, chosen, settings)

    monkeypatch.setattr(B, "grow", watched)
    B.fit_boosted(table(spark), NAMES, settings=B.Settings(trees=12, depth=3, min_child_weight=5.0))
    assert max(tasks) <= spark.sparkContext.defaultParallelism and max(asked) > 2


def test_blocks_are_written_as_python_objects(spark, monkeypatch):
    """Rows of a DataFrame would be turned to Python objects anew at every level of every tree."""
    grow, seen = B.grow, []

    def watched(sums, chosen, settings):
        seen.append((sums.blocks, sums.blocks.is_cached, sums.blocks.isCheckpointed(), type(sums.blocks.first()), len(sums.new)))
        return grow(sums, chosen, settings)

    monkeypatch.setattr(B, "grow", watched)
    B.fit_boosted(table(spark), NAMES, settings=B.Settings(trees=12, depth=2, min_child_weight=5.0))
    assert [x[1:4] for x in seen] == [(True, True, tuple)] * 12 and [x[4] for x in seen] == [*range(10), 0, 1]
    assert not any(blocks.is_cached for blocks, *_ in seen)  # none is kept beyond the fit


def test_sampling_and_bounds(spark):
    settings = B.Settings(trees=4, depth=4, min_child_weight=40.0, subsample=0.5, colsample=0.4)
    model = B.fit_boosted(table(spark), NAMES, settings=settings)
    assert model.cover.min() >= 40
    for tree in range(4):
        assert len(B.chosen_features(3, tree, settings)) == 1
        assert 0.45 < B.in_sample(np.random.default_rng(0).integers(0, 2**63, 9000).astype(np.uint64), tree, settings).mean() < 0.55
    with pytest.raises(ValueError):
        B.fit_boosted(table(spark).where("churn = 1"), NAMES)
    with pytest.raises(ValueError):
        B.fit_boosted(table(spark).limit(0), NAMES)


def test_edges_share_the_weight(spark):
    frame = spark.range(20000).selectExpr("cast(id as double) as x", "id % 3 * 1.0D as few", "if(id < 2000, 9.0D, 1.0D) as w")
    many, few = B.weighted_edges(frame, ["x", "few"], "w", 16)
    assert few.tolist() == [0.0, 1.0]
    weights = np.where(np.arange(20000) < 2000, 9.0, 1.0)
    sums = np.bincount(np.searchsorted(many, np.arange(20000)), weights)
    assert len(many) == 15 and sums.max() < 1.1 * weights.sum() / 16


def test_at_least_as_good_as_other_trees(spark):
    train, test = table(spark, 3000, 5), table(spark, 3000, 6).withColumn("snapshot_date", F.lit(DAY + datetime.timedelta(1)))
    model = B.fit_boosted(train, NAMES, settings=B.Settings(trees=40, step=0.15))
    other = C.fit_model(train, NAMES, trees=40, step=0.15, test=test)
    auc = [C.evaluate(x).first()["roc_auc"] for x in (T.scored(model, test, ("customer_id", "snapshot_date", "churn")), C.score(other, test, NAMES))]
    assert auc[0] >= auc[1] - 0.002 and auc[0] > 0.8
    # the other's trees as flat arrays score as it does, and their attributions add up too
    flat = C.flat(other)
    both = T.attributed(flat, test, ("customer_id",)).join(C.score(other, test, NAMES).select("customer_id", "churn_score"), "customer_id")
    worst = both.agg(
        F.max(F.abs(1 / (1 + F.exp(-F.col("log_odds"))) - F.col("churn_score"))),
        F.max(F.abs(F.aggregate("contributions", F.col("expected"), lambda s, x: s + x) - F.col("log_odds"))),
    ).first()
    assert max(worst) < 1e-9
    assert [n for n, _ in model.gains()][0] in ("a", "b") and sum(v for _, v in model.gains()) == pytest.approx(1)


def test_reasons_and_the_table_function(spark):
    frame = table(spark)
    model = B.fit_boosted(frame, NAMES, settings=B.Settings(trees=8, depth=3, min_child_weight=5.0))
    each = C.contributions(model, frame).groupBy("customer_id").agg(F.sum("contribution").alias("s"), F.first("log_odds").alias("o"), F.first("expected").alias("e"), F.count("*").alias("n")).collect()
    assert len(each) == 900 and all(abs(r["s"] + r["e"] - r["o"]) < 1e-9 and r["n"] == 3 for r in each)
    means = {r["feature"]: r["importance"] for r in C.global_importance(model, frame).collect()}
    parts = C.contributions(model, frame).groupBy("feature").agg(F.avg(F.abs("contribution")).alias("m")).collect()
    assert {r["feature"]: round(r["m"], 6) for r in parts} == pytest.approx(means, abs=2e-6)
    local = C.local_reasons(model, frame, 5, 2).collect()
    assert len(local) == 10 and {r["feature_rank"] for r in local} == {1, 2}
    best = T.scored(model, frame, ("customer_id",)).orderBy(F.desc("churn_score"), "customer_id").limit(5)
    assert {r["customer_id"] for r in local} == {r["customer_id"] for r in best.collect()}

    function = T.reason_table(model)
    rows = function(frame.asTable(), F.lit("customer_id"), F.lit(2)).collect()
    want = T.reasons(model, frame, ("customer_id",), 2).collect()
    key = lambda r: (r["customer_id"], r["feature_rank"])
    assert [(key(r), r["feature"], r["feature_value"]) for r in sorted(rows, key=key)] == [(key(r), r["feature"], r["feature_value"]) for r in sorted(want, key=key)]
    assert max(abs(a["contribution"] - b["contribution"]) for a, b in zip(sorted(rows, key=key), sorted(want, key=key), strict=True)) < 1e-12
    one = function(frame.repartition(1).where("customer_id is not null").asTable(), F.lit("customer_id"), F.lit(1))
    assert "Exchange hashpartitioning" not in one._jdf.queryExecution().executedPlan().toString()  # rows stay where they lie
    spark.udtf.register("churn_reasons", function)
    frame.where("customer_id < 3").createOrReplaceTempView("some_customers")
    told = spark.sql("SELECT * FROM churn_reasons(TABLE(some_customers), 'customer_id', 1) ORDER BY customer_id").collect()
    assert [(r["customer_id"], r["feature_rank"]) for r in told] == [(0, 1), (1, 1), (2, 1)]
    with pytest.raises(Exception, match="no a"):
        function(frame.drop("a").asTable(), F.lit("customer_id"), F.lit(2)).collect()


def test_at_risk_takes_a_share_of_all_rows(spark):
    scores = spark.range(5000).selectExpr("id as customer_id", "date'2001-01-31' as snapshot_date", "if(id % 11 = 0, null, (id * 37 % 501) / 500.0D) as churn_score")
    got = [r["customer_id"] for r in C.at_risk(scores, DAY, 0.2).collect()]
    rows = sorted(((r["churn_score"], r["customer_id"]) for r in scores.collect()), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    assert sorted(got) == sorted(c for _, c in rows[:1000])


def test_metrics_score_rows_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def marked(x):
        made.add(1)
        return x

    rows = spark.range(0, 300, 1, 3).selectExpr("id as customer_id", "cast(id % 2 as int) as churn", "(id * 37 % 101) / 100.0D as score")
    C.evaluate(rows.select("customer_id", "churn", marked("score").alias("churn_score"))).collect()
    assert made.value == 300


def test_rows_dealt_otherwise_give_the_same_trees_of_spark(spark):
    first, second = (C.score(C.fit_model(table(spark).repartition(n, "b"), NAMES, trees=3), table(spark), NAMES).orderBy("customer_id").collect() for n in (1, 5))
    assert first == second
