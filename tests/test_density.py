"""Density clusters with cells that are never compared within themselves, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_numbers import brute_density

from brasswork.operators import density, segmentation


def table(spark, x):
    names = list("abcd")[: x.shape[1]]
    return spark.createDataFrame([(i, *map(float, row)) for i, row in enumerate(x)], f"customer_id long, {', '.join(f'{c} double' for c in names)}"), names


def scaled(x):
    return (x - x.mean(0)) / x.std(0)


@pytest.mark.parametrize(("hot", "block", "seed"), [(6, 5, 0), (12, 1024, 1), (20, 16, 2)])
def test_hot_cells_equal_brute_force(spark, monkeypatch, hot, block, seed):
    monkeypatch.setattr(density, "HOT", hot)
    monkeypatch.setattr(density, "BLOCK", block)
    r = np.random.default_rng(seed)
    # tight heaps at distances around the radius, a thin line of rows between two of them, and stray rows
    heaps = [r.normal((cx, cy), 0.03, (40, 2)) for cx, cy in ((0, 0), (0.33, 0), (0.7, 0.1), (3, 3), (3.38, 3), (6, 0))]
    line = np.column_stack([np.linspace(0.7, 3, 25), np.linspace(0.1, 3, 25)])
    x = np.concatenate([*heaps, line, r.uniform(-1, 7, (40, 2))])
    frame, names = table(spark, x)
    radius, least = 0.14, 6
    z = scaled(x)
    want = brute_density(z, np.arange(len(x)), radius, least)
    found = {row["customer_id"]: row["label"] for row in density.density_clusters(frame, names, radius, least).collect()}
    assert found == want and max(want.values()) >= 2 and -1 in want.values()
    placed, cells = density._placed(frame.select(F.col("customer_id").alias("id"), F.array(*[F.lit(0.0) + (F.col(c) - float(x[:, k].mean())) / float(x[:, k].std()) for k, c in enumerate(names)]).alias("v")), radius, 2)
    boxes = density._boxes(placed, least, cells, 2)
    assert boxes.count() >= 3


def test_one_hot_cell_ships_rows_in_proportion(spark):
    """A heap of n rows in one cell, and 30 rows around it: what is compared grows with n, not with its square."""
    shipped = []
    for n in (4000, 8000):
        r = np.random.default_rng(1)
        x = np.concatenate([r.normal(0.1, 1e-4, (n, 2)), r.uniform(-1, 1, (30, 2)) * 3])
        frame, names = table(spark, x)
        found = density.density_clusters(frame, names, 0.5, 25)
        assert found.where("label >= 0").count() >= n
        rows = frame.select(F.col("customer_id").alias("id"), F.array(*names).alias("v"))
        placed, cells = density._placed(rows, 0.5, 2)
        boxes = density._boxes(placed, 25, cells, 2)
        cold = placed.join(boxes.select(F.col("fine").alias("f")), F.col("fine") == F.col("f"), "left_anti")
        dealt, pairs = density._blocks(cold, cells)
        shipped.append(density._met(dealt, pairs).count().agg(F.sum("count")).first()[0] or 0)
    assert max(shipped) <= 30 * 9


def test_boxes_tell_distances(spark):
    r = np.random.default_rng(3)
    for _ in range(5):
        low_a, low_b = r.normal(size=3), r.normal(size=3)
        high_a, high_b = low_a + r.random(3), low_b + r.random(3)
        frame = spark.createDataFrame([(low_a.tolist(), high_a.tolist(), low_b.tolist(), high_b.tolist())], "la array<double>, ha array<double>, lb array<double>, hb array<double>")
        near, far = frame.select(*density._reach("la", "ha", "lb", "hb")).first()
        a = low_a + r.random((4000, 3)) * (high_a - low_a)
        b = low_b + r.random((4000, 3)) * (high_b - low_b)
        away = ((a - b) ** 2).sum(1)
        assert near <= away.min() + 1e-12 and far >= away.max() - 1e-12
        corners = max(((np.where(m, high_a, low_a) - np.where(k, high_b, low_b)) ** 2).sum() for m in np.ndindex(2, 2, 2) for k in np.ndindex(2, 2, 2))
        assert far == pytest.approx(corners)


def test_rows_are_made_once_for_all_radii_and_starts(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def marked(x):
        made.add(1)
        return x

    def frame():
        made.value = 0
        return spark.range(0, 200, 1, 2).select(F.col("id").alias("customer_id"), marked(F.pmod(F.xxhash64("id"), F.lit(1000)) / 10).alias("a"), (F.pmod(F.hash("id"), F.lit(1000)) / 10).alias("b"))

    density.search(frame(), ["a", "b"], 5)[1].count()
    assert made.value == 200
    segmentation.fit_clusters(frame(), ["a", "b"], 2, 2).count()
    assert made.value == 200


def test_blocks_apart_in_later_columns_do_not_meet(spark, monkeypatch):
    """Heaps that lie together in the columns of the grid and far apart in a later one: a heap meets itself alone."""
    monkeypatch.setattr(density, "BLOCK", 20)
    r = np.random.default_rng(5)
    x = np.concatenate([np.column_stack([r.uniform(0.01, 0.09, (100, 4)), r.uniform(0.01, 0.09, 100) + 5 * k]) for k in range(6)])
    rows = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "id long, v array<double>")
    placed, cells = density._placed(rows, 0.5, 5)
    dealt, pairs = density._blocks(placed, cells, 0.5, 5)
    sizes = [row["count"] for row in dealt.groupBy("block").count().collect()]
    assert sum(sizes) == 600 and max(sizes) <= 60
    assert pairs.count() <= 6 * 21  # of 30 blocks, 465 pairs
    heap = {row["block"]: row["heap"] for row in dealt.groupBy("block").agg(F.max(F.floor(F.col("v")[4] / 5)).alias("heap")).collect()}
    assert all(heap[p["low"]] == heap[p["high"]] for p in pairs.collect())
