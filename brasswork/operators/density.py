"""Density clusters of all rows of a frame, without a task that holds them all.

Rows lie in fine cells, whose diagonal is the radius, so rows of a cell are neighbours of each other. A cell of HOT rows or
more is never compared within itself: its rows are dense and belong together, and it stands for them. What else can be
told from the cells' boxes is told from them: a box that lies wholly within reach of a row, or of another box, needs no
comparison, one beyond reach neither. Only rows at the border of a hot cell are compared with its rows: with a part of
them first, which mostly decides, and then with the others.

All other rows lie in coarse cells over the first columns, made of fine ones and as wide as the radius at least, so that
neighbours of a row lie in its own cell or in one beside it. Full coarse cells are dealt to blocks of bounded size, along
their cells over the other columns, and blocks of neighbouring cells whose boxes are within reach meet in pairs. A pair first tells how many neighbours each row has in it, then which dense rows
it joins: a spanning forest, not all pairs.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, GroupedData, Window
from pyspark.sql import functions as F

from brasswork.operators.ranges import running
from brasswork.operators.segmentation import SAMPLE, sample_rows, standardise
from brasswork.session import cut

GRID_COLUMNS = 3
BLOCK = 1024
HOT = 1024  # rows from which on a fine cell is never compared within itself
NOISE = -1
SLACK = 1e-9  # squared distances that exceed the radius by no more count as within


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """node, label (the least node of its component) for each node of edges (a, b); raises RuntimeError if `most` turns are not enough."""
    both = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")))
    for _ in range(most):
        sent = both.join(labels, F.col("a") == F.col("node")).groupBy("b").agg(F.min("label").alias("heard"))
        lower = labels.join(sent, F.col("node") == F.col("b"), "left").select("node", "label", F.least("label", "heard").alias("heard"))
        ends = labels.select(F.col("node").alias("end"), F.col("label").alias("beyond"))
        new = cut(lower.join(ends, F.col("heard") == F.col("end"), "left").select("node", F.least("heard", "beyond").alias("label"), F.col("label").alias("before")))
        labels = new.select("node", "label")
        if not new.where("label <> before").limit(1).count():
            return labels
    raise RuntimeError(f"components are not found after {most} turns")


def _placed(rows: DataFrame, radius: float, d: int) -> tuple[DataFrame, list[str]]:
    """id and v with `fine`, the name of the fine cell, c0, c1, ...: the coarse cell, and `rest`: its place along the other columns."""
    side, wide = radius / math.sqrt(d), math.ceil(math.sqrt(d))
    index = [F.floor(F.col("v")[i] / side).cast("long") for i in range(d)]
    names = [f"c{i}" for i in range(min(GRID_COLUMNS, d))]
    coarse = [F.floor(i / wide).cast("long") for i in index]
    rest = F.array(*coarse[len(names) :]).cast("array<bigint>").alias("rest")
    return cut(rows.select("id", "v", F.concat_ws(":", *index).alias("fine"), *[c.alias(n) for c, n in zip(coarse, names, strict=False)], rest)), names


def _beside(frame: DataFrame, names: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """keep of each row, once for each of the coarse cells at or beside its own: near_c0, near_c1, ..."""
    steps = F.explode(F.array(*[F.struct(*[F.lit(x).alias(c) for c, x in zip(names, step, strict=True)]) for step in itertools.product((-1, 0, 1), repeat=len(names))])).alias("step")
    return frame.select(*names, *keep, steps).select(*keep, *[(F.col(c) + F.col(f"step.{c}")).alias(f"near_{c}") for c in names])


def _box(d: int) -> tuple[list[Column], list[Column]]:
    """Aggregates of the least and greatest v by column, and from them the arrays low and high."""
    sides = [f(F.col("v")[i]).alias(f"{name}{i}") for i in range(d) for name, f in (("low", F.min), ("high", F.max))]
    return sides, [F.array(*[f"{name}{i}" for i in range(d)]).alias(name) for name in ("low", "high")]


def _blocks(placed: DataFrame, names: Sequence[str], radius: float = math.inf, d: int = 1) -> tuple[DataFrame, DataFrame]:
    """id, v and block of each row, and the pairs of blocks (low, high) whose coarse cells touch and whose boxes are within reach.

    Cells over the other columns follow each other in a coarse cell, those of columns with the fewest places first, and are
    dealt to blocks in that order, so that a block's box is small.
    """
    cells = cut(placed.groupBy(*names, "rest").agg(F.count("*").alias("n")))
    kinds = cells.select(F.posexplode("rest")).groupBy("pos").agg(F.approx_count_distinct("col").alias("kinds")).orderBy("kinds", "pos").collect()
    before = Window.partitionBy(*names).orderBy(*[F.col("rest")[r["pos"]] for r in kinds], "rest").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("n").over(before), F.lit(0))
    cells = cells.select(*names, "rest", F.floor(start / BLOCK).alias("first"), F.floor((start + F.col("n") - 1) / BLOCK).alias("last"))
    sub = F.col("first") + F.pmod(F.xxhash64("id"), F.col("last") - F.col("first") + 1)
    placed_in = cut(placed.join(cells, [*names, "rest"]).select("id", "v", *names, F.concat_ws(":", *names, sub).alias("block")))
    sides, arrays = _box(d)
    blocks = cut(placed_in.groupBy("block", *names).agg(*sides).select("block", *names, *arrays))
    near = _beside(blocks, names, ("block", "low", "high"))
    other = blocks.select(*[F.col(c).alias(f"near_{c}") for c in names], F.col("block").alias("other"), F.col("low").alias("low_b"), F.col("high").alias("high_b"))
    met = near.join(other, [f"near_{c}" for c in names]).where("block <= other")
    nearest, _ = _reach("low", "high", "low_b", "high_b")
    pairs = met.where(nearest <= radius * radius + 2 * SLACK)  # rounding must not part what a comparison would join
    return placed_in.select("id", "v", "block"), cut(pairs.select(F.col("block").alias("low"), F.col("other").alias("high")))


def _boxes(placed: DataFrame, least: int, names: Sequence[str], d: int) -> DataFrame:
    """Of each hot cell: fine, n, head (its least id), low and high (its box), subs (parts of bounded size), coarse cell."""
    sides, arrays = _box(d)
    found = placed.groupBy("fine", *names).agg(F.count("*").alias("n"), F.min("id").alias("head"), *sides).where(F.col("n") >= max(least, HOT))
    return cut(found.select("fine", *names, "n", "head", F.ceil(F.col("n") / BLOCK).cast("int").alias("subs"), *arrays))


def _reach(low_a: str, high_a: str, low_b: str, high_b: str) -> tuple[Column, Column]:
    """The squared distances of the nearest and of the farthest points of two boxes; a row is a box of its own."""
    sides = F.zip_with(F.arrays_zip(F.col(low_a).alias("l"), F.col(high_a).alias("h")), F.arrays_zip(F.col(low_b).alias("l"), F.col(high_b).alias("h")), lambda a, b: F.struct(
        F.greatest(a["l"] - b["h"], b["l"] - a["h"], F.lit(0.0)).alias("near"), F.greatest(a["h"] - b["l"], b["h"] - a["l"]).alias("far")))
    total = lambda part: F.aggregate(sides, F.lit(0.0), lambda s, x: s + x[part] * x[part])
    return total("near"), total("far")


def _compared(guests: DataFrame, placed: DataFrame, radius: float) -> DataFrame:
    """guest, cell, n: how many rows of parts of hot cells are within the radius of guests.

    guests: guest, gv, cell, parts (array of sub numbers of the cell) and subs. Both sides of a cell are dealt to blocks.
    """
    dealt = guests.withColumn("share", F.pmod(F.xxhash64("guest", F.lit(5)), F.col("shares"))).select("guest", "gv", "cell", "share", F.explode("parts").alias("sub"))
    wanted = cut(dealt).groupBy("cell", "sub").agg(F.collect_set("share").alias("asked"), F.lit(1).alias("one")).drop("one")
    cells = guests.select("cell", "subs").distinct()
    hosts = placed.join(cells, F.col("fine") == F.col("cell")).select("cell", F.pmod(F.xxhash64("id", F.lit(7)), F.col("subs")).alias("sub"), F.col("id").alias("guest"), F.col("v").alias("gv"))
    hosts = hosts.join(wanted, ["cell", "sub"]).select("guest", "gv", "cell", "sub", F.explode("asked").alias("share"), F.lit(True).alias("host"))

    def compare(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        host = frame["host"].to_numpy(bool)
        x, y = (np.array(frame["gv"][side].to_list(), float) for side in (~host, host))
        if not len(x) or not len(y):
            return pd.DataFrame({"guest": [], "cell": [], "n": []}).astype({"guest": np.int64, "cell": str, "n": np.int64})
        return pd.DataFrame({"guest": frame["guest"][~host], "cell": key[0], "n": _within(x, y, radius).sum(1)})

    both = dealt.select("guest", "gv", "cell", "sub", "share", F.lit(False).alias("host")).unionByName(hosts)
    return both.groupBy("cell", "sub", "share").applyInPandas(compare, "guest long, cell string, n long").groupBy("guest", "cell").agg(F.sum("n").alias("n"))


def _met_hot(guests: DataFrame, placed: DataFrame, radius: float, enough: int) -> DataFrame:
    """guest, cell, n for all rows (guest, gv) at the border of hot cells: exact where n is under `enough`, else at least that.

    A part of the cell's rows is compared first, and all others only with guests whom that doesn't decide. The first part of
    a cell is its part 0.
    """
    sized = guests.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("shares")).withColumnRenamed("cell", "sized_cell")
    guests = cut(guests.join(sized, F.col("cell") == F.col("sized_cell")).drop("sized_cell"))
    first = cut(_compared(guests.withColumn("parts", F.array(F.lit(0))), placed, radius))
    told = first.select(F.col("guest").alias("g"), F.col("cell").alias("c"), F.col("n").alias("had"))
    rest = guests.where("subs > 1").join(told, (F.col("guest") == F.col("g")) & (F.col("cell") == F.col("c")), "left").where(F.coalesce("had", F.lit(0)) < enough).drop("g", "c", "had")
    rest = cut(rest)
    if rest.isEmpty():
        return first
    second = _compared(rest.withColumn("parts", F.sequence(F.lit(1), F.col("subs") - 1)), placed, radius)
    return first.union(second).groupBy("guest", "cell").agg(F.sum("n").alias("n"))


def _hot_counts(cold: DataFrame, placed: DataFrame, boxes: DataFrame, names: Sequence[str], radius: float, least: int) -> DataFrame:
    """of, head, n: how many rows of a hot cell are neighbours of a cold row, where any are; no less than `least` where that many are."""
    near, far = _reach("v", "v", "low", "high")
    around = _beside(boxes, names, ("fine", "head", "n", "low", "high", "subs"))
    met = cold.select("id", "v", *[F.col(c).alias(f"near_{c}") for c in names]).join(around, [f"near_{c}" for c in names])
    met = cut(met.select("id", "v", "fine", "head", "n", "subs", near.alias("nearest"), far.alias("farthest")).where(F.col("nearest") <= radius * radius + SLACK))
    whole = met.where(F.col("farthest") <= radius * radius).select(F.col("id").alias("of"), "head", "n")
    border = met.where(F.col("farthest") > radius * radius).select(F.col("id").alias("guest"), F.col("v").alias("gv"), F.col("fine").alias("cell"), "subs")
    found = _met_hot(border, placed, radius, least).where("n > 0").join(boxes.select("fine", "head"), F.col("cell") == F.col("fine"))
    return cut(whole.union(found.select(F.col("guest").alias("of"), "head", "n")))


def _hot_joins(placed: DataFrame, boxes: DataFrame, names: Sequence[str], radius: float) -> DataFrame:
    """a, b: heads of hot cells of which some rows are neighbours.

    Boxes tell most pairs. For the others, rows of one cell within reach of the other's box meet the other's rows.
    """
    near, far = _reach("low", "high", "low_b", "high_b")
    around = _beside(boxes, names, ("fine", "head", "low", "high"))
    other = boxes.select(*[F.col(c).alias(f"near_{c}") for c in names], F.col("fine").alias("fine_b"), F.col("head").alias("head_b"), F.col("low").alias("low_b"), F.col("high").alias("high_b"), "subs")
    met = around.join(other, [f"near_{c}" for c in names]).where("head < head_b")
    met = cut(met.withColumns({"nearest": near, "farthest": far}).where(F.col("nearest") <= radius * radius + SLACK))
    whole = met.where(F.col("farthest") <= radius * radius).select(F.col("head").alias("a"), F.col("head_b").alias("b"))
    open_ = met.where(F.col("farthest") > radius * radius)
    to_box, _ = _reach("v", "v", "low_b", "high_b")
    sides = placed.withColumnRenamed("fine", "own").join(open_.select("fine", "head", "fine_b", "low_b", "high_b", "subs"), F.col("own") == F.col("fine"))
    guests = sides.where(to_box <= radius * radius + SLACK).select(F.col("id").alias("guest"), F.col("v").alias("gv"), F.col("fine_b").alias("cell"), "subs", F.col("head").alias("of_head"))
    guests = cut(guests)
    # a few guests of each pair mostly decide it; if none does, all are asked
    place = F.row_number().over(Window.partitionBy("of_head", "cell").orderBy(F.xxhash64("guest")))
    few = guests.withColumn("place", place).where(F.col("place") <= BLOCK).drop("place")
    heads = boxes.select(F.col("fine").alias("fine_b"), F.col("head").alias("b"))

    def joined(some: DataFrame) -> DataFrame:
        asked = some.select("guest", "cell", F.col("of_head").alias("a")).distinct().withColumnsRenamed({"guest": "g", "cell": "c"})
        found = _met_hot(some.drop("of_head"), placed, radius, 1).where("n > 0").join(asked, (F.col("guest") == F.col("g")) & (F.col("cell") == F.col("c")))
        return found.join(heads, F.col("cell") == F.col("fine_b")).select("a", "b").distinct()

    first = cut(joined(few))
    done = first.join(heads, "b").select(F.col("a").alias("done_a"), F.col("fine_b").alias("done_cell"))
    rest = cut(guests.join(done, (F.col("of_head") == F.col("done_a")) & (F.col("cell") == F.col("done_cell")), "left_anti"))
    return cut(whole.union(first)) if rest.isEmpty() else cut(whole.union(first).union(joined(rest)))


def _met(dealt: DataFrame, pairs: DataFrame) -> GroupedData:
    """One row for each pair of blocks and each row of either."""
    both = pairs.select("low", "high", F.explode(F.array_distinct(F.array("low", "high"))).alias("block"))
    return dealt.join(both, "block").groupBy("low", "high")


def _within(x: np.ndarray, y: np.ndarray, radius: float) -> np.ndarray:
    away = (x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * x @ y.T
    return away <= radius * radius + SLACK


def _near(frame: pd.DataFrame, low: str, high: str, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the rows of both blocks and which of them are neighbours."""
    x = np.array(frame["v"].to_list(), float).reshape(len(frame), -1)
    a, b = (np.flatnonzero(frame["block"].to_numpy() == side) for side in (low, high))
    return a, b, _within(x[a], x[b], radius)


def density_clusters(frame: DataFrame, columns: Sequence[str], radius: float, least: int = 25, key: str = "customer_id") -> DataFrame:
    """key and label of each row: density-connected rows share one, noise has -1. A row counts among its own neighbours.

    Labels are numbered by the least key of a cluster's dense rows. A row that lies near dense rows of several clusters goes to
    the first of them. Keys must be whole numbers and occur once; columns are standardised and must not hold nulls.
    """
    d = len(columns)
    rows = standardise(frame, columns).select(F.col(key).cast("long").alias("id"), F.array(*[F.col(f"z_{c}").cast("double") for c in columns]).alias("v"))
    placed, names = _placed(rows, radius, d)
    boxes = _boxes(placed, least, names, d)
    hot = placed.join(boxes.select(F.col("fine").alias("hot_fine"), "head"), F.col("fine") == F.col("hot_fine"))
    cold = cut(placed.join(boxes.select(F.col("fine").alias("hot_fine")), F.col("fine") == F.col("hot_fine"), "left_anti"))
    dealt, pairs = _blocks(cold, names, radius, d)
    beside = _hot_counts(cold, placed, boxes, names, radius, least)

    def count(name: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        a, b, near = _near(frame, *name, radius)
        n = np.zeros(len(frame), np.int64)
        n[a] += near.sum(1)
        if name[0] != name[1]:
            n[b] += near.sum(0)
        return pd.DataFrame({"of": frame["id"], "n": n})

    counts = _met(dealt, pairs).applyInPandas(count, "of long, n long").union(beside.select("of", "n"))
    dense = counts.groupBy("of").agg((F.sum("n") >= least).alias("dense"))
    dealt = cut(dealt.join(dense, F.col("id") == F.col("of")).drop("of"))

    def join(name: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        a, b, near = _near(frame, *name, radius)
        ids, dense = frame["id"].to_numpy(), frame["dense"].to_numpy(bool)
        out = []
        core = near & dense[a][:, None] & dense[b][None]
        seen_a, seen_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
        for start in np.flatnonzero(core.any(1)):  # a forest: each row is reached once
            todo = [] if seen_a[start] else [start]
            seen_a[start] = True
            while todo:
                i = todo.pop()
                for j in np.flatnonzero(core[i] & ~seen_b):
                    seen_b[j] = True
                    out.append((ids[a[i]], ids[b[j]], True))
                    for k in np.flatnonzero(core[:, j] & ~seen_a):
                        seen_a[k] = True
                        out.append((ids[a[k]], ids[b[j]], True))
                        todo.append(k)
        for mine, others, table in ((a, b, near), (b, a, near.T)):
            for i in np.flatnonzero(~dense[mine]):  # the dense rows of one pair that a loose row touches
                out += [(ids[mine[i]], ids[others[j]], False) for j in np.flatnonzero(table[i] & dense[others])]
        return pd.DataFrame(out, columns=["a", "b", "dense"]).astype({"a": np.int64, "b": np.int64, "dense": bool})

    # a hot cell's rows hang on its head, and cold rows on the heads of the cells that they touch
    within = hot.where("id <> head").select(F.col("id").alias("a"), F.col("head").alias("b"), F.lit(True).alias("dense"))
    heads = boxes.select(F.col("head").alias("a"), F.col("head").alias("b"), F.lit(True).alias("dense"))
    touched = dealt.select("id", "dense").join(beside, F.col("id") == F.col("of")).select(F.col("id").alias("a"), F.col("head").alias("b"), "dense")
    met = _met(dealt, pairs).applyInPandas(join, "a long, b long, dense boolean")
    edges = cut(met.union(within).union(heads).union(touched).union(_hot_joins(placed, boxes, names, radius).withColumn("dense", F.lit(True))))
    labels = components(edges.where("dense").select("a", "b"))
    loose = edges.where("not dense").join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("label"))
    told = cut(labels.union(loose.select(F.col("a").alias("node"), "label")))
    first = told.select("label").distinct()
    numbered, _ = running(cut(first), [F.col("label")], rank="number_")
    out = placed.select("id").join(told, F.col("id") == F.col("node"), "left").join(numbered.withColumnRenamed("label", "cluster_"), F.col("label") == F.col("cluster_"), "left")
    return out.select(F.col("id").alias(key), F.coalesce(F.col("number_") - 1, F.lit(NOISE)).cast("long").alias("label"))


def search(frame: DataFrame, columns: Sequence[str], least: int = 25, most_noise: float = 0.4, steps: Sequence[float] = (1.0, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4), key: str = "customer_id") -> tuple[float, DataFrame]:
    """The first radius, downward from the median distance to the last of least + 1 neighbours, that splits the rows with noise in bounds.

    The median comes from a bounded sample of SAMPLE rows, in which a neighbour's place is scaled to the sample's share; the
    clusters are those of all rows. If no radius does, the last one's are given.
    """
    frame = cut(frame.select(key, *columns))  # each radius reads it anew
    n = frame.count()
    x = sample_rows(frame, columns, key, SAMPLE)
    away = np.sqrt(np.maximum((x * x).sum(1)[:, None] + (x * x).sum(1)[None] - 2 * x @ x.T, 0))
    place = min(max(1, round(least * len(x) / max(n, 1))), len(x) - 1)
    base = float(np.median(np.partition(away, place, axis=1)[:, place]))
    for step in steps:
        labels = cut(density_clusters(frame, columns, base * step, least, key))
        found = labels.agg(F.max("label").alias("most"), F.avg((F.col("label") == NOISE).cast("double")).alias("noise")).first()
        if found["most"] >= 1 and found["noise"] <= most_noise:
            break
    return base * step, labels
