"""Boosted trees by gradients and hessians, fitted where the rows lie.

Rows are binned once into blocks, and each level of a tree is one aggregation: sums of gradients and hessians by node,
feature and bin, a table whose size no number of rows changes. Sums are of whole numbers, so a model
doesn't depend on how rows are dealt or in which order tasks end.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brasswork.operators.trees import TreeEnsemble
from brasswork.session import cut

FINE = 2048  # cuts of equal numbers of rows, between which weights are summed to find the edges of bins
BLOCK = 65_536  # rows of a block
ROWS_PER_TASK = 50_000
FEW_TABLES = 64  # tables of sums that the driver adds up itself
SCALE = float(1 << 20)  # gradients and hessians are counted in millionths, about
KEPT_TREES = 10  # trees that a pass applies itself before the blocks are written with their sums


@dataclass(frozen=True)
class Settings:
    trees: int = 300
    depth: int = 4
    step: float = 0.05
    reg_lambda: float = 1.0
    min_child_weight: float = 20.0
    subsample: float = 0.8
    colsample: float = 0.8
    bins: int = 256
    seed: int = 42


@dataclass
class _Tree:
    """A tree on bins, in levels: the children of node i are 2 i + 1 and 2 i + 2. A leaf has feature -1."""

    feature: np.ndarray
    bin: np.ndarray
    value: np.ndarray
    cover: np.ndarray
    gain: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> _Tree:
        n = 2 ** (depth + 1) - 1
        return cls(np.full(n, -1), np.zeros(n, int), np.zeros(n), np.zeros(n), np.zeros(n))

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """The node that each row ends at; bins are features by rows, so that a split is one comparison of a whole column."""
        if len(self.feature) > 256:
            raise ValueError("trees of at most seven levels")
        at = np.zeros(bins.shape[1], np.uint8)
        for node in np.flatnonzero(self.feature >= 0).tolist():  # in levels, so parents come before their children
            here = at == node
            right = here & (bins[self.feature[node]] > int(self.bin[node]))
            at += (np.negative(here.view(np.uint8)) & np.uint8(node + 1)) + right.view(np.uint8)
        return at


def weighted_edges(rows: DataFrame, features: Sequence[str], weight: str, bins: int) -> list[np.ndarray]:
    """For each feature: at most bins - 1 cuts between which the rows have about equal weight.

    Fine cuts come from Spark's quantile sketches; the weight between them is one aggregation of at most FINE groups
    a feature. A feature with few values has a cut at each but the last.
    """
    fine = [np.unique(q) for q in rows.approxQuantile(list(features), np.linspace(0, 1, FINE + 1).tolist(), 1 / (2 * FINE))]
    kinds = "slot long, weight double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros(len(f) + 1) for f in fine]
        for batch in batches:
            w = batch.column(0).to_numpy(zero_copy_only=False)
            for total, f, c in zip(sums, fine, batch.columns[1:], strict=True):
                total += np.bincount(np.searchsorted(f, c.to_numpy(zero_copy_only=False)), w, len(total))
        slots = np.concatenate([np.arange(len(t)) + k * (FINE + 2) for k, t in enumerate(sums)])
        yield pa.record_batch([pa.array(slots), pa.array(np.concatenate(sums))], names=["slot", "weight"])

    summed = rows.select(F.col(weight).cast("double"), *features).mapInArrow(run, kinds).groupBy("slot").agg(F.sum("weight").alias("weight")).toPandas()
    edges = []
    for k, f in enumerate(fine):
        own = summed[summed["slot"] // (FINE + 2) == k]
        total = np.zeros(len(f) + 1)
        total[own["slot"] % (FINE + 2)] = own["weight"]
        if len(f) <= bins:
            edges.append(f[:-1])
            continue
        share = np.cumsum(total[:-1]) / max(total.sum(), 1e-300)
        edges.append(np.unique(f[np.minimum(np.searchsorted(share, np.arange(1, bins) / bins), len(f) - 1)]))
    return edges


def in_sample(ids: np.ndarray, tree: int, settings: Settings) -> np.ndarray:
    """Which rows a tree sees: by a hash of their ids, so that every pass sees the same."""
    mixed = (ids ^ np.uint64((settings.seed * 1_000_003 + tree) * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
    mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return (mixed ^ (mixed >> np.uint64(29))) >> np.uint64(11) < np.uint64(int(settings.subsample * 2**53))


def chosen_features(count: int, tree: int, settings: Settings) -> np.ndarray:
    some = max(1, int(settings.colsample * count))
    return np.sort(np.random.default_rng([settings.seed, tree]).choice(count, some, replace=False))


def best_split(g: np.ndarray, h: np.ndarray, settings: Settings) -> tuple[float, int, int]:
    """Gain, feature and bin of the best split of a node from its sums (features by bins); the first of equal ones."""
    left_g, left_h = g.cumsum(1)[:, :-1], h.cumsum(1)[:, :-1]
    total_g, total_h = g[0].sum(), h[0].sum()
    right_g, right_h = total_g - left_g, total_h - left_h
    lam = settings.reg_lambda
    gain = left_g**2 / (left_h + lam) + right_g**2 / (right_h + lam) - total_g**2 / (total_h + lam)
    gain = np.where((left_h >= settings.min_child_weight) & (right_h >= settings.min_child_weight), gain, -np.inf)
    at = int(gain.argmax()) if gain.size else 0
    return (float(gain.flat[at]), *divmod(at, gain.shape[1])) if gain.size else (-np.inf, 0, 0)


def gradients(margin: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the weighted log loss, in whole multiples of 1 / SCALE."""
    p = 1 / (1 + np.exp(-margin))
    return np.rint((p - label) * weight * SCALE), np.rint(p * (1 - p) * weight * SCALE)


def _bin_type(edges: Sequence[np.ndarray]) -> type:
    return np.uint8 if all(len(e) < 256 for e in edges) else np.uint16


def _blocks(rows: DataFrame, edges: list[np.ndarray], base: float) -> DataFrame:
    """One row for each BLOCK rows or so: their bins (features by rows), labels, weights, ids and sums of trees, as bytes."""
    kind = _bin_type(edges)

    def block(table: pa.Table) -> pa.RecordBatch:
        ids, label, weight, *columns = (c.to_numpy() for c in table.columns)
        bins = np.stack([np.searchsorted(e, c) for e, c in zip(edges, columns, strict=True)]).astype(kind)
        parts = [bins, label, weight, ids.view(np.uint64), np.full(len(ids), base)]
        return pa.record_batch([pa.array([p.tobytes()], pa.binary()) for p in parts], names=["bins", "label", "weight", "ids", "margin"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:  # Arrow's batches are smaller than a block
            held.append(batch)
            n += batch.num_rows
            if n >= BLOCK:
                yield block(pa.Table.from_batches(held))
                held, n = [], 0
        if n:
            yield block(pa.Table.from_batches(held))

    return rows.mapInArrow(run, "bins binary, label binary, weight binary, ids binary, margin binary")


def _held(rows: Iterable[tuple[bytes, ...]], features: int, kind: type, new: list[_Tree]) -> Iterator[tuple[np.ndarray, ...]]:
    """bins, label, weight, ids and margin of blocks, with the trees added that aren't written yet."""
    for row in rows:
        bins = np.frombuffer(row[0], kind).reshape(features, -1)
        label, weight, ids, margin = (np.frombuffer(x, t) for x, t in zip(row[1:], (float, float, np.uint64, float), strict=True))
        for tree in new:
            margin = margin + tree.value[tree.nodes(bins)]
        yield bins, label, weight, ids, margin


@dataclass
class _Sums:
    """Gradients and hessians of the nodes of each level of one tree, by node, chosen feature and bin.

    Of two children only that of less hessian is added up from rows: the other is what their parent has beyond it, which
    is exact, as sums are of whole numbers.
    """

    blocks: RDD
    number: int
    new: list[_Tree]
    features: int
    kind: type
    chosen: np.ndarray
    width: int
    settings: Settings
    parents: np.ndarray | None = None

    def __call__(self, tree: _Tree, level: int) -> tuple[np.ndarray, np.ndarray]:
        first, count = 2**level - 1, 2**level
        sums = np.zeros((2, count, len(self.chosen), self.width))
        if not level:
            sums[:, 0] = self.added(tree, [0])[:, 0]
        else:
            split = [k for k in range(count // 2) if tree.feature[first // 2 + k] >= 0]
            lesser = [2 * k + int(tree.cover[first + 2 * k + 1] < tree.cover[first + 2 * k]) for k in split]
            found = self.added(tree, [first + k for k in lesser])
            for place, (k, less) in enumerate(zip(split, lesser, strict=True)):
                sums[:, less] = found[:, place]
                sums[:, less ^ 1] = self.parents[:, k] - found[:, place]
        self.parents = sums
        return sums[0], sums[1]

    def added(self, tree: _Tree, nodes: Sequence[int]) -> np.ndarray:
        """Sums of the rows of some nodes.

        Each task sums its blocks to one table of a fixed size, and many tables are added in a tree of tasks: a pass is a
        single small job, which a query plan of its own would make five times as slow for few rows.
        """
        count, width = len(nodes), self.width
        slot = np.full(len(tree.feature), -1)
        slot[list(nodes)] = np.arange(count)
        number, new, features, kind, chosen, settings = self.number, self.new, self.features, self.kind, self.chosen, self.settings

        def run(rows: Iterable[tuple[bytes, ...]]) -> Iterator[np.ndarray]:
            sums = np.zeros((2, count, len(chosen), width))
            for bins, label, weight, ids, margin in _held(rows, features, kind, new):
                at = slot[tree.nodes(bins)]
                here = np.flatnonzero((at >= 0) & in_sample(ids, number, settings))
                start = at[here] * width
                both = gradients(margin[here], label[here], weight[here])
                for k, name in enumerate(chosen):
                    cells = start + bins[name][here]
                    for total, values in zip(sums, both, strict=True):
                        total[:, k] += np.bincount(cells, values, count * width).reshape(count, width)
            yield sums.astype(np.int64)

        return self.blocks.mapPartitions(run).treeReduce(np.add, 1 if self.blocks.getNumPartitions() <= FEW_TABLES else 2) / SCALE


def grow(level_sums, chosen: np.ndarray, settings: Settings) -> _Tree:
    """A tree, level by level; level_sums(tree, level) gives the sums of the level's nodes."""
    tree = _Tree.empty(settings.depth)
    leaf = lambda g, h: -g / (h + settings.reg_lambda) * settings.step
    for level in range(settings.depth):
        first = 2**level - 1
        if level and not (tree.feature[(first - 1) // 2 : first] >= 0).any():
            break
        g, h = level_sums(tree, level)
        if level == 0:
            tree.value[0], tree.cover[0] = leaf(g[0, 0].sum(), h[0, 0].sum()), h[0, 0].sum()
        for k in range(2**level):
            node = first + k
            if node and tree.feature[(node - 1) // 2] < 0:
                continue
            gain, feature, at = best_split(g[k], h[k], settings)
            if not gain > 1e-6:
                continue
            tree.feature[node], tree.bin[node], tree.gain[node] = chosen[feature], at, gain
            for child, cells in ((2 * node + 1, slice(None, at + 1)), (2 * node + 2, slice(at + 1, None))):
                g_child, h_child = g[k, feature, cells].sum(), h[k, feature, cells].sum()
                tree.value[child], tree.cover[child] = leaf(g_child, h_child), h_child
    return tree


def flatten(trees: Sequence[_Tree], edges: Sequence[np.ndarray], features: Sequence[str], fill: Sequence[float], base: float) -> TreeEnsemble:
    """One set of arrays of all trees, with thresholds in place of bins; nodes that no path reaches are left out."""
    parts: list[tuple] = []
    roots = []
    for tree in trees:
        start = len(parts)
        roots.append(start)
        place, todo = {}, [0]
        while todo:
            node = todo.pop(0)
            place[node] = start + len(place)
            if tree.feature[node] >= 0:
                todo += [2 * node + 1, 2 * node + 2]
        for node in place:
            name = int(tree.feature[node])
            inner = name >= 0
            parts.append((name, edges[name][tree.bin[node]] if inner else 0.0, place[2 * node + 1] if inner else -1, place[2 * node + 2] if inner else -1, 0.0 if inner else tree.value[node], tree.cover[node], tree.gain[node]))
    columns = [np.array(c) for c in zip(*parts, strict=True)] if parts else [np.empty(0, int) if k in (0, 2, 3) else np.empty(0) for k in range(7)]
    return TreeEnsemble(tuple(features), np.array(fill, float), float(base), np.array(roots, int), *columns)


def fit_boosted(train: DataFrame, features: Sequence[str], label: str = "churn", keys: Sequence[str] = ("customer_id", "snapshot_date"), settings: Settings = Settings()) -> TreeEnsemble:
    """Boosted trees of log loss with the classes weighed alike, and nulls at the training median.

    Each split is the best by gradients and hessians over all rows of the tree's sample: leaves are shrunk by reg_lambda,
    and no child has less hessian than min_child_weight. Rows are told apart by their keys. Raises ValueError if train
    has no rows or only one class.
    """
    counts = train.agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("p")).first()
    n, positive = counts["n"], counts["p"] or 0
    if not 0 < positive < n:
        raise ValueError(f"{positive} of {n} training rows are positive")
    weight = (n - positive) / positive
    medians = train.agg(*[F.percentile_approx(F.col(c).cast("double"), 0.5, 10_000).alias(f"m{k}") for k, c in enumerate(features)]).first()
    fill = [float(m) if m is not None else 0.0 for m in medians]
    names = [f"x{k}" for k in range(len(features))]
    value = lambda c, m: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(m)), F.lit(m))
    rows = train.select(
        F.xxhash64(*keys).alias("id"), F.col(label).cast("double").alias("y"), F.when(F.col(label) == 1, weight).otherwise(1.0).alias("w"),
        *[value(c, m).alias(x) for x, c, m in zip(names, features, fill, strict=True)],
    )
    rows = cut(rows.repartition(max(1, -(-n // ROWS_PER_TASK))))
    edges = weighted_edges(rows, names, "w", settings.bins)
    base = 0.0  # classes of equal weight
    # every level is a job, whose tasks hold a block at a time: as many as there are cores take the least time to start
    blocks = _written(_blocks(rows.coalesce(train.sparkSession.sparkContext.defaultParallelism), edges, base).rdd.map(tuple))
    width, kind = max(2, *(len(e) + 1 for e in edges)), _bin_type(edges)
    trees: list[_Tree] = []
    written = 0
    try:
        for number in range(settings.trees):
            if number - written == KEPT_TREES:
                older, blocks = blocks, _written(_with_trees(blocks, trees[written:], len(names), kind))
                older.unpersist()
                written = number
            chosen = chosen_features(len(names), number, settings)
            trees.append(grow(_Sums(blocks, number, trees[written:], len(names), kind, chosen, width, settings), chosen, settings))
    finally:
        blocks.unpersist()
    return flatten(trees, edges, features, fill, base)


def _written(blocks: RDD) -> RDD:
    """blocks, written once to the shared folder, and kept by the executors as far as they have room.

    They are kept as Python objects: rows of a DataFrame would be turned to such at every level of every tree, which takes
    several times as long as their sums.
    """
    blocks = blocks.persist(StorageLevel.MEMORY_AND_DISK)
    blocks.checkpoint()
    blocks.count()
    return blocks


def _with_trees(blocks: RDD, new: list[_Tree], features: int, kind: type) -> RDD:
    def run(rows: Iterable[tuple[bytes, ...]]) -> Iterator[tuple[bytes, ...]]:
        for row in rows:
            margin = next(_held([row], features, kind, new))[-1]
            yield *row[:-1], margin.tobytes()

    return blocks.mapPartitions(run)
