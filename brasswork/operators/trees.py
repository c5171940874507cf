"""Ensembles of binary trees as flat arrays, and exact additive attributions of their scores.

The part of a feature in a row's log-odds is its Shapley value in the game in which a tree follows the row at splits on
known features and averages both children, by the training weight that reached them, at splits on unknown ones. A leaf
counts only through the set of its path's features that the row satisfies, so each leaf has a small table from such sets
to the parts of its features. The tables of a tree's leaves are added to one, by the bins of its features between its own
thresholds, made once; rows then look their cells up, once for a tree.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import cached_property
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, DoubleType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from brasswork.session import shared_folder

ROWS_AT_ONCE = 4096  # rows looked up together
MOST_CELLS = 4096  # cells of a table; the leaves of a tree that would need more are dealt to several tables
UDTF_ROWS = 1024  # rows that the table function works on together
MOST_ON_A_PATH = 12  # different features on a path; a leaf's table has 2 to this power rows


@dataclass(frozen=True)
class TreeEnsemble:
    """Trees over features; a row goes left where its value is at most the threshold. Leaves have feature -1.

    left and right are places in the same arrays, value is what a leaf adds to the log-odds, cover the training weight
    that reached a node, fill what stands for a null or NaN of each feature, base the log-odds without any tree.
    """

    features: tuple[str, ...]
    fill: np.ndarray
    base: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    cover: np.ndarray
    gain: np.ndarray = field(default_factory=lambda: np.empty(0))

    @cached_property
    def leaves(self) -> _Leaves:
        return _Leaves(self)

    @cached_property
    def expected(self) -> float:
        """The mean log-odds over the training weight: what attributions of a row add to."""
        return self.base + float((self.leaves.value * self.leaves.reach).sum())

    def matrix(self, columns: Sequence[pa.Array]) -> np.ndarray:
        """Rows by features, with nulls filled."""
        table = [np.asarray(c.to_numpy(zero_copy_only=False), float) for c in columns]
        out = np.stack(table, 1) if table else np.empty((0, 0))
        return np.where(np.isnan(out), self.fill, out)

    def log_odds(self, rows: np.ndarray) -> np.ndarray:
        out = np.full(len(rows), self.base)
        every = np.arange(len(rows))
        for root in self.roots:
            at = np.full(len(rows), root)
            while (inner := self.feature[at] >= 0).any():
                down = rows[every, np.maximum(self.feature[at], 0)] <= self.threshold[at]
                at = np.where(inner, np.where(down, self.left[at], self.right[at]), at)
            out += self.value[at]
        return out

    def attributions(self, rows: np.ndarray) -> np.ndarray:
        """Rows by features; the parts of a row and `expected` add to its log-odds."""
        return self.explained(rows)[0]

    def explained(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """attributions and log_odds of rows, from the same lookups."""
        return self.leaves.looked_up(rows, len(self.features), self.base)

    def gains(self, top: int = 15) -> list[tuple[str, float]]:
        """Features by the gain of their splits, as shares of all gain."""
        total = np.zeros(len(self.features))
        inner = self.feature >= 0
        np.add.at(total, self.feature[inner], self.gain[inner])
        shares = total / total.sum() if total.sum() else total
        return sorted(zip(self.features, shares.tolist(), strict=True), key=lambda x: (-x[1], x[0]))[:top]


class _Leaves:
    """Values and reach of all leaves, and tables of the parts of those that lie in one tree."""

    def __init__(self, trees: TreeEnsemble):
        paths = [list(_paths(trees, int(root))) for root in trees.roots]
        every = [leaf for leaves in paths for leaf in leaves]
        self.value = np.array([v for v, _ in every])
        self.reach = np.array([np.prod([z for _, _, z in path.values()]) for _, path in every])
        width = max((len(path) for _, path in every), default=0)
        if width > MOST_ON_A_PATH:
            raise ValueError(f"a path with {width} different features; at most {MOST_ON_A_PATH}")
        self.cuts = [np.unique(trees.threshold[trees.feature == k]) for k in range(len(trees.features))]
        self.tables = [table for leaves in paths for table in _tables(leaves, self.cuts)]

    def looked_up(self, rows: np.ndarray, features: int, base: float) -> tuple[np.ndarray, np.ndarray]:
        out, odds = np.zeros((len(rows), features)), np.full(len(rows), base)
        for start in range(0, len(rows), ROWS_AT_ONCE):
            some = rows[start : start + ROWS_AT_ONCE]
            bins = [np.searchsorted(cuts, some[:, k]) for k, cuts in enumerate(self.cuts)]
            total, whole = np.zeros((features, len(some))), odds[start : start + len(some)]
            for table in self.tables:
                cell = sum((place[bins[k]] for k, place in zip(table.features, table.places, strict=True)), 0)
                whole += table.value[cell]
                for k, own in zip(table.features, table.parts, strict=True):
                    total[k] += own[cell]
            out[start : start + len(some)] = total.T
        return out, odds


@dataclass(frozen=True)
class _Table:
    """What some leaves of a tree add to the log-odds and to the parts of their features, by cells: the places of a row's
    bins add to its cell.
    """

    features: list[int]
    places: list[np.ndarray]
    value: np.ndarray
    parts: np.ndarray


def _tables(leaves: Sequence[tuple[float, dict[int, tuple[float, float, float]]]], cuts: Sequence[np.ndarray]) -> Iterator[_Table]:
    """Tables of leaves: bins of a feature that lie in the same leaves' intervals are one in a cell."""
    features = sorted({name for _, path in leaves for name in path})
    if not features:  # a tree without a split
        yield _Table([], [], np.array([value for value, _ in leaves]), np.empty((0, 1)))
        return
    kinds, inside = [], []  # of each feature: the kind of each bin, and which leaves' intervals hold each kind
    for name in features:
        low, high = (np.array([path.get(name, (-np.inf, np.inf))[side] for _, path in leaves]) for side in (0, 1))
        # bin i holds the values above cut i - 1, up to cut i
        below, upto = np.append(-np.inf, cuts[name]), np.append(cuts[name], np.inf)
        held, kind = np.unique((below[:, None] >= low) & (upto[:, None] <= high), axis=0, return_inverse=True)
        kinds.append(kind.ravel())
        inside.append(held)
    shape = [len(held) for held in inside]
    if np.prod(np.array(shape, float)) > MOST_CELLS and len(leaves) > 1:
        yield from _tables(leaves[: len(leaves) // 2], cuts)
        yield from _tables(leaves[len(leaves) // 2 :], cuts)
        return
    cells = np.indices(shape).reshape(len(shape), -1)
    total, parts = np.zeros(cells.shape[1]), np.zeros((len(features), cells.shape[1]))
    for k, (value, path) in enumerate(leaves):
        at = [features.index(name) for name in path]
        sets = sum((inside[j][cells[j], k].astype(int) << bit for bit, j in enumerate(at)), np.zeros(cells.shape[1], int))
        own = value * _parts_by_set(np.array([z for _, _, z in path.values()]))
        total[sets == len(own) - 1] = value
        for bit, j in enumerate(at):
            parts[j] += own[sets, bit]
    strides = [int(np.prod(shape[j + 1 :])) for j in range(len(shape))]
    yield _Table(features, [kind * stride for kind, stride in zip(kinds, strides, strict=True)], total, parts)


def _paths(trees: TreeEnsemble, root: int) -> Iterator[tuple[float, dict[int, tuple[float, float, float]]]]:
    """For each leaf below root: its value, and for each feature of its path the interval and the share of the weight."""
    todo: list[tuple[int, dict[int, tuple[float, float, float]]]] = [(root, {})]
    while todo:
        at, path = todo.pop()
        name = int(trees.feature[at])
        if name < 0:
            yield float(trees.value[at]), path
            continue
        low, high, share = path.get(name, (-np.inf, np.inf, 1.0))
        cut = float(trees.threshold[at])
        for child, bounds in ((int(trees.left[at]), (low, min(high, cut))), (int(trees.right[at]), (max(low, cut), high))):
            ratio = float(trees.cover[child] / trees.cover[at]) if trees.cover[at] else 0.5
            todo.append((child, path | {name: (*bounds, share * ratio)}))


def _parts_by_set(share: np.ndarray) -> np.ndarray:
    """For each set of satisfied features (a row of bits) and each of the m features: its Shapley value in the game in
    which a coalition is worth the product of what its members say (1 or 0) and the shares of the others.
    """
    m = len(share)
    sets = (np.arange(2**m)[:, None] >> np.arange(m) & 1).astype(float)
    weights = np.array([factorial(k) * factorial(m - 1 - k) / factorial(m) for k in range(m)])
    out = np.zeros((2**m, m))
    for own in range(m):
        # coefficients by the number of members: the product of (share + satisfied * t) over the other features
        by_size = np.zeros((2**m, m))
        by_size[:, 0] = 1.0
        for other in range(m):
            if other != own:
                raised = by_size * share[other]
                raised[:, 1:] += by_size[:, :-1] * sets[:, [other]]
                by_size = raised
        out[:, own] = (sets[:, own] - share[own]) * (by_size @ weights)
    return out


def ensemble_of(model: PipelineModel) -> TreeEnsemble:
    """The boosted trees that `churn.fit_model` gives, as flat arrays, read from the model's own saved nodes."""
    imputer, assembler, trees = model.stages
    features = tuple(imputer.getInputCols())
    spark = imputer.surrogateDF.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    trees.write().save(path)
    nodes = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").orderBy("treeID", "id").toPandas()
    # a tree's nodes are numbered from 0 on; the model adds twice the weighted sum of its trees to the log-odds
    sizes = nodes.groupby("treeID").size()
    first = (sizes.cumsum() - sizes).reindex(nodes["treeID"]).to_numpy()
    inner = nodes["leftChild"].to_numpy() >= 0
    weights = np.array(trees.treeWeights)[nodes["treeID"].to_numpy()]
    cuts = [(-1, 0.0) if not i else (s["featureIndex"], s["leftCategoriesOrThreshold"][0]) for i, s in zip(inner, nodes["split"], strict=True)]
    fill = np.array([float(imputer.surrogateDF.first()[c]) for c in features])
    return TreeEnsemble(
        features, fill, 0.0, (sizes.cumsum() - sizes).to_numpy(), np.array([c[0] for c in cuts]), np.array([c[1] for c in cuts]),
        np.where(inner, first + nodes["leftChild"], -1), np.where(inner, first + nodes["rightChild"], -1),
        np.where(inner, 0.0, 2 * weights * nodes["prediction"]), np.array([s[0] for s in nodes["impurityStats"]]), np.where(inner, nodes["gain"], 0.0),
    )


def attributed(trees: TreeEnsemble, frame: DataFrame, keep: Sequence[str]) -> DataFrame:
    """The columns of keep, log_odds, expected, values and contributions (arrays in the order of the features).

    Contributions and expected add to log_odds. Rows are worked on where they lie, without a shuffle. Nulls take the
    value that filled them in training, which `values` tells.
    """
    rows = frame.select(*keep, *[F.col(c).cast("double").alias(f"feature_{k}") for k, c in enumerate(trees.features)])
    schema = StructType(rows.schema.fields[: len(keep)])
    schema = schema.add("log_odds", "double").add("expected", "double").add("values", ArrayType(DoubleType())).add("contributions", ArrayType(DoubleType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = trees.matrix(batch.columns[len(keep) :])
            parts, odds = trees.explained(x)
            base = np.full(len(x), trees.expected)
            ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(trees.features), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(a.ravel())) for a in (x, parts)]
            yield pa.record_batch([*batch.columns[: len(keep)], pa.array(odds), pa.array(base), *lists], names=schema.names)

    return rows.mapInArrow(run, schema)


def scored(trees: TreeEnsemble, frame: DataFrame, keep: Sequence[str], into: str = "churn_score") -> DataFrame:
    """The columns of keep and the probability of the label."""
    rows = frame.select(*keep, *[F.col(c).cast("double").alias(f"feature_{k}") for k, c in enumerate(trees.features)])
    schema = StructType(rows.schema.fields[: len(keep)]).add(into, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            odds = trees.log_odds(trees.matrix(batch.columns[len(keep) :]))
            yield pa.record_batch([*batch.columns[: len(keep)], pa.array(1 / (1 + np.exp(-odds)))], names=schema.names)

    return rows.mapInArrow(run, schema)


def reasons(trees: TreeEnsemble, frame: DataFrame, keep: Sequence[str], most: int = 6) -> DataFrame:
    """The largest contributions of each row by size, ties by name: keep, feature_rank, feature, feature_value, contribution."""
    names = F.array(*[F.lit(c) for c in trees.features])
    each = F.transform(F.arrays_zip(names.alias("feature"), "values", "contributions"), lambda x: F.struct((-F.abs(x["contributions"])).alias("size"), x["feature"].alias("feature"), x["values"].alias("value"), x["contributions"].alias("part")))
    top = attributed(trees, frame, keep).select(*keep, F.posexplode(F.slice(F.array_sort(each), 1, most)).alias("place", "reason"))
    return top.select(*keep, (F.col("place") + 1).alias("feature_rank"), F.col("reason.feature").alias("feature"), F.col("reason.value").alias("feature_value"), F.col("reason.part").alias("contribution"))


def reason_table(trees: TreeEnsemble, label: str = "churn_score"):
    """A table function for SQL and DataFrames, as in `SELECT * FROM reasons(TABLE(rows), 'customer_id', 6)`.

    It takes any table that has the features. analyze tells from the call which column is the key and of which kind it is.
    For each row the function gives the key, the score, and the largest contributions with their ranks. Rows are worked on
    where they lie, UDTF_ROWS together.
    """
    names = trees.features

    class Reasons:
        @staticmethod
        def analyze(rows: AnalyzeArgument, key: AnalyzeArgument, most: AnalyzeArgument | None = None) -> AnalyzeResult:
            fields = {f.name: f.dataType for f in rows.dataType.fields} if rows.isTable else {}
            missing = [c for c in (key.value, *names) if c not in fields]
            if missing:
                raise ValueError(f"the table has no {', '.join(map(str, missing))}")
            schema = StructType().add(key.value, fields[key.value]).add(label, "double").add("feature_rank", "integer").add("feature", "string")
            return AnalyzeResult(schema.add("feature_value", "double").add("contribution", "double"))

        def __init__(self):
            self.keys, self.rows, self.most = [], [], 6

        def eval(self, rows: Row, key: str, most: int | None = None):
            self.most = 6 if most is None else most
            self.keys.append(rows[key])
            self.rows.append([np.nan if rows[c] is None else float(rows[c]) for c in names])
            if len(self.rows) == UDTF_ROWS:
                yield from self.told()

        def terminate(self):
            if self.rows:
                yield from self.told()

        def told(self):
            x = np.array(self.rows)
            x = np.where(np.isnan(x), trees.fill, x)
            parts, odds = trees.explained(x)
            chance = 1 / (1 + np.exp(-odds))
            by_name = np.argsort(np.array(names, object), kind="stable")
            order = by_name[np.argsort(-np.abs(parts[:, by_name]), axis=1, kind="stable")][:, : self.most]
            for key, score, own, values, each in zip(self.keys, chance.tolist(), order.tolist(), x.tolist(), parts.tolist(), strict=True):
                for place, k in enumerate(own, 1):
                    yield key, score, place, names[k], values[k], each[k]
            self.keys, self.rows = [], []

    return udtf(Reasons)


def importance(trees: TreeEnsemble, frame: DataFrame, top: int = 15) -> DataFrame:
    """feature, importance: the mean absolute contribution over all rows, largest first. One aggregation, a column a feature."""
    parts = attributed(trees, frame, ())
    means = parts.agg(*[F.avg(F.abs(F.col("contributions")[k])).alias(f"mean_{k}") for k in range(len(trees.features))])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.round(F.col(f"mean_{k}"), 6).alias("importance")) for k, c in enumerate(trees.features)]))
    return means.select(rows.alias("row")).select("row.*").orderBy(F.desc("importance"), "feature").limit(top)
