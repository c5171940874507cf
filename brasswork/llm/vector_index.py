"""Exact top-k search by inner product with a pivot-distance index (operator 10).

Vectors are keyed by their nearest pivot and the distance to it and dealt in that order to parts, and within a part to
blocks: each block is part of an annulus around a pivot. For a query at distance d from the pivot, no vector of an
annulus lies nearer than the gap between d and the annulus; with the annulus's largest norm this bounds the inner product.

A query first searches the part it lies in itself, which gives it a k-th best score to beat. Bounds of all other parts
are told from a row or so for each part; only parts that may still hold a better score for a query of a group are sent to
that group, and there annuli are expanded from the most promising on until the bound falls below the k-th best score.

Everything is exact: scores are inner products of integer vectors, and bounds are widened by more than the rounding
error of distances.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brasswork.llm.common import Scratch

#: Bounds are raised by this part of the norms, far over the rounding error of double arithmetic.
SLACK = 1e-9
#: No score is so low, no id so high.
LOW, NO_ID = -(2**62), 2**63 - 1
#: A row is a block of vectors, or (asks) the queries of a part with the best scores and ids that their own part holds.
ROW = pa.schema([("part", pa.int32()), ("asks", pa.bool_()), ("pivot", pa.int32()), ("near", pa.float64()), ("far", pa.float64()), ("norm", pa.float64()), ("n", pa.int32()), ("ids", pa.binary()), ("matrix", pa.binary()), ("best", pa.binary()), ("best_ids", pa.binary())])
ROW_SQL = "part int, asks boolean, pivot int, near double, far double, norm double, n int, ids binary, matrix binary, best binary, best_ids binary"


def quantised(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id and v, an array of floor(scale * x); rows with a null id or vector or a component that isn't finite go.

    Vectors that are shorter than the longest one are put out with zeros, which change no inner product.
    """
    x = F.col("embedding")
    wrong = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    usable = embeddings.where(F.col("vec_id").isNotNull() & x.isNotNull() & ~wrong)
    width = max(1, usable.agg(F.max(F.size(x))).first()[0] or 1)
    own = usable.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("v"))
    zeros = F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("v"))
    return own.select("vec_id", F.when(F.size("v") == width, F.col("v")).otherwise(F.concat("v", zeros)).alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    """A batch of arrays of one length, as rows."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def fit_pivots(vectors: DataFrame, pivots: int, sample_rows: int, seed: int = 5, steps: int = 8) -> np.ndarray:
    """Centres of a bounded sample (the rows of least id hash), by k-means. Any pivots give right results."""
    few = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).toArrow()
    if not few.num_rows:
        return np.zeros((1, 1))
    x = np.unique(_matrix(few["v"]), axis=0)
    centres = x[np.random.default_rng(seed).permutation(len(x))[:pivots]]
    for _ in range(steps):
        nearest = _distances(x, centres).argmin(1)
        centres = np.array([x[nearest == k].mean(0) if (nearest == k).any() else centres[k] for k in range(len(centres))])
    return centres


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (centres * centres).sum(1)[None] - 2 * x @ centres.T, 0))


def keyed(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """Adds pivot and distance to vec_id, v and asks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            away = _distances(_matrix(batch.column("v")), centres)
            pivot = away.argmin(1)
            yield pa.record_batch([*batch.columns, pa.array(pivot, pa.int32()), pa.array(away[np.arange(len(pivot)), pivot])], names=["vec_id", "v", "asks", "pivot", "distance"])

    return vectors.mapInArrow(run, "vec_id long, v array<long>, asks boolean, pivot int, distance double")


def _packed(pivot: int | None, away: np.ndarray, ids: np.ndarray, x: np.ndarray) -> dict:
    norm = float(np.sqrt((x * x).sum(1).max()))
    return {"pivot": pivot, "near": float(away[0]), "far": float(away[-1]), "norm": norm, "n": len(ids), "ids": ids.tobytes(), "matrix": x.astype(np.int64).tobytes()}


def build_index(spark: SparkSession, scratch: Scratch, vectors: DataFrame, queries: DataFrame, centres: np.ndarray, k: int, rows_per_part: int = 16384, rows_per_block: int = 1024) -> tuple[DataFrame, int]:
    """The index in the shared folder, and the number of its parts. Ranges of (pivot, distance, id) split popular pivots and repeated vectors.

    Queries are dealt with the vectors, so that a part's queries lie where its vectors lie; a task holds one part.
    """
    rows = vectors.withColumn("asks", F.lit(False)).union(queries.withColumn("asks", F.lit(True)))
    table = scratch.keep(keyed(rows, centres), "keyed")
    parts = max(1, -(-table.count() // rows_per_part))
    ranged = table.repartitionByRange(parts, "pivot", "distance", "vec_id").sortWithinPartitions("pivot", "distance", "vec_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column("pivot").to_numpy(), b.column("distance").to_numpy(), b.column("vec_id").to_numpy(), _matrix(b.column("v")), b.column("asks").to_numpy(zero_copy_only=False).astype(bool)) for b in batches if b.num_rows]
        if not held:
            return
        part = TaskContext.get().partitionId()
        pivots, away, ids, x, asks = (np.concatenate([h[i] for h in held]) for i in range(5))
        held.clear()
        asked, asking = ids[asks], x[asks]
        pivots, away, ids, x = (column[~asks] for column in (pivots, away, ids, x))
        blocks, start = [], 0
        while start < len(ids):
            end = min(start + rows_per_block, int(np.searchsorted(pivots, pivots[start], "right")))
            blocks.append({"part": part, "asks": False} | _packed(int(pivots[start]), away[start:end], ids[start:end], x[start:end]))
            start = end
        for block in blocks:
            yield pa.RecordBatch.from_pylist([block], ROW)
        if len(asked):
            best = _search(asking, asked, blocks, centres, k, np.full(len(asked), LOW))
            own = _packed(None, np.zeros(1), asked, asking) | {"part": part, "asks": True, "best": best.scores.tobytes(), "best_ids": best.ids.tobytes()}
            yield pa.RecordBatch.from_pylist([own], ROW)

    index = scratch.keep(ranged.mapInArrow(run, ROW_SQL), "index")
    scratch.drop("keyed")
    return index, parts


class _Best:
    """The k best of each query so far: higher scores first, smaller ids on ties."""

    def __init__(self, ids: np.ndarray, k: int, floor: np.ndarray):
        self.own, self.k, self.floor = ids, k, floor
        self.scores = np.full((len(ids), k), LOW)
        self.ids = np.full((len(ids), k), NO_ID)

    def least(self) -> np.ndarray:
        return np.maximum(self.scores[:, -1], self.floor)

    def offer(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Scores of some queries (rows) with all of ids. Only the best k and all that tie with the k-th of a query matter."""
        scores = np.where(ids[None] == self.own[rows][:, None], LOW, scores)
        k = min(self.k, len(ids))
        kth = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
        bar = np.maximum(kth, self.least()[rows])
        for i in np.flatnonzero((scores >= bar[:, None]).any(1)):
            at = np.flatnonzero((scores[i] >= bar[i]) & (scores[i] > LOW))
            if len(at):
                s, d = np.concatenate([self.scores[rows[i]], scores[i, at]]), np.concatenate([self.ids[rows[i]], ids[at]])
                order = np.lexsort((d, -s))[: self.k]
                self.scores[rows[i]], self.ids[rows[i]] = s[order], d[order]


def _bounds(queries: np.ndarray, away: np.ndarray, near: np.ndarray, far: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """For each query and annulus, what no inner product exceeds; away is the distance of each query to each annulus's pivot."""
    size = np.sqrt((queries * queries).sum(1))
    gap = np.maximum(np.maximum(near[None] - away, away - far[None]), 0)
    slack = SLACK * (size[:, None] + norm[None] + away + 1) ** 2
    # 2 q.v = |q|^2 + |v|^2 - |q - v|^2; and q.v is at most |q||v|
    return np.minimum((size[:, None] ** 2 + norm[None] ** 2 - gap**2) / 2, size[:, None] * norm[None]) + slack


def _search(queries: np.ndarray, ids: np.ndarray, blocks: list[dict], centres: np.ndarray, k: int, floor: np.ndarray) -> _Best:
    """The best k of these blocks for each query; of scores under the floor none is sought."""
    best = _Best(ids, k, floor)
    if not blocks:
        return best
    pivots = np.array([b["pivot"] for b in blocks], int)
    near, far, norm = (np.array([b[c] for b in blocks]) for c in ("near", "far", "norm"))
    bound = _bounds(queries, _distances(queries, centres)[:, pivots], near, far, norm)
    for j in np.argsort(-bound.max(0)):  # the most promising annuli first
        rows = np.flatnonzero(bound[:, j] >= best.least())
        if not len(rows):
            continue  # every query has stopped before this annulus
        other = np.frombuffer(blocks[j]["matrix"], np.int64).reshape(blocks[j]["n"], -1)
        products = np.rint(queries[rows] @ other.T.astype(np.float64)).astype(np.int64)  # whole numbers under 2**53: exact
        best.offer(rows, np.frombuffer(blocks[j]["ids"], np.int64), products)
    return best


def _asked(row, k: int) -> tuple[np.ndarray, ...]:
    """Ids, vectors, best scores and best ids of a part's queries."""
    ids = np.frombuffer(row["ids"], np.int64)
    x = np.frombuffer(row["matrix"], np.int64).reshape(len(ids), -1).astype(np.float64)
    return ids, x, *(np.frombuffer(row[c], np.int64).reshape(len(ids), k) for c in ("best", "best_ids"))


def _rows(ids: np.ndarray, scores: np.ndarray, others: np.ndarray) -> pd.DataFrame:
    at = others < NO_ID
    return pd.DataFrame({"query_id": np.repeat(ids, at.sum(1)), "vec_id": others[at], "score": scores[at]})


def top_k(spark: SparkSession, embeddings: DataFrame, is_query: Column, k: int = 5, pivots: int = 32, sample_rows: int = 4096, rows_per_part: int = 16384) -> DataFrame:
    """query_id, rank, vec_id, score: for each row that is_query holds for, the k best of all other rows.

    Rows that share an id with the query are its own row; of repeated query ids the least vector asks. Repeated ids
    among candidates are ranked like any others. Shorter vectors count as if zeros followed. An empty table gives no
    rows; columns other than vec_id and embedding are left out.
    """
    scratch = Scratch(spark)
    vectors = quantised(embeddings)
    centres = fit_pivots(vectors, pivots, sample_rows)
    queries = vectors.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    index, parts = build_index(spark, scratch, vectors, queries, centres, k, rows_per_part)
    asked = index.where("asks").select(F.col("part").alias("qgroup"), "ids", "matrix", "best", "best_ids")
    blocks = scratch.read("index", index.schema).where("not asks").select("part", "pivot", "near", "far", "norm", "n", "ids", "matrix")

    # a few numbers for each part meet each group of queries: the stated query set against all rows, in blocks
    annuli = blocks.groupBy("part", "pivot").agg(F.min("near").alias("near"), F.max("far").alias("far"), F.max("norm").alias("norm"))
    groups = index.agg(F.max("part")).first()[0]
    spread = annuli.select("*", F.explode(F.sequence(F.lit(0), F.lit(groups or 0))).alias("qgroup")).where("part <> qgroup")

    def prune(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"qgroup": np.empty(0, np.int32), "part": np.empty(0, np.int32)})
        _, x, best, _ = _asked(left.iloc[0], k)
        away = _distances(x, centres)
        near, far, norm, pivot, part = (right[c].to_numpy() for c in ("near", "far", "norm", "pivot", "part"))
        open_ = np.zeros(len(right), bool)
        for start in range(0, len(right), 4096):
            cut = slice(start, start + 4096)
            open_[cut] = (_bounds(x, away[:, pivot[cut]], near[cut], far[cut], norm[cut]) >= best[:, -1:]).any(0)
        found = np.unique(part[open_]).astype(np.int32)
        return pd.DataFrame({"qgroup": np.full(len(found), key[0], np.int32), "part": found})

    pairs = asked.groupBy("qgroup").cogroup(spread.groupBy("qgroup")).applyInPandas(prune, "qgroup int, part int")
    pairs = scratch.keep(pairs, "pairs")

    def search(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return _rows(np.empty(0, np.int64), *np.empty((2, 0, k), np.int64))
        ids, x, best, _ = _asked(left.iloc[0], k)
        found = _search(x, ids, right.to_dict("records"), centres, k, best[:, -1])
        return _rows(ids, found.scores, found.ids)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, _, best, best_ids = _asked(row, k)
                yield pa.RecordBatch.from_pandas(_rows(ids, best, best_ids), preserve_index=False)

    sought = blocks.join(pairs, "part")
    asking = asked.join(pairs, "qgroup")
    kinds = "query_id long, vec_id long, score long"
    found = asking.groupBy("qgroup", "part").cogroup(sought.groupBy("qgroup", "part")).applyInPandas(search, kinds)
    found = found.union(asked.mapInArrow(first, kinds))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
