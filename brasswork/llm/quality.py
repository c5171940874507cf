"""Quality classifier: naive Bayes features in a linear support vector machine (operator 9).

A text is a set of n-grams: of its words, and of their shapes (case, repetition, marks), both hashed. Each n-gram
indicator is scaled by the log ratio of its frequency in the two classes; a hinge-loss machine is fitted on these by
dual coordinate descent, its weights are drawn towards their mean as usual for this method, and its margins are
turned into scores by logistic regression.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brasswork.llm.common import doc_texts, held_out, slices
from brasswork.llm.linear import fit_hinge, fit_logistic, margin, sigmoid

BITS = 18
_TOKEN = re.compile(r"\w+|[^\w\s]+|\n")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shape_of(token: str) -> int:
    """A small number for the kind of a token; marks are told apart by their text."""
    if token[0].isalpha():
        kind = "upper" if len(token) > 1 and token.isupper() else "title" if token[0].isupper() else "lower"
        return zlib.crc32(f"{kind}{min(len(token), 12) // 4}".encode())
    return zlib.crc32(token[:4].encode()) if not token[0].isdigit() else 1


class _Codes(dict):
    """Hash and shape of tokens, for the first limit tokens kept."""

    def __init__(self, limit: int = 300_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, token: str) -> int:
        value = zlib.crc32(token.lower().encode()) << 32 | shape_of(token)
        if len(self) < self.limit and len(token) <= 32:
            self[token] = value
        return value


_CODES = _Codes()


def indicators(text: str) -> np.ndarray:
    """Sorted hashed places of the n-grams that occur in a whole text."""
    tokens = _TOKEN.findall(text)
    codes = np.fromiter(map(_CODES.__getitem__, tokens), np.uint64, len(tokens))
    words, shapes = codes >> np.uint64(32), codes & np.uint64(0xFFFFFFFF)
    same = np.zeros(len(codes), bool)
    same[1:] = words[1:] == words[:-1]
    shapes = np.where(same, np.uint64(3), shapes)
    found = [words * np.uint64(3) + np.uint64(1)]
    found.append((words[:-1] * _MIX ^ words[1:]) * np.uint64(5) + np.uint64(2))
    one = shapes * np.uint64(7) + np.uint64(3)
    two = one[:-1] * _MIX + one[1:]
    three = two[:-1] * _MIX + one[2:]
    four = three[:-1] * _MIX + one[3:]
    found += [one, two, three, four]
    grams = np.concatenate(found) * _MIX
    present = np.zeros(1 << BITS, bool)
    present[((grams ^ (grams >> np.uint64(29))) * _MIX) >> np.uint64(64 - BITS)] = True
    return np.flatnonzero(present)


@dataclass
class Model:
    weights: np.ndarray
    intercept: float
    slope: float
    offset: float

    def score(self, places: np.ndarray) -> float:
        value = float(self.weights[places].sum()) / np.sqrt(max(1, len(places))) + self.intercept
        return float(sigmoid(self.slope * value + self.offset))


def fit(rows: list[np.ndarray], labels: np.ndarray, smoothing: float = 1.0, mixing: float = 0.5) -> Model:
    """Rows are sorted places; a row's indicators are scaled to length one. Without both classes every score is the share of label 1."""
    width = 1 << BITS
    share = float(labels.mean()) if len(labels) else 0.5
    if share in (0.0, 1.0) or not len(labels):
        return Model(np.zeros(width), 0.0, 0.0, float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    counts = {c: np.full(width, smoothing) for c in (0, 1)}
    for places, label in zip(rows, labels, strict=True):
        counts[int(label)][places] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    scaled = [(places, ratio[places] / np.sqrt(max(1, len(places)))) for places in rows]
    signs = np.where(labels > 0, 1, -1)
    weights, intercept = fit_hinge(scaled, signs, width, epochs=10, tolerance=0.01)
    used = np.abs(weights[weights != 0])
    weights = (1 - mixing) * (used.mean() if len(used) else 0.0) + mixing * weights
    margins = np.array([margin(row, weights, intercept) for row in scaled])
    slope, offset = fit_logistic(margins[:, None], labels)
    return Model((weights * ratio).astype(np.float32), intercept, float(slope), float(offset))


def fit_sample(sample: DataFrame) -> Model:
    """From rows of text and label; repeated texts count once, so that groups of copies don't decide."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [indicators(t).astype(np.int32) for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("label").cast(pa.int32()), pa.array(rows, pa.list_(pa.int32()))], names=["label", "places"])

    found = sample.select("text", F.col("label").cast("int").alias("label")).mapInArrow(run, "label int, places array<int>").toArrow()
    distinct = {}
    for label, places in zip(found["label"].to_pylist(), found["places"], strict=True):
        row = places.values.to_numpy() if places.values is not None else np.empty(0, np.int32)
        distinct[row.tobytes(), label] = row
    ordered = sorted(distinct)
    return fit([distinct[k].astype(np.int64) for k in ordered], np.array([k[1] for k in ordered], float))


def score_documents(documents: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for each row.

    A null text counts as empty and has the score of a text without n-grams; texts of any length are read whole; repeated rows
    get equal scores; a null doc_id is never held out. Other columns are left out, an empty table gives no rows.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)  # a table of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            scores = [shared.value.score(indicators(t)) for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    scored = doc_texts(documents).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
