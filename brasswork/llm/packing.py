"""Best-fit packing with certified bin counts (operator 6).

Documents become pieces of at most `capacity` tokens. The pieces are dealt to buckets by a hash; each bucket is
packed by best-fit decreasing, and dual-feasible functions give a lower bound of its number of bins. A bucket that
meets its bound is done. The others give up the documents of bins that aren't full, which are dealt anew among these
buckets and packed again; that packing replaces the old one where it takes fewer bins.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brasswork.llm.common import Scratch, doc_texts, slices
from brasswork.llm.token_ids import encoder

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
NAMES = ["doc_id", "piece", "start", "length", "ids_crc32"]
PLACE = "sequence_id long, offset long"


def cut_lengths(total: int, capacity: int) -> list[int]:
    """Lengths of a document's pieces: all are full but the first, which takes what is left over."""
    first = total % capacity
    return [first] * bool(first) + [capacity] * (total // capacity)


def piece_rows(documents: DataFrame, path: str, pattern: str, end_id: int, capacity: int) -> DataFrame:
    """One row for each piece. A null or empty text gives one piece that holds end_id alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, tail = encoder(path, pattern), np.array([end_id], "<u4").tobytes()
        for batch in slices(batches):
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids, start = memoryview(own.encode(text) + tail), 0
                for piece, length in enumerate(cut_lengths(len(ids) // 4, capacity)):
                    rows.append((doc_id, piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])))
                    start += length
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=NAMES)

    return doc_texts(documents).mapInArrow(run, PIECE)


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each of these lengths, which must be given in descending order."""
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    some = 0  # bit r is set if a bin has r tokens of room
    bins, opened = np.empty(len(lengths), np.int64), 0
    for i, length in enumerate(lengths.tolist()):
        fitting = some >> length
        if fitting:
            left = length + (fitting & -fitting).bit_length() - 1
            at = room[left].pop()
            if not room[left]:
                some &= ~(1 << left)
        else:
            at, left, opened = opened, capacity, opened + 1
        bins[i] = at
        left -= length
        room[left].append(at)
        some |= 1 << left
    return bins


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """No packing takes fewer bins: the best of two families of dual-feasible functions.

    One counts lengths over capacity - k as whole bins and drops those under k; the other rounds (k + 1) times a
    length down to multiples of the capacity unless it is one.
    """
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1)
    best = -(-int((count * size).sum()) // capacity)
    number, total = np.cumsum(count), np.cumsum(count * size)
    for k in range(1, capacity // 2 + 1):
        large = number[capacity] - number[capacity - k]
        middle = total[capacity - k] - total[k - 1]
        best = max(best, int(large) - (-int(middle) // capacity))
    for k in range(1, 33):
        scaled = (k + 1) * size
        value = np.where(scaled % capacity == 0, size * k, scaled // capacity * capacity)  # in units of 1 / (k * capacity)
        best = max(best, -(-int((count * value).sum()) // (k * capacity)))
    return best


def pack_bucket(frame: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Adds to one bucket's pieces: bin, offset, room (of the bin), gap (bins above the bound)."""
    frame = frame.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
    lengths = frame["length"].to_numpy()
    frame["bin"] = bins = best_fit_decreasing(lengths, capacity)
    used = np.bincount(bins, weights=lengths).astype(np.int64)
    order = np.argsort(bins, kind="stable")
    before = np.cumsum(lengths[order]) - lengths[order]
    offset = np.empty(len(frame), np.int64)
    offset[order] = before - np.concatenate([[0], np.cumsum(used)])[bins[order]]
    frame["offset"] = offset
    frame["room"] = capacity - used[bins]
    frame["gap"] = len(used) - lower_bound(lengths, capacity)
    return frame


def _pack(pieces: DataFrame, buckets: int, turn: int, capacity: int) -> DataFrame:
    """Deals pieces to buckets by a hash that changes from turn to turn, and packs each bucket."""

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        packed = pack_bucket(frame, capacity)
        packed["sequence_id"] = turn * 2**58 + packed["bucket"].astype(np.int64) * 2**24 + packed["bin"]
        return packed[[*NAMES, "salt", "sequence_id", "offset", "room", "gap"]]

    dealt = pieces.select(*NAMES, "salt", F.pmod(F.xxhash64("salt", F.lit(turn)), F.lit(buckets)).cast("int").alias("bucket"))
    return dealt.groupBy("bucket").applyInPandas(one, f"{PIECE}, salt long, {PLACE}, room long, gap long")


def _bins(frame: DataFrame) -> int:
    """Every bin holds exactly one piece at offset 0."""
    return frame.where(F.col("offset") == 0).count()


def pack_documents(spark: SparkSession, documents: DataFrame, path: str, pattern: str, end_id: int = 2, capacity: int = 1024, bucket_rows: int = 4096, turns: int = 3) -> DataFrame:
    """Pieces of all documents with their sequence and their offset in it.

    A null text is an empty one: a piece of the end id alone. Texts of any length are encoded whole and cut to pieces; of
    pieces of equal length any may come first, which changes no number of sequences. Repeated rows and null doc_ids are
    packed like any other. An empty table gives no rows; columns other than doc_id and text are left out, whatever their
    names. bucket_rows is what one task packs on average; turns is how often buckets above their bound exchange
    documents at most.
    """
    scratch = Scratch(spark)
    # the row's own number spreads repeated rows over the buckets; it is fixed once the pieces are written
    pieces = piece_rows(documents, path, pattern, end_id, capacity).withColumn("salt", F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()))
    pieces = scratch.keep(pieces, "pieces")
    final: list[DataFrame] = []
    packed = scratch.keep(_pack(pieces, max(1, math.ceil(pieces.count() / bucket_rows)), 0, capacity), "packed0")
    for turn in range(1, turns + 1):
        loose = (F.col("gap") > 0) & (F.col("room") > 0)
        old = packed.where(loose)
        n = old.count()
        if not n:
            break
        new = scratch.keep(_pack(old, max(1, math.ceil(n / bucket_rows)), turn, capacity), f"packed{turn}")
        if _bins(new) >= _bins(old):
            break
        final.append(packed.where(~loose))
        packed = new
    final.append(packed)
    result = final[0]
    for other in final[1:]:
        result = result.unionByName(other)
    return result.select(*NAMES, "sequence_id", "offset")
