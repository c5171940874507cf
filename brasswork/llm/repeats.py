"""Exact removal of repeated passages by suffix sorting (operator 8).

A byte goes if it lies in a string of `length` bytes that also starts anywhere else. Sorting all suffixes of a corpus
would move each many times, so suffixes are first told apart by what a repeated string must share:

1. Each start of a string has an anchor: the run of length/2 bytes of least hash that lies in the string. Equal strings
   have equal anchors at equal offsets. Neighbouring starts with one anchor form a span.
2. A span whose anchor occurs once holds no repeated string. Spans that are equal as wholes are repeated as wholes.
3. What remains (spans that share an anchor but differ, one for each class of equal ones) is cut into bins of starts
   whose strings have a common core. Bins whose core occurs once are dropped, equal bins are repeated as wholes.
4. The suffixes of bins with equal cores are sorted to `length` bytes by multikey quicksort and blind tries; suffixes
   of one class are repeated. A core with very many bins is sorted in parts, and strings that are single in their part
   are compared with those of the other parts by 128-bit hashes.

Copies of whole spans and bins, which most repeated bytes come from, are told by 128-bit hashes of their bytes and
collapsed before the sort; the sort decides everything in which spans of one anchor differ.

Two lengths are told in turn: each repeated string lies, here and where else it starts, in bytes that shorter repeated
strings cover. So the shorter length is told on whole texts, the longer one within what the shorter one has covered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from brasswork.llm.common import Scratch, doc_texts, row_key, slices
from brasswork.llm.suffix_sort import sorted_classes

PASSAGE = 240  # bytes of a repeated passage of about 50 words and the spaces between them
BIN = 25  # starts of a bin
PART_BINS = 1024  # bins of one core sorted at once
TASK_BINS = 8192  # bins sorted by a task
HASH_ROWS = 500_000  # strings compared across parts by a task
_SLICE = 1 << 19  # bytes hashed at a time, and bytes of bins handed on at a time
_MIX = np.uint64(0xD6E8FEB86659FD93)
_BASE = 0x9E3779B97F4A7C15
_LOW = np.uint64((1 << 22) - 1)
_TABLE = np.random.default_rng(424242).integers(0, 2**64, 256, dtype=np.uint64)


class _Powers:
    """Powers of the hash base and of its inverse modulo 2**64."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
            up[0] = down[0] = 1
            self.up, self.down = np.cumprod(up), np.cumprod(down)
        return self.up, self.down


_POWERS = _Powers()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * _MIX
    return x ^ (x >> np.uint64(32))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least value of each run of `width` neighbours."""
    n = len(x)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def spans_of(parts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """Spans of several texts at once: which text, first and last start, anchor, hash of the anchor's bytes, 128-bit hash of the span in two columns."""
    gram = length // 2
    sizes = np.array([len(p) for p in parts], np.int64)
    ends = np.cumsum(sizes)
    joined = b"".join(parts)
    data = np.frombuffer(joined, np.uint8)
    empty = np.empty(0, np.int64)
    if len(data) < length or not (sizes >= length).any():
        return (empty,) * 4 + (empty.astype(np.uint64), np.empty((0, 2), np.int64))
    up, down = _POWERS.of(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * down[: len(data)], out=sums[1:])
    grams = _mixed((sums[gram:] - sums[:-gram]) * up[: len(data) - gram + 1])
    # the place in the low bits makes the leftmost of equal grams the least
    anchors = (_sliding_min((grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64), length - gram + 1) & _LOW).astype(np.int64)
    usable = np.zeros(len(anchors) + 1, bool)
    for start, size in zip((ends - sizes).tolist(), sizes.tolist(), strict=True):
        if size >= length:
            usable[start : start + size - length + 1] = True
    new = usable[:-1].copy()
    new[1:] &= ~usable[:-2] | (anchors[1:] != anchors[:-1])
    first = np.flatnonzero(new)
    last = np.flatnonzero(usable[:-1] & (~usable[1:] | np.append(new[1:], True)))
    anchor = anchors[first]
    shape = ((anchor - first) << 32) + (last - first)
    view, digest = memoryview(joined), xxhash.xxh3_128_digest
    found = b"".join([digest(view[a:b], k) for a, b, k in zip(first.tolist(), (last + length).tolist(), shape.tolist(), strict=True)])
    span = np.frombuffer(found, np.int64).reshape(-1, 2)
    text = np.searchsorted(ends, first, "right")
    before = (ends - sizes)[text]
    return text, first - before, last - before, anchor - before, grams[anchor], span


def _pieces(texts: list[bytes], within: list[list[tuple[int, int]]], length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Lists of (text, offset, bytes) of about a slice, of the texts' intervals that hold a string.

    A long interval is cut so that each start of a string is in one piece.
    """
    held, size = [], 0
    for i, a, b in ((i, a, b) for i, intervals in enumerate(within) for a, b in intervals if b - a >= length):
        for at in range(a, b - length + 1, _SLICE):
            piece = texts[i][at : min(b, at + _SLICE + length - 1)]
            held.append((i, at, piece))
            size += len(piece)
            if size >= _SLICE:
                yield held
                held, size = [], 0
    if held:
        yield held


def _spans(keyed: DataFrame, length: int) -> DataFrame:
    """Spans of whole texts, or of their intervals where such are given."""
    given = "intervals" in keyed.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keys = batch.column("key").to_numpy()
            texts = [t.encode() for t in batch.column("text").to_pylist()]
            within = [merged(x.values) for x in batch.column("intervals")] if given else [[(0, len(t))] for t in texts]
            for held in _pieces(texts, within, length):
                text, first, last, anchor, gram, span = spans_of([p for _, _, p in held], length)
                at = np.array([a for _, a, _ in held], np.int64)[text]
                key = keys[np.array([i for i, _, _ in held], np.int64)[text]]
                yield pa.record_batch(
                    [pa.array(key, pa.int64()), *(pa.array(x + at, pa.int64()) for x in (first, last, anchor)), pa.array(gram.view(np.int64)), *(pa.array(span[:, i]) for i in (0, 1))],
                    names=["key", "first", "last", "anchor", "gram", "span", "span2"],
                )

    return keyed.mapInArrow(run, "key long, first long, last long, anchor long, gram long, span long, span2 long")


def _bins(joined: DataFrame, length: int) -> DataFrame:
    """Bins of the spans listed beside each text, with the bytes of their strings."""

    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())

    def packed(out: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], names=["key", "low", "high", "core", "whole", "content"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for batch in slices(batches, 8):
            for key, text, spans in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), batch.column("spans"), strict=True):
                data = text.encode()
                for first, last, anchor in zip(*(spans.values.field(c).to_numpy().tolist() for c in ("first", "last", "anchor")), strict=True):
                    for b in range((anchor - last) // BIN, (anchor - first) // BIN + 1):
                        low, high = max(first, anchor - BIN * b - BIN + 1), min(last, anchor - BIN * b)
                        core = data[anchor - BIN * b : anchor - BIN * b - BIN + 1 + length]
                        content = data[low : high + length]
                        whole = xxhash.xxh3_128_digest(content + bytes((anchor - BIN * b - high,)))
                        out.append((key, low, high, xxhash.xxh3_64_intdigest(core, seed=b) - 2**63, whole, content))
                        size += len(content) + 200
                    if size >= _SLICE:
                        yield packed(out)
                        out, size = [], 0
        if out:
            yield packed(out)

    return joined.mapInArrow(run, "key long, low long, high long, core long, whole binary, content binary")


def _runs(starts: Iterable[int], length: int) -> Iterator[tuple[int, int]]:
    """Bytes covered by strings that start at these places, as intervals."""
    first = last = None
    for p in sorted(starts):
        if first is None or p > last + 1:
            if first is not None:
                yield first, last + length
            first = p
        last = p
    if first is not None:
        yield first, last + length


def sort_bins(rows: list[dict], length: int, open_: bool) -> tuple[list[tuple[int, int, int]], list[tuple[bytes, int, int]]]:
    """Intervals (key, start, end) of strings that occur in several of these bins; if open_, (hash, key, start) of the others."""
    contents = [r["content"] for r in rows]
    suffixes = [(i, p) for i, r in enumerate(rows) for p in range(r["high"] - r["low"] + 1)]
    repeated: dict[int, list[int]] = {}
    single = []
    for members in sorted_classes(contents, suffixes, length):
        if len(members) > 1:
            for i, p in members:
                repeated.setdefault(i, []).append(rows[i]["low"] + p)
        if open_:  # one of each class speaks for it in other parts
            for i, p in members:
                single.append((xxhash.xxh3_128_digest(contents[i][p : p + length]), rows[i]["key"], rows[i]["low"] + p, len(members) > 1))
    found = [(rows[i]["key"], a, b) for i, starts in repeated.items() for a, b in _runs(starts, length)]
    seen, left = set(), []
    for digest, key, p, many in single:
        if not many or digest not in seen:
            left.append((digest, key, p))
        seen.add(digest)
    return found, left


def _sorted_groups(frame: DataFrame, length: int, tasks: int, hash_parts: int) -> DataFrame:
    """Rows of one core and part stand together in a partition; gives intervals, and packed strings that other parts must see."""
    schema = pa.schema([("key", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("hash_part", pa.int32()), ("hashes", pa.binary()), ("keys", pa.binary()), ("places", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, name, out = [], None, []

        def close() -> None:
            if len(group) < 2 and not (group and group[0]["parts"] > 1):
                return
            found, left = sort_bins(group, length, group[0]["parts"] > 1)
            out.extend({"key": k, "start": a, "end": b} for k, a, b in found)
            dealt: dict[int, list] = {}
            for x in left:
                dealt.setdefault(int.from_bytes(x[0][:4], "little") % hash_parts, []).append(x)
            for part, rows in dealt.items():
                out.append({"hash_part": part, "hashes": b"".join(r[0] for r in rows), "keys": np.array([r[1] for r in rows], np.int64).tobytes(), "places": np.array([r[2] for r in rows], np.int64).tobytes()})

        for batch in slices(batches):
            for row in batch.to_pylist():
                if (row["core"], row["part"]) != name:
                    close()
                    group, name = [], (row["core"], row["part"])
                group.append(row)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
                out.clear()
        close()
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    dealt = frame.repartition(tasks, "core", "part").sortWithinPartitions("core", "part")
    return dealt.mapInArrow(run, "key long, start long, end long, hash_part int, hashes binary, keys binary, places binary")


def _across_parts(packed: DataFrame, length: int) -> DataFrame:
    """Strings that were single in their part of a core but occur in another part too."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        hashes = np.frombuffer(b"".join(frame["hashes"]), "<u8").reshape(-1, 2)
        keys, places = (np.frombuffer(b"".join(frame[c]), np.int64) for c in ("keys", "places"))
        order = np.lexsort((hashes[:, 0], hashes[:, 1]))
        same = (hashes[order][1:] == hashes[order][:-1]).all(1)
        repeated = order[np.append(same, False) | np.append(False, same)]
        keys, places = keys[repeated], places[repeated]
        order = np.lexsort((places, keys))
        keys, places = keys[order], places[order]
        new = np.append(True, (keys[1:] != keys[:-1]) | (places[1:] > places[:-1] + length))[: len(keys)]  # touching strings are one interval
        last = np.append(new[1:], True)[: len(keys)]
        return pd.DataFrame({"key": keys[new], "start": places[new], "end": places[last] + length})

    return packed.groupBy("hash_part").applyInPandas(run, "key long, start long, end long")


def repeated_intervals(spark: SparkSession, documents: DataFrame, length: int = 400, within: DataFrame | None = None) -> DataFrame:
    """key (of doc_id and text), intervals array<struct<start, end>>: bytes that repeated strings cover, not yet merged.

    `within` is what this function gave for the same documents and a smaller length; nothing outside it is searched then.
    Joins of spans and bins with a table of what is repeated among them may have hot keys. That table is written first,
    so that both sides are plain shuffles and adaptive execution splits a hot key's rows.
    """
    if length < 2 * BIN or length % 2:
        raise ValueError("length must be even and at least 50")
    scratch = Scratch(spark)
    texts = doc_texts(documents).select(row_key().alias("key"), "text")
    if within is not None:
        room = F.array_max("intervals.end") - F.array_min("intervals.start") >= length
        texts = scratch.keep(texts.join(within.where(room).withColumnRenamed("key", "of"), F.col("key") == F.col("of")).drop("of"), "within")
    spans = scratch.keep(_spans(texts, length), "spans")
    differ = (F.min("span") != F.max("span")) | (F.min("span2") != F.max("span2"))
    grams = spans.groupBy("gram").agg(F.count("*").alias("n"), differ.alias("mixed")).where("n > 1")
    grams = scratch.keep(grams.select(F.col("gram").alias("of"), "mixed"), "grams")
    shared = scratch.keep(spans.join(grams, F.col("gram") == F.col("of")).drop("of"), "shared")
    scratch.drop("spans", "grams")
    mixed = shared.where("mixed")
    classes = scratch.keep(mixed.groupBy("gram", "span", "span2").agg(F.count("*").alias("n"), F.min(F.struct("key", "first", "last", "anchor")).alias("one")), "classes")
    many = classes.where("n > 1").select(F.col("gram").alias("g"), F.col("span").alias("s"), F.col("span2").alias("s2"))
    whole = shared.where("not mixed").select("key", "first", "last")
    whole = whole.union(mixed.join(many, (F.col("gram") == F.col("g")) & (F.col("span") == F.col("s")) & (F.col("span2") == F.col("s2"))).select("key", "first", "last"))
    whole = whole.select("key", F.col("first").alias("start"), (F.col("last") + length).alias("end"))

    listed = classes.groupBy(F.col("one.key").alias("span_key")).agg(F.collect_list(F.struct("one.first", "one.last", "one.anchor")).alias("spans"))
    # of repeated rows, whose spans are told above, one is cut to bins
    once = texts.groupBy("key").agg(F.first("text").alias("text"))
    bins = scratch.keep(_bins(once.join(listed, F.col("key") == F.col("span_key")).select("key", "text", "spans"), length), "bins")
    wholes = scratch.keep(bins.groupBy("core", "whole").agg(F.count("*").alias("n"), F.min(F.struct("key", "low")).alias("one")), "wholes")
    equal = wholes.where("n > 1").select(F.col("core").alias("c"), F.col("whole").alias("w"))
    binned = bins.join(equal, (F.col("core") == F.col("c")) & (F.col("whole") == F.col("w"))).select("key", F.col("low").alias("start"), (F.col("high") + length).alias("end"))
    cores = scratch.keep(wholes.groupBy("core").agg(F.count("*").alias("m")).where("m > 1").select(F.col("core").alias("c"), "m"), "cores")
    sizes = cores.agg(F.sum("m").alias("bins"), F.sum(F.when(F.col("m") > PART_BINS, F.col("m"))).alias("open")).first()
    tasks, hash_parts = -(-(sizes["bins"] or 1) // TASK_BINS), -(-(sizes["open"] or 1) * BIN // HASH_ROWS)
    chosen = wholes.join(cores, F.col("core") == F.col("c")).select(F.col("core").alias("c"), F.col("whole").alias("w"), F.col("one.key").alias("k"), F.col("one.low").alias("l"), F.ceil(F.col("m") / PART_BINS).alias("parts"))
    here = (F.col("core") == F.col("c")) & (F.col("whole") == F.col("w")) & (F.col("key") == F.col("k")) & (F.col("low") == F.col("l"))
    groups = bins.join(chosen, here).select("core", F.pmod(F.xxhash64("whole"), "parts").alias("part"), "parts", "key", "low", "high", "content")
    sorted_ = scratch.keep(_sorted_groups(groups, length, tasks, hash_parts), "sorted")
    across = _across_parts(sorted_.where("hash_part is not null"), length)
    found = whole.union(binned).union(sorted_.where("hash_part is null").select("key", "start", "end")).union(across)
    # a set, so that rows that are repeated as wholes don't lengthen it
    found = scratch.keep(found.groupBy("key").agg(F.collect_set(F.struct("start", "end")).alias("intervals")), "intervals")
    scratch.drop("within", "shared", "classes", "bins", "wholes", "cores", "sorted")
    return found


def merged(intervals: list[dict] | pa.StructArray | None) -> list[tuple[int, int]]:
    """Intervals in order, those that touch or overlap as one."""
    if intervals is None or not len(intervals):
        return []
    if isinstance(intervals, pa.Array):
        starts, ends = (intervals.field(c).to_numpy() for c in ("start", "end"))
    else:
        starts, ends = (np.array([i[c] for i in intervals], np.int64) for c in ("start", "end"))
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.append(True, starts[1:] > ends[:-1])
    return list(zip(starts[new].tolist(), ends[np.append(np.flatnonzero(new)[1:] - 1, len(ends) - 1)].tolist(), strict=True))


def kept_bytes(data: bytes, removed: list[tuple[int, int]]) -> bytes:
    at, out = 0, []
    for start, end in removed:
        out.append(data[at:start])
        at = end
    return b"".join([*out, data[at:]])


def _with_intervals(documents: DataFrame, found: DataFrame) -> DataFrame:
    """The columns of documents, named c0, c1, ..., beside those of `found` but its key."""
    found = found.withColumnRenamed("key", "found_key")
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.xxhash64(F.col("doc_id").cast("long"), text, F.length(text)).alias("key")
    plain = documents.select(key, *[F.col(f"`{n}`").alias(f"c{i}") for i, n in enumerate(documents.columns)])
    return plain.join(found, F.col("key") == F.col("found_key"), "left").drop("key", "found_key")


def digest_documents(spark: SparkSession, documents: DataFrame, length: int = 400, passage: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, text (what is kept) for each row.

    If `passage`, a smaller length, is given, passage_removed, passage_spans and passage_text follow: the same by that length.

    Null texts count as empty, repeated rows as repeats of each other. Texts of any length are read whole; characters
    that a removal cuts are missing from `text` and `passage_text` but not from the checksum. An empty table gives no rows;
    columns other than doc_id and text are left out.
    """
    if passage is not None and passage >= length:
        raise ValueError("passage must be less than length")
    kinds = {"doc_id": "long", "n_bytes": "long", "n_removed": "long", "n_spans": "long", "kept_sha256": "string", "text": "string"}
    if passage is not None:
        kinds |= {"passage_removed": "long", "passage_spans": "long", "passage_text": "string"}
    types = [pa.int64() if k == "long" else pa.string() for k in kinds.values()]

    def cut(data: bytes, intervals: pa.ListScalar) -> tuple[int, int, bytes]:
        removed = merged(intervals.values)
        return sum(b - a for a, b in removed), len(removed), kept_bytes(data, removed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            rows = []
            for i, (doc_id, text) in enumerate(zip(batch.column("c0").to_pylist(), batch.column("c1").to_pylist(), strict=True)):
                data = (text or "").encode()
                n, spans, kept = cut(data, batch.column("intervals")[i])
                row = (doc_id, len(data), n, spans, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore"))
                if passage is not None:
                    n, spans, kept = cut(data, batch.column("passages")[i])
                    row += (n, spans, kept.decode("utf-8", "ignore"))
                rows.append(row)
            yield pa.record_batch([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(types)], names=list(kinds))

    narrow = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if passage is None:
        found = repeated_intervals(spark, narrow, length)
    else:
        shorter = repeated_intervals(spark, narrow, passage)
        found = repeated_intervals(spark, narrow, length, shorter)
        found = shorter.withColumnRenamed("intervals", "passages").join(found, "key", "left")
    return _with_intervals(narrow, found).mapInArrow(run, ", ".join(f"{name} {kind}" for name, kind in kinds.items()))


def remove_repeats(spark: SparkSession, documents: DataFrame, length: int = 400) -> DataFrame:
    """documents without their repeated passages; characters that a removal cuts go as wholes, and n_chars, if there, is counted anew.

    Null texts stay null. Other columns, whatever their names, go through unchanged; every row stays, repeated rows too.
    """
    names = documents.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            texts = []
            for text, intervals in zip(batch.column(f"c{at}").to_pylist(), batch.column("intervals"), strict=True):
                removed = merged(intervals.values)
                texts.append(kept_bytes(text.encode(), removed).decode("utf-8", "ignore") if removed else text)
            columns = [batch.column(f"c{i}") for i in range(len(names))]
            columns[at] = pa.array(texts, pa.string())
            yield pa.record_batch(columns, names=[f"c{i}" for i in range(len(names))])

    kinds = StructType([StructField(f"c{i}", f.dataType) for i, f in enumerate(documents.schema)])
    found = _with_intervals(documents, repeated_intervals(spark, documents, length)).mapInArrow(run, kinds)
    new_length = lambda i, f: F.length(f"c{at}").cast(f.dataType) if f.name == "n_chars" else F.col(f"c{i}")
    return found.select(*[new_length(i, f).alias(f.name) for i, f in enumerate(documents.schema)])
