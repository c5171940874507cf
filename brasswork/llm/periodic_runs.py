"""Periodic runs of words (operator 11).

A run is a maximal stretch of words that repeats itself at least four times. The suffix array of the words and its LCP
values give the longest previous factor of each place, and that the Lempel-Ziv blocks. A run either lies strictly
inside a block, and then it is a copy of an earlier run, or it touches a border of blocks. Those at borders are found by
extending, to both sides, places whose distance is a possible period; the others are copied, block by block, from runs
that are bucketed by their start.

Why borders are enough, and which periods they need: let a run of period q end in block C and begin before it, at b, and
let P be the block before C. If b + q were not behind the start of P, all from there to the run's end would occur q words
before, and P would be longer. So the run is shorter than |P| + |C| + q, and as it is 4 q long at least, 3 q < |P| + |C|.
At least half of such a run, 2 q words, lies on one side of the border.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from brasswork.llm.common import slices

LEAST, POWER = 6, 4  # a run has so many words at least, and so many periods
WORDS_AT_ONCE = 40_000  # documents are sorted together up to about so many words; a longer one alone
LOOK = 24  # words compared for all places at once, before single places are looked at

Run = tuple[int, int, int]  # start, end (exclusive), period


def suffix_array(codes: np.ndarray) -> np.ndarray:
    """Starts of all suffixes in order. Suffixes that are still equal are sorted by what follows, twice as far each turn."""
    n = len(codes)
    bits = int(codes.max() + 1).bit_length() if n else 1
    depth = max(1, min(4, 62 // bits))
    padded = np.concatenate([codes + 1, np.zeros(depth, np.int64)])
    key = np.zeros(n, np.int64)
    for k in range(depth):
        key = key << bits | padded[k : k + n]
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    first = np.ones(n, bool)
    first[1:] = sorted_key[1:] != sorted_key[:-1]
    group = np.maximum.accumulate(np.where(first, np.arange(n), 0))  # names a group by the place of its first suffix
    rank = np.empty(n + 1, np.int64)
    rank[order], rank[n] = group, -1
    places = np.flatnonzero(~first)
    places = np.union1d(places, places - 1)
    while len(places):
        suffixes = order[places]
        own = rank[suffixes]
        then = rank[np.minimum(suffixes + depth, n)] + 1
        by = np.argsort(own * (n + 1) + then, kind="stable")
        suffixes, own, then = suffixes[by], own[by], then[by]
        order[places] = suffixes
        new = np.ones(len(places), bool)
        new[1:] = (own[1:] != own[:-1]) | (then[1:] != then[:-1])
        rank[suffixes] = np.maximum.accumulate(np.where(new, places, 0))
        again = ~new
        again[:-1] |= ~new[1:]
        places = places[again]
        depth *= 2
    return order


def common_prefixes(codes: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each suffix in order: how many codes it shares with the one before it; 0 for the first."""
    n = len(codes)
    padded = np.concatenate([codes, np.full(LOOK + 1, -1, np.int64)])
    lcp = np.zeros(n, np.int64)
    open_ = np.arange(1, n)
    for k in range(LOOK):
        open_ = open_[padded[order[open_] + k] == padded[order[open_ - 1] + k]]
        if not len(open_):
            return lcp
        lcp[open_] = k + 1
    # long ones in the order of the text: that of a place is at least that of the place before it, less one
    words = codes.tolist()
    at, length = -2, 0
    for place, before, slot in sorted(zip(order[open_].tolist(), order[open_ - 1].tolist(), open_.tolist(), strict=True)):
        length = max(LOOK, length - 1) if place == at + 1 else LOOK
        most = n - max(place, before)
        while length < most and words[place + length] == words[before + length]:
            length += 1
        lcp[slot], at = length, place
    return lcp


def previous_factors(order: np.ndarray, lcp: np.ndarray) -> tuple[list[int], list[int]]:
    """For each place: the length of the longest factor that starts there and also starts earlier, and where it does."""
    length, source = [0] * len(order), [0] * len(order)
    starts, shared = [], []  # places that rise, each with what it shares with the one below it
    for place, common in zip([*order.tolist(), -1], [*lcp.tolist(), 0], strict=True):
        while starts and place < starts[-1]:
            top, low = starts.pop(), shared.pop()
            if low > common:
                length[top], source[top] = low, starts[-1]
            else:
                if common:
                    length[top], source[top] = common, place
                common, low = low, common
        starts.append(place)
        shared.append(common)
    return length, source


def _extent(codes: np.ndarray, i: int, j: int) -> tuple[int, int]:
    """How far codes agree before i and j (i < j), and from i and j on."""
    after, step = 0, 32
    while j + after < len(codes):
        m = min(step, len(codes) - j - after)
        differ = codes[i + after : i + after + m] != codes[j + after : j + after + m]
        if differ.any():
            after += int(differ.argmax())
            break
        after, step = after + m, step * 2
    before, step = 0, 32
    while i - before > 0:
        m = min(step, i - before)
        differ = (codes[i - before - m : i - before] != codes[j - before - m : j - before])[::-1]
        if differ.any():
            before += int(differ.argmax())
            break
        before, step = before + m, step * 2
    return before, after


def _border_runs(codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> dict[tuple[int, int], int]:
    """Runs that hold or touch a border of blocks, with their least periods."""
    borders = np.append(starts[1:], len(codes))
    most = (sizes + np.append(sizes[1:], 0)) // (POWER - 1)
    borders, most = borders[most > 0], most[most > 0]
    if not len(borders):
        return {}
    at = np.repeat(borders, most)
    period = np.arange(1, len(at) + 1) - np.repeat(np.cumsum(most) - most, most)
    padded = np.concatenate([codes, np.full(int(most.max()) + LOOK + 1, -1, np.int64)])  # places before the first lead here too
    right = np.flatnonzero(at + period < len(codes))
    left = np.arange(len(at))
    for k in range(LOOK):
        right = right[(padded[at[right] + k] == padded[at[right] + period[right] + k]) | (k >= period[right])]
        left = left[(padded[at[left] - 1 - k] == padded[at[left] - 1 - period[left] - k]) | (k >= period[left])]
        if not len(right) and not len(left):
            return {}
    found: dict[tuple[int, int], int] = {}
    here, known = -1, []
    for c in np.union1d(right, left).tolist():
        s, q = int(at[c]), int(period[c])
        if s != here:
            here, known = s, []
        # a multiple of a known period within its run gives the same stretch
        for i, j in ((s, s + q), (s - q, s)):
            if i < 0 or j > len(codes) or any(q % p == 0 and b <= i and j <= e for b, e, p in known):
                continue
            before, after = _extent(codes, i, j)
            b, e = i - before, j + after
            if e - b >= 2 * q and b <= s <= e:
                known.append((b, e, q))
                if e - b >= max(LEAST, POWER * q):
                    found[b, e] = min(q, found.get((b, e), q))
    return found


def runs(codes: np.ndarray) -> list[Run]:
    """All runs of a sequence of codes from 0 on, by start and period."""
    if len(codes) < LEAST:
        return []
    order = suffix_array(codes)
    length, source = previous_factors(order, common_prefixes(codes, order))
    blocks, at = [], 0
    while at < len(codes):
        blocks.append(at)
        at += length[at] or 1
    starts = np.array(blocks)
    sizes = np.diff(starts, append=len(codes))
    found = _border_runs(codes, starts, sizes)
    if not found:
        return []
    buckets: dict[int, set[tuple[int, int]]] = {}
    for (b, e), q in found.items():
        buckets.setdefault(b, set()).add((e, q))
    filled = sorted(buckets)
    for k in np.flatnonzero(sizes >= LEAST + 2).tolist():
        s, size = blocks[k], int(sizes[k])
        p = source[s]
        place = bisect_right(filled, p)
        while place < len(filled) and filled[place] < p + size:
            b = filled[place]
            inside = [(e + s - p, q) for e, q in buckets[b] if e < p + size]
            if inside:
                if b + s - p not in buckets:
                    insort(filled, b + s - p)  # behind b, so a block that overlaps its source reads its own copies
                buckets.setdefault(b + s - p, set()).update(inside)
            place += 1
    return [(b, e, q) for b in filled for e, q in sorted(buckets[b], key=lambda x: x[1])]


def word_codes(words: list[bytes]) -> np.ndarray:
    code = dict.fromkeys(words)
    for k, word in enumerate(code):
        code[word] = k
    return np.fromiter(map(code.__getitem__, words), np.int64, len(words))


def periodic_tail(n: int, doc_id: int | None) -> np.ndarray | None:
    """The contract's change of a tenth of the documents: which of n words stands at each place; None where none moves."""
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is None or h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.concatenate([np.arange(a), a + np.arange(n - a) % p])


def collapsed(words: list[bytes], found: list[Run]) -> list[bytes]:
    """words without those that some run contains behind its first period."""
    if not found:
        return words
    keep = np.ones(len(words), bool)
    for b, e, q in found:
        keep[b + q : e] = False
    return [words[i] for i in np.flatnonzero(keep)]


def runs_of_all(texts: list[list[bytes]]) -> list[list[Run]]:
    """Runs of several texts, each a list of words, by one suffix array: words of different texts have different codes."""
    codes, base, ends = [], 0, []
    for words in texts:
        own = word_codes(words) + base
        codes.append(own)
        base = int(own.max()) + 1 if len(own) else base
        ends.append(len(own))
    offsets = np.cumsum([0, *ends])
    out: list[list[Run]] = [[] for _ in texts]
    for b, e, q in runs(np.concatenate(codes) if codes else np.empty(0, np.int64)):
        k = int(np.searchsorted(offsets, b, "right")) - 1
        low = int(offsets[k])
        out[k].append((b - low, e - low, q))
    return out


SCHEMA = (
    "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, "
    "collapsed_sha256 string, n_words long, n_kept long"
)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int | None], list[list[bytes]]]]:
    """doc_ids and words of documents, so many together that one sort of their suffixes pays."""
    ids: list[int | None] = []
    texts: list[list[bytes]] = []
    size = 0
    for batch in slices(batches, 64):
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            words = (text.as_buffer().to_pybytes() if text.is_valid else b"").split()  # at space and 09 to 0D
            ids.append(doc_id)
            texts.append(words)
            size += len(words)
            if size >= WORDS_AT_ONCE:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def digest_documents(documents: DataFrame) -> DataFrame:
    """A row for each row of documents: its runs and the text without their repetitions, as digests; see SCHEMA.

    A tenth of the documents, chosen by their doc_id, get a periodic tail first, as the contract asks. A null text is
    an empty one, without words or runs; a null doc_id chooses no tail. Of runs of equal length the first is told, then
    that of the least period. Repeated rows have equal results, an empty table none. A text of any length is read whole,
    in memory in proportion to its words. Columns beside doc_id and text are left out, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _groups(batches):
            moved = [periodic_tail(len(words), doc_id) for doc_id, words in zip(ids, texts, strict=True)]
            texts = [words if m is None else [words[i] for i in m.tolist()] for words, m in zip(texts, moved, strict=True)]
            rows = []
            for doc_id, words, found in zip(ids, texts, runs_of_all(texts), strict=True):
                lines = "".join(f"{b},{e - b},{q}\n" for b, e, q in found)
                kept = collapsed(words, found)
                best = min(found, key=lambda r: (r[0] - r[1], r[0], r[2]), default=None)
                told = (None,) * 4 if best is None else (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2])
                rows.append((doc_id, len(found), *told, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest(), len(words), len(kept)))
            types = [pa.int64()] * 6 + [pa.string()] * 2 + [pa.int64()] * 2
            names = [field.split()[0] for field in SCHEMA.split(", ")]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def collapse_documents(documents: DataFrame, text: str = "text", into: str = "collapsed") -> DataFrame:
    """documents with a column more: the words without the repetitions of runs, joined by single spaces.

    Here no tail is made periodic. A null text stays null. Other columns go through unchanged, whatever their names,
    but for one of the name given by `into`, which raises ValueError.
    """
    if into.lower() in [c.lower() for c in documents.columns]:
        raise ValueError(f"there is a column {into} already")
    schema = StructType([*documents.schema.fields, StructField(into, StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            texts = [None if t is None else t.encode().split() for t in batch.column(text).to_pylist()]
            found = runs_of_all([t or [] for t in texts])
            out = [None if t is None else b" ".join(collapsed(t, r)).decode() for t, r in zip(texts, found, strict=True)]
            yield pa.record_batch([*batch.columns, pa.array(out, pa.string())], names=schema.names)

    return documents.mapInArrow(run, schema)
