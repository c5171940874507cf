"""N-gram Jaccard join with Bayesian pruning (operator 5).

A document is the set of its runs of five lower-case words. Documents of equal sets are copies: they are linked by
definition and one stands for them. Representatives whose MinHash bands agree anywhere are candidates; they are
gathered in components. A component of bounded size is compared as a whole. A larger one is cut into blocks of bounded
size, near copies beside each other, and two blocks meet only if they hold candidates: if some band agrees between
them and their sizes allow a link. MinHash values are compared a few at a time: a pair is dropped when the posterior
probability that it reaches the threshold falls below a tolerance. What is left is verified on the whole sets. Links are
counted where they are found and only a spanning forest of them is handed on, so a group of near copies never becomes a
list of pairs.

Two representatives at the threshold fail to meet in a band with a probability under 1e-5 (64 bands of 8 values);
a linked pair is pruned with a probability under the tolerance, 1e-6. Nothing else can lose a link.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brasswork.llm.common import Scratch, doc_texts, row_key, slices
from brasswork.llm.components import connected_components

WORDS = 5
BANDS, ROWS = 64, 8
STEP, STEPS = 32, 4  # MinHash values compared at a time, and how often
BLOCK = 1024  # representatives of a block, about
BLOCK_CODES = 2_000_000  # codes of the sets of a block, about
_WORD = re.compile(r"\w+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _WordCodes(dict):
    """64-bit hashes of words, for the first limit words kept."""

    def __init__(self, limit: int = 150_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: str) -> int:
        data = word.encode()
        value = zlib.crc32(data) << 32 | zlib.crc32(data[::-1] + b"#")
        if len(self) < self.limit and len(word) <= 32:
            self[word] = value
        return value


_CODES = _WordCodes()
_SEEDS = np.random.default_rng(20240229).integers(1, 2**32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32) | np.uint32(1)


def shingles(text: str) -> np.ndarray:
    """Sorted distinct 64-bit codes of the runs of five words; a text of fewer words is one run, one without words none."""
    words = _WORD.findall(text.lower())
    if not words:
        return np.empty(0, np.uint64)
    codes = np.fromiter(map(_CODES.__getitem__, words), np.uint64, len(words)) * _MIX
    n = max(1, len(words) - WORDS + 1)
    runs = np.full(n, min(len(words), WORDS), np.uint64)
    for k in range(min(WORDS, len(words))):
        part = codes[k : k + n]
        runs = (runs ^ (part ^ (part >> np.uint64(31)))) * _MIX + np.uint64(k)
        runs ^= runs >> np.uint64(29)
    return np.unique(runs)


def min_hashes(runs: np.ndarray, first: int = 0, count: int = BANDS * ROWS) -> np.ndarray:
    """MinHash values, a part of those of all seeds, of a set that isn't empty."""
    folded = (runs ^ (runs >> np.uint64(32))).astype(np.uint32)
    out = np.full(count, 0xFFFFFFFF, np.uint32)
    seeds = _SEEDS[first : first + count]
    for start in range(0, len(folded), 256):
        mixed = folded[start : start + 256, None] * seeds[None]
        mixed ^= mixed >> np.uint32(15)
        mixed *= np.uint32(0x2C1B3C6D)
        out = np.minimum(out, mixed.min(0))
    return out


def band_codes(values: np.ndarray) -> np.ndarray:
    bands = values.reshape(BANDS, ROWS).astype(np.uint64)
    code = np.arange(BANDS, dtype=np.uint64) * _MIX
    for k in range(ROWS):
        code = (code ^ bands[:, k]) * _MIX
        code ^= code >> np.uint64(32)
    return code.view(np.int64)


def least_matches(threshold: float, tolerance: float, steps: int) -> list[int]:
    """For STEP, 2 STEP, ... compared values: the fewest matches with which a pair is kept.

    With a uniform prior the posterior of the similarity is a beta distribution, and the probability that it reaches
    the threshold after m of n matches is that of at most m successes in n + 1 trials of the threshold's probability.
    """
    found = []
    for n in range(STEP, STEP * (steps + 1), STEP):
        total, m = 0.0, -1
        while total < tolerance:
            m += 1
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        found.append(m)
    return found


def linked(sets_a: list[np.ndarray], sets_b: list[np.ndarray], hashes_a: np.ndarray, hashes_b: np.ndarray, threshold: float, tolerance: float) -> np.ndarray:
    """Which pairs of two blocks reach the threshold, as a table of truth values; hashes are the first STEP * STEPS MinHash values of each set."""
    size_a, size_b = (np.array([len(s) for s in x], np.int64) for x in (sets_a, sets_b))
    open_ = np.minimum(size_a[:, None], size_b[None]) >= threshold * np.maximum(size_a[:, None], size_b[None]) - 1e-9
    matches = np.zeros(open_.shape, np.int32)
    for step, least in enumerate(least_matches(threshold, tolerance, STEPS)):
        rows, columns = np.flatnonzero(open_.any(1)), np.flatnonzero(open_.any(0))
        if not len(rows):
            return open_
        cut = slice(step * STEP, (step + 1) * STEP)
        b = hashes_b[columns, cut]
        for row in rows:
            matches[row, columns] += (b == hashes_a[row, cut]).sum(1, dtype=np.int32)
        open_ &= matches >= least
    rows, columns = np.flatnonzero(open_.any(1)), np.flatnonzero(open_.any(0))
    common = _common([sets_a[i] for i in rows], [sets_b[i] for i in columns])
    union = size_a[rows][:, None] + size_b[columns][None] - common
    found = np.zeros(open_.shape, bool)
    found[np.ix_(rows, columns)] = common >= threshold * union - 1e-9
    return found & open_


def _common(sets_a: list[np.ndarray], sets_b: list[np.ndarray], width: int = 16384) -> np.ndarray:
    """Sizes of all intersections, by products of incidence tables of bounded width."""
    common = np.zeros((len(sets_a), len(sets_b)), np.int64)
    if not len(sets_a) or not len(sets_b):
        return common
    both = np.intersect1d(np.unique(np.concatenate(sets_a)), np.unique(np.concatenate(sets_b)), assume_unique=True)
    if not len(both):
        return common

    def columns(sets: list[np.ndarray]) -> list[np.ndarray]:
        at = [np.minimum(np.searchsorted(both, s), len(both) - 1) for s in sets]
        return [a[both[a] == s] for a, s in zip(at, sets, strict=True)]

    def table(places: list[np.ndarray], start: int) -> np.ndarray:
        out = np.zeros((len(places), min(width, len(both) - start)), np.float32)
        for i, own in enumerate(places):
            low, high = np.searchsorted(own, (start, start + width))
            out[i, own[low:high] - start] = 1
        return out

    places_a, places_b = columns(sets_a), columns(sets_b)
    for start in range(0, len(both), width):
        common += np.rint(table(places_a, start) @ table(places_b, start).T).astype(np.int64)
    return common


def forest_parents(found: np.ndarray) -> np.ndarray:
    """For each row of a symmetric table: a neighbour that leads, through further ones, to the root of its component; -1 for roots."""
    n = len(found)
    parent, seen = np.full(n, -1), np.zeros(n, bool)
    for root in range(n):
        if seen[root]:
            continue
        seen[root], layer = True, [root]
        while layer:
            at = layer.pop()
            new = np.flatnonzero(found[at] & ~seen)
            seen[new], parent[new] = True, at
            layer += new.tolist()
    return parent


def _sketches(documents: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sizes, digests, bands = [], [], []
            for text in batch.column("text").to_pylist():
                runs = shingles(text)
                sizes.append(len(runs))
                # two sums over the mixed codes of the set name it
                mixed = (runs ^ (runs >> np.uint64(33))) * np.uint64(0xC2B2AE3D27D4EB4F)
                digests.append(runs.sum(dtype=np.uint64).tobytes() + mixed.sum(dtype=np.uint64).tobytes() + len(runs).to_bytes(4, "little") if len(runs) else None)
                bands.append(band_codes(min_hashes(runs)) if len(runs) else None)
            yield pa.record_batch([batch.column("key"), batch.column("doc_id"), pa.array(sizes, pa.int32()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["key", "doc_id", "n", "digest", "bands"])

    keyed = doc_texts(documents).select(row_key().alias("key"), "doc_id", "text")
    return keyed.mapInArrow(run, "key long, doc_id long, n int, digest binary, bands array<long>")


def _contracted(meets: DataFrame) -> DataFrame:
    """Edges (a, b) that join the same representatives: each to its least head, and that one to its other heads.

    A representative has at most one head for each band, so the lists are short; those of a group of near copies are
    much alike, and what they have in common is kept once.
    """
    own = meets.groupBy("rep").agg(F.array_sort(F.collect_set("head")).alias("heads"))
    least = own.select(F.col("heads")[0].alias("a"), F.col("rep").alias("b"))
    lists = own.where(F.size("heads") > 1).select("heads").distinct()
    return least.union(lists.select(F.col("heads")[0].alias("a"), F.explode(F.slice("heads", 2, BANDS)).alias("b")).distinct())


def _planned(scratch: Scratch, reps: DataFrame, edges: DataFrame, components: DataFrame) -> DataFrame:
    """rep, copies, groups (array<struct<low, high>>): the pairs of blocks in which a representative is compared.

    A component within the bounds is one block. A larger one is cut by size class and by the least representative that
    its members share a band with, so that near copies stay together; such a set that is larger than a block is dealt
    by a hash. Tables of counts are written before they are joined, so that adaptive execution can split a hot component.
    """
    ratio = 1.25  # sets that differ by more can't reach 0.8; lower thresholds reach over more classes
    near = edges.groupBy(F.col("b").alias("near_rep")).agg(F.min("a").alias("least"))
    members = components.join(reps.select("rep", "n", "copies"), F.col("node") == F.col("rep")).join(near, F.col("node") == F.col("near_rep"), "left")
    members = scratch.keep(members.select("rep", "n", "copies", F.col("label").alias("comp"), F.coalesce("least", "rep").alias("place"), F.floor(F.log("n") / F.log(F.lit(ratio))).cast("int").alias("size_class")), "members")
    whole = scratch.keep(members.groupBy("comp").agg(((F.count("*") > BLOCK) | (F.sum("n") > BLOCK_CODES)).alias("large")).where("large").select(F.col("comp").alias("large_comp")), "large")
    split = members.join(whole, F.col("comp") == F.col("large_comp"), "left")
    small = split.where("large_comp is null").select("rep", "copies", F.array(F.struct(F.col("comp").alias("low"), F.col("comp").alias("high"))).alias("groups"))

    rows = F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.floor(BLOCK_CODES / F.pow(F.lit(ratio), F.col("size_class"))))).cast("long")
    cut = ["comp", "size_class"]
    places = scratch.keep(split.where("large_comp is not null").groupBy(*cut, "place").agg(F.count("*").alias("m")).withColumn("rows", rows), "places")
    rest = scratch.keep(places.where("m < rows").groupBy(*cut).agg(F.ceil(F.sum("m") / F.first("rows")).alias("blocks")), "rest")
    own = places.join(rest, cut, "left").select(*[F.col(c).alias(f"of_{c}") for c in (*cut, "place")], "m", "rows", "blocks")
    own = scratch.keep(own, "cuts")
    larger = split.where("large_comp is not null").drop("large_comp")
    dealt = larger.join(own, (F.col("comp") == F.col("of_comp")) & (F.col("size_class") == F.col("of_size_class")) & (F.col("place") == F.col("of_place")))
    together = F.xxhash64("comp", "size_class", F.pmod(F.xxhash64("place"), "blocks"))
    apart = F.xxhash64("comp", "size_class", "place", F.pmod(F.xxhash64("rep", F.lit(3)), F.ceil(F.col("m") / F.col("rows"))))
    dealt = scratch.keep(dealt.select("rep", "copies", "size_class", F.when(F.col("m") < F.col("rows"), together).otherwise(apart).alias("block")), "dealt")

    touched = reps.select(F.col("rep").alias("banded"), F.explode("bands").alias("band")).join(dealt, F.col("banded") == F.col("rep"))
    touched = scratch.keep(touched.select("band", "block", "size_class").distinct(), "touched")
    other = scratch.read("touched", touched.schema).select(F.col("band").alias("other_band"), F.col("block").alias("other"), F.col("size_class").alias("other_class"))
    meets = (F.col("band") == F.col("other_band")) & (F.col("block") <= F.col("other")) & (F.abs(F.col("size_class") - F.col("other_class")) <= 1)
    pairs = touched.join(other, meets).select(F.col("block").alias("low"), F.col("other").alias("high")).distinct()
    listed = pairs.select("low", "high", F.explode(F.array_distinct(F.array("low", "high"))).alias("in_block")).groupBy("in_block").agg(F.collect_list(F.struct("low", "high")).alias("groups"))
    planned = scratch.keep(small.withColumn("block", F.col("groups")[0]["low"]).union(dealt.join(listed, F.col("block") == F.col("in_block")).select("rep", "copies", "groups", "block")), "planned")
    scratch.drop("members", "large", "places", "rest", "cuts", "dealt", "touched")
    return planned


def jaccard_classes(spark: SparkSession, documents: DataFrame, threshold: float = 0.8, tolerance: float = 1e-6) -> DataFrame:
    """One row for each row of documents: key, doc_id, class_id, n_links, keeper.

    class_id is the least doc_id of all documents that links join, n_links the number of other rows linked with this
    one, copies among them; keeper is the key of the row that stays if one of each class does. A null, empty or
    wordless text has no links. Repeated rows are copies of each other. Texts of any length are taken whole; an empty table
    gives no rows, columns other than doc_id and text are left out. The threshold must be 0.8 at least.
    """
    if threshold < 0.8:
        raise ValueError("bands and size classes are made for thresholds of 0.8 and more")
    scratch = Scratch(spark)
    rows = scratch.keep(_sketches(documents), "rows")
    some = rows.where("n > 0")
    # copies have equal bands
    reps = some.groupBy("digest").agg(F.min("key").alias("rep"), F.min("n").alias("n"), F.count("*").alias("copies"), F.min(F.struct("doc_id", "key")).alias("first"), F.first("bands").alias("bands"))
    reps = scratch.keep(reps, "reps")
    # dealt by band once, for both the heads and the join with them, at every size
    banded = reps.select("rep", F.explode("bands").alias("band")).repartition("band")
    heads = banded.groupBy("band").agg(F.min("rep").alias("head"), F.max("rep").alias("other")).where("head <> other").select(F.col("band").alias("in_band"), "head")
    meets = banded.join(heads.hint("merge"), F.col("band") == F.col("in_band")).where("rep <> head")
    edges = scratch.keep(_contracted(meets), "edges")
    planned = _planned(scratch, reps, edges, connected_components(scratch, edges, "candidates"))
    # repeated rows share a key and are one from here on, so that no set is made or shipped twice
    once = doc_texts(documents).select(row_key().alias("key"), "text").groupBy("key").agg(F.first("text").alias("text"))
    texts = once.join(planned.hint("merge"), F.col("key") == F.col("rep")).select("rep", "copies", "block", "groups", "text")

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingles(t) for t in batch.column("text").to_pylist()]
            hashes = [min_hashes(s, 0, STEP * STEPS).tobytes() for s in sets]
            yield pa.record_batch([*(batch.column(c) for c in ("rep", "copies", "block", "groups")), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array(hashes, pa.binary())], names=["rep", "copies", "block", "groups", "runs", "hashes"])

    sets = texts.mapInArrow(runs, "rep long, copies long, block long, groups array<struct<low: long, high: long>>, runs binary, hashes binary")
    sets = sets.select("rep", "copies", "block", "runs", "hashes", F.explode("groups").alias("pair")).select("rep", "copies", "block", "pair.low", "pair.high", "runs", "hashes")

    def verify(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("rep").reset_index(drop=True)
        sets_ = [np.frombuffer(r, np.uint64) for r in frame["runs"]]
        hashes = np.frombuffer(b"".join(frame["hashes"]), np.uint32).reshape(len(frame), -1)
        found = np.zeros((len(frame), len(frame)), bool)
        low, high = key
        if low == high:
            found = linked(sets_, sets_, hashes, hashes, threshold, tolerance)
            np.fill_diagonal(found, False)
        else:
            at_a, at_b = (np.flatnonzero(frame["block"] == x) for x in (low, high))
            part = linked([sets_[i] for i in at_a], [sets_[i] for i in at_b], hashes[at_a], hashes[at_b], threshold, tolerance)
            found[np.ix_(at_a, at_b)] = part
            found[np.ix_(at_b, at_a)] = part.T
        parent = forest_parents(found)
        reps_ = frame["rep"].to_numpy()
        out = pd.DataFrame({"rep": reps_, "other": reps_[parent], "links": found @ frame["copies"].to_numpy()})
        out.loc[parent < 0, "other"] = reps_[parent < 0]
        return out[out["links"] > 0]

    links = scratch.keep(sets.groupBy("low", "high").applyInPandas(verify, "rep long, other long, links long"), "links")
    classes = connected_components(scratch, links.select(F.col("rep").alias("a"), F.col("other").alias("b")), "classes")
    counted = links.groupBy("rep").agg(F.sum("links").alias("links")).withColumnRenamed("rep", "linked_rep")
    named = reps.join(classes, F.col("rep") == F.col("node"), "left").join(counted, F.col("rep") == F.col("linked_rep"), "left")
    named = scratch.keep(named.select("digest", F.coalesce("label", "rep").alias("label"), "first", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "named")
    firsts = scratch.keep(named.groupBy("label").agg(F.min("first").alias("least")).withColumnRenamed("label", "class_label"), "firsts")
    final = scratch.keep(named.join(firsts, F.col("label") == F.col("class_label")).select(F.col("digest").alias("of"), "n_links", F.col("least.doc_id").alias("class_id"), F.col("least.key").alias("keeper")), "final")
    scratch.drop("reps", "edges", "planned", "links", "named", "firsts")
    joined = rows.select("key", "doc_id", "digest").join(final, F.col("digest") == F.col("of"), "left")
    alone = F.col("digest").isNull()
    return joined.select(
        "key", "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("keeper", "key").alias("keeper"),
    )


def keep_one(spark: SparkSession, documents: DataFrame, threshold: float = 0.8) -> DataFrame:
    """documents with one row of each class: that of the least doc_id. Wordless rows stay, repeated ones once.

    Columns, whatever their names, go through unchanged.
    """
    classes = jaccard_classes(spark, documents, threshold)
    kept = classes.where("key = keeper").select(F.col("key").alias("kept_key")).distinct()
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = documents.select(F.struct("*").alias("row"), F.xxhash64(F.col("doc_id").cast("long"), text, F.length(text)).alias("row_key"))
    return keyed.join(kept, F.col("row_key") == F.col("kept_key"), "left_semi").dropDuplicates(["row_key"]).select("row.*")
