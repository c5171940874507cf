"""MinHash near-duplicates by an LSH forest (operator 13).

A document is the set of its pairs of neighbouring words, A to Z in lower case. Documents of equal sets are copies, and
one stands for them. The forest holds its signature in many orders; in each order, documents whose labels share a prefix
of DEPTH values lie side by side. Such a region at the least depth makes its documents candidates of each other:

- Regions that meet in a component of bounded size are compared whole.
- In a dense part, where a component is larger, the depth adapts: its members are sorted by the longer labels of a few
  orders and cut into regions of bounded size where neighbours share the shortest prefix, so a region holds neighbours of
  the longest common prefixes. Each is compared whole, which joins nearly all of a group of near copies.
- What this leaves open is closed without loss: members of a dense part that share a region of the least depth but are
  not yet joined are compared in blocks. Members already joined need no comparison, as only components are asked for.

Every link is confirmed on the whole sets. Two documents at the threshold share no region in any of the TREES orders with
a probability under 1e-5, and a link is pruned by its MinHash values with one under the tolerance; nothing else is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brasswork.llm.common import Scratch, doc_texts, row_key, slices
from brasswork.llm.components import connected_components
from brasswork.llm.near_duplicates import STEP, STEPS, band_codes, forest_parents, linked, min_hashes

TREES, DEPTH = 64, 8  # orders, and the values of the least prefix in each
ORDERS, LABELS = 3, 16  # orders in which dense parts are sorted deeper, and the values of their labels
REGION = 1024  # documents of a region, at most
REGION_CODES = 2_000_000  # codes of the sets of a region, about
_MIX, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class _WordCodes(dict):
    """64-bit hashes of words; at most limit short ones are kept."""

    def __init__(self, limit: int = 150_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < self.limit and len(word) <= 32:
            self[word] = value
        return value


_CODES = _WordCodes()


def shingles(text: str) -> np.ndarray:
    """Sorted distinct 64-bit codes of pairs of neighbouring words; a single word is one of its own, no word gives none."""
    words = text.encode().lower().split()  # of bytes: A to Z, and space and 09 to 0D
    if not words:
        return np.empty(0, np.uint64)
    codes = np.fromiter(map(_CODES.__getitem__, words), np.uint64, len(words))
    if len(words) == 1:
        return codes
    second = codes[1:] ^ (codes[1:] >> np.uint64(29))
    pairs = codes[:-1] * _MIX + second * _MIX2
    return np.unique((pairs ^ (pairs >> np.uint64(31))) * _MIX)


def _sketches(documents: DataFrame) -> DataFrame:
    """key, doc_id, n, digest (names a set), prefixes (one for each tree), labels (those of the deeper orders)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sizes, digests, prefixes, labels = [], [], [], []
            for text in batch.column("text").to_pylist():
                own = shingles(text)
                sizes.append(len(own))
                if not len(own):
                    digests.append(None), prefixes.append(None), labels.append(None)
                    continue
                mixed = (own ^ (own >> np.uint64(33))) * np.uint64(0xC2B2AE3D27D4EB4F)
                digests.append(own.sum(dtype=np.uint64).tobytes() + mixed.sum(dtype=np.uint64).tobytes() + len(own).to_bytes(4, "little"))
                values = min_hashes(own, 0, TREES * DEPTH)
                prefixes.append(band_codes(values))
                labels.append((values[: ORDERS * LABELS] & np.uint32(255)).astype(np.uint8).tobytes())
            columns = [pa.array(sizes, pa.int32()), pa.array(digests, pa.binary()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(labels, pa.binary())]
            yield pa.record_batch([batch.column("key"), batch.column("doc_id"), *columns], names=["key", "doc_id", "n", "digest", "prefixes", "labels"])

    keyed = doc_texts(documents).select(row_key().alias("key"), "doc_id", "text")
    return keyed.mapInArrow(run, "key long, doc_id long, n int, digest binary, prefixes array<long>, labels binary")


def _least_regions(reps: DataFrame) -> DataFrame:
    """Edges (a, b) that join representatives of the same region of the least depth: each region's first with all others.

    A representative has at most one first for each tree; near copies have mostly the same, and what their lists have in
    common is kept once.
    """
    placed = reps.select("rep", F.explode("prefixes").alias("prefix")).repartition("prefix")
    regions = placed.groupBy("prefix").agg(F.min("rep").alias("head"), F.max("rep").alias("last")).where("head <> last")
    meets = placed.join(regions.select(F.col("prefix").alias("in_region"), "head").hint("merge"), F.col("prefix") == F.col("in_region"))
    own = meets.where("rep <> head").groupBy("rep").agg(F.array_sort(F.collect_set("head")).alias("heads"))
    joined = own.select(F.col("heads")[0].alias("a"), F.col("rep").alias("b"))
    lists = own.where(F.size("heads") > 1).select("heads").distinct()
    return joined.union(lists.select(F.col("heads")[0].alias("a"), F.explode(F.slice("heads", 2, TREES)).alias("b")).distinct())


def prefix_length(a: bytes, b: bytes) -> int:
    return next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def region_ends(labels: list[bytes], sizes: list[int], most: int = REGION) -> list[int]:
    """Where sorted labels are cut: regions within both bounds, ending where neighbours share the shortest prefix.

    A cut is made in the last half of what fits; a single label that is larger than a region's codes is one of its own.
    What is behind the last cut is left open.
    """
    ends, start, total = [], 0, 0
    for at, size in enumerate(sizes):
        while at > start and (at - start >= most or total + size > REGION_CODES):
            least = start + max(1, (at - start) // 2)
            end = min(range(least, at + 1), key=lambda k: (prefix_length(labels[k - 1], labels[k]), -k))
            ends.append(end)
            total -= sum(sizes[start:end])
            start = end
        total += size
    return ends


def _deeper_regions(dense: DataFrame, most: int) -> DataFrame:
    """rep, region: ORDERS rows for each member of a dense part, by sorted labels; no key gathers rows in one task."""
    orders = F.explode(F.array(*[F.struct(F.lit(k).alias("tree"), F.substring("labels", k * LABELS + 1, LABELS).alias("label")) for k in range(ORDERS)]))
    rows = dense.select("comp", "rep", "n", orders.alias("order")).select("comp", "order.tree", "order.label", "rep", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        total = 0

        def flush(rows_: list[tuple]) -> pa.RecordBatch:
            name = xxhash.xxh3_64_intdigest(b"%d %d" % (rows_[0][1], rows_[0][3])) - 2**63  # a tree has a member once
            return pa.record_batch([pa.array([r[3] for r in rows_], pa.int64()), pa.array([name] * len(rows_), pa.int64())], names=["rep", "region"])

        for batch in slices(batches):
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and row[:2] != held[0][:2]:
                    yield flush(held)
                    held, total = [], 0
                held.append(row)
                total += row[4]
                if len(held) > most or total > REGION_CODES and len(held) > 1:
                    start = 0
                    for end in region_ends([r[2] for r in held], [r[4] for r in held], most):
                        yield flush(held[start:end])
                        start = end
                    held = held[start:]
                    total = sum(r[4] for r in held)
        if held:
            yield flush(held)

    return rows.repartitionByRange("comp", "tree", "label", "rep").sortWithinPartitions("comp", "tree", "label", "rep").mapInArrow(run, "rep long, region long")


def _with_sets(documents: DataFrame, planned: DataFrame) -> DataFrame:
    """The columns of planned (rep first) with runs and hashes: set and MinHash values of the text of each rep."""
    # repeated rows have one key, and are made one before they are shuffled
    texts = doc_texts(documents).select(row_key().alias("key"), "text").groupBy("key").agg(F.first("text").alias("text"))
    rows = planned.hint("merge").join(texts, F.col("rep") == F.col("key")).select(*planned.columns, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingles(t) for t in batch.column("text").to_pylist()]
            hashes = [min_hashes(s, 0, STEP * STEPS).tobytes() for s in sets]
            columns = [*batch.columns[:-1], pa.array([s.tobytes() for s in sets], pa.binary()), pa.array(hashes, pa.binary())]
            yield pa.record_batch(columns, names=[*batch.schema.names[:-1], "runs", "hashes"])

    kinds = ", ".join(f"{field.name} {field.dataType.simpleString()}" for field in planned.schema)
    return rows.mapInArrow(run, f"{kinds}, runs binary, hashes binary")


def _sets_of(frame: pd.DataFrame) -> tuple[list[np.ndarray], np.ndarray]:
    return [np.frombuffer(r, np.uint64) for r in frame["runs"]], np.frombuffer(b"".join(frame["hashes"]), np.uint32).reshape(len(frame), -1)


def _forest_rows(reps: np.ndarray, found: np.ndarray) -> pd.DataFrame:
    """a, b: a spanning forest of the links, so a group of near copies never becomes a list of pairs."""
    parent = forest_parents(found)
    return pd.DataFrame({"a": reps[parent >= 0], "b": reps[parent[parent >= 0]]})


def _links_of_regions(sets: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    def verify(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("rep").reset_index(drop=True)
        own, hashes = _sets_of(frame)
        found = linked(own, own, hashes, hashes, threshold, tolerance)
        np.fill_diagonal(found, False)
        return _forest_rows(frame["rep"].to_numpy(), found)

    rows = sets.select("rep", "runs", "hashes", F.explode("regions").alias("region"))
    return rows.groupBy("region").applyInPandas(verify, "a long, b long")


def _open_blocks(scratch: Scratch, dense: DataFrame, labels: DataFrame, most: int) -> DataFrame | None:
    """rep, label, block, pairs: blocks of members of dense parts that share a region of the least depth with others than
    those they are joined with. Blocks of one label don't meet each other. None if nothing is open.
    """
    ratio = 1.25  # sets that differ by more can't reach 0.8
    named = dense.join(labels.select(F.col("node").alias("of"), F.col("label").alias("joined")), F.col("rep") == F.col("of"), "left")
    named = scratch.keep(named.select("rep", "n", "comp", F.coalesce("joined", "rep").alias("label"), F.floor(F.log("n") / F.log(F.lit(ratio))).cast("int").alias("size_class"), "prefixes"), "named")
    placed = named.select("rep", "label", F.explode("prefixes").alias("prefix"))
    regions = placed.groupBy("prefix").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select(F.col("prefix").alias("open_prefix"))
    opened = placed.join(regions.hint("merge"), F.col("prefix") == F.col("open_prefix")).select("rep", "prefix")
    opened = scratch.keep(opened, "opened")
    if opened.isEmpty():
        scratch.drop("named", "opened")
        return None
    members = opened.select(F.col("rep").alias("open_rep")).distinct()
    members = scratch.keep(named.drop("prefixes").join(members, F.col("rep") == F.col("open_rep"), "left_semi"), "open-members")
    rows = F.greatest(F.lit(1), F.least(F.lit(most), F.floor(REGION_CODES / F.pow(F.lit(ratio), F.col("size_class"))))).cast("long")
    counts = scratch.keep(members.groupBy("comp", "size_class", "label").agg(F.count("*").alias("m")).withColumn("rows", rows), "counts")
    rest = scratch.keep(counts.where("2 * m < rows").groupBy("comp", "size_class").agg(F.ceil(F.sum("m") / F.first("rows")).alias("parts")), "rest")
    plan = counts.join(rest, ["comp", "size_class"], "left").select(F.col("label").alias("of_label"), F.col("size_class").alias("of_class"), "m", "rows", "parts")
    plan = scratch.keep(plan, "plan")
    alone = F.col("2m") >= F.col("rows")
    dealt = members.join(plan, (F.col("label") == F.col("of_label")) & (F.col("size_class") == F.col("of_class"))).withColumn("2m", 2 * F.col("m"))
    of_one = F.xxhash64(F.lit("one"), "label", "size_class", F.pmod(F.xxhash64("rep", F.lit(3)), F.ceil(F.col("m") / F.col("rows"))))
    of_many = F.xxhash64(F.lit("many"), "comp", "size_class", F.pmod(F.xxhash64("label"), "parts"))
    dealt = scratch.keep(dealt.select("rep", "label", "size_class", F.when(alone, F.col("label")).alias("only"), F.when(alone, of_one).otherwise(of_many).alias("block")), "dealt")

    touched = opened.select(F.col("rep").alias("open_rep"), "prefix").join(dealt, F.col("open_rep") == F.col("rep"))
    touched = scratch.keep(touched.select("prefix", "block", "size_class", "only").distinct(), "touched")
    other = scratch.read("touched", touched.schema).select(F.col("prefix").alias("other_prefix"), F.col("block").alias("other"), F.col("size_class").alias("other_class"), F.col("only").alias("other_only"))
    same = F.coalesce(F.col("only") == F.col("other_only"), F.lit(False))
    meets = (F.col("prefix") == F.col("other_prefix")) & (F.col("block") <= F.col("other")) & (F.abs(F.col("size_class") - F.col("other_class")) <= 1) & ~same
    pairs = touched.join(other, meets).select(F.col("block").alias("low"), F.col("other").alias("high")).distinct()
    listed = pairs.select("low", "high", F.explode(F.array_distinct(F.array("low", "high"))).alias("in_block")).groupBy("in_block").agg(F.collect_list(F.struct("low", "high")).alias("pairs"))
    planned = scratch.keep(dealt.join(listed, F.col("block") == F.col("in_block")).select("rep", "label", "block", "pairs"), "blocks")
    scratch.drop("named", "opened", "open-members", "counts", "rest", "plan", "dealt", "touched")
    return planned


def _links_of_blocks(sets: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    def verify(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("rep").reset_index(drop=True)
        own, hashes = _sets_of(frame)
        rows, columns = (np.flatnonzero(frame["block"] == x) for x in key)
        part = linked([own[i] for i in rows], [own[i] for i in columns], hashes[rows], hashes[columns], threshold, tolerance)
        labels = frame["label"].to_numpy()
        part &= labels[rows][:, None] != labels[columns][None]
        found = np.zeros((len(frame), len(frame)), bool)
        found[np.ix_(rows, columns)] = part
        found[np.ix_(columns, rows)] |= part.T
        return _forest_rows(frame["rep"].to_numpy(), found)

    rows = sets.select("rep", "label", "block", "runs", "hashes", F.explode("pairs").alias("pair")).select("rep", "label", "block", "runs", "hashes", "pair.low", "pair.high")
    return rows.groupBy("low", "high").applyInPandas(verify, "a long, b long")


def near_components(spark: SparkSession, documents: DataFrame, threshold: float = 0.8, tolerance: float = 1e-6, most: int = REGION) -> DataFrame:
    """One row for each row of documents: doc_id, n_shingles, component_id, kept.

    component_id is the least doc_id that links of a similarity of threshold or more reach, kept whether it is the row's
    own. A null, empty or wordless text has no shingles and no links. Rows of equal sets, repeated rows among them, are
    linked. A null doc_id is never the least one; where a component has no other, component_id is null and its rows are
    kept. Texts of any length are taken whole; an empty table gives no rows, and columns other than doc_id and text
    are left out, whatever their names. The threshold must be 0.8 at least; `most` documents are compared at a time.
    """
    if threshold < 0.8:
        raise ValueError("prefixes and size classes are made for thresholds of 0.8 and more")
    scratch = Scratch(spark)
    rows = scratch.keep(_sketches(documents), "rows")
    reps = rows.where("n > 0").groupBy("digest").agg(
        F.min("key").alias("rep"), F.min("n").alias("n"), F.min("doc_id").alias("least"), F.first("prefixes").alias("prefixes"), F.first("labels").alias("labels")
    )
    reps = scratch.keep(reps, "reps")
    edges = scratch.keep(_least_regions(reps), "edges")
    candidates = connected_components(scratch, edges, "candidates").select("node", F.col("label").alias("comp"))
    members = scratch.keep(reps.select("rep", "n").join(candidates, F.col("rep") == F.col("node")).select("rep", "n", "comp"), "members")
    large = scratch.keep(members.groupBy("comp").agg(((F.count("*") > most) | (F.sum("n") > REGION_CODES)).alias("large")).where("large").select(F.col("comp").alias("large_comp")), "large")
    split = members.join(large, F.col("comp") == F.col("large_comp"), "left")
    whole = split.where("large_comp is null").select("rep", F.xxhash64(F.lit("whole"), "comp").alias("region"))
    dense = split.where("large_comp is not null").select(F.col("rep").alias("member"), "comp")
    dense = scratch.keep(reps.join(dense, F.col("rep") == F.col("member")).select("rep", "n", "comp", "prefixes", "labels"), "dense")
    regions = whole.union(_deeper_regions(dense, most)).groupBy("rep").agg(F.collect_list("region").alias("regions"))  # ORDERS at most
    links = scratch.keep(_links_of_regions(_with_sets(documents, scratch.keep(regions, "regions")), threshold, tolerance), "links")
    labels = connected_components(scratch, links, "linked")
    blocks = _open_blocks(scratch, dense, labels, most)
    if blocks is not None:
        further = scratch.keep(_links_of_blocks(_with_sets(documents, blocks), threshold, tolerance), "further")
        labels = connected_components(scratch, links.union(further), "all")

    named = reps.select("digest", "rep", "least").join(labels, F.col("rep") == F.col("node"), "left").select("digest", "least", F.coalesce("label", "rep").alias("label"))
    named = scratch.keep(named, "names")
    firsts = scratch.keep(named.groupBy("label").agg(F.min("least").alias("component_id")).withColumnRenamed("label", "of_label"), "firsts")
    final = scratch.keep(named.join(firsts, F.col("label") == F.col("of_label")).select(F.col("digest").alias("of"), "component_id"), "final")
    scratch.drop("reps", "edges", "members", "large", "dense", "regions", "links", "blocks", "further", "names", "firsts")
    found = rows.select("doc_id", "n", "digest").join(final, F.col("digest") == F.col("of"), "left")
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return found.select("doc_id", F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
