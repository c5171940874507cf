"""Filter interaction audit (operator 12).

What five filters take from each other, whatever the order they run in. Native expressions give each document a mask
of five bits, one for each filter that it fails; one aggregation leaves at most 32 cells of counts for each part, and
all 120 orders of the filters are read from these cells alone.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FILTERS = "ABCDE"
SPACES = r"[\x20\x09-\x0D]+"
MIN_WORDS = 200
MIN_DISTINCT = 50  # per cent of the words
MAX_CAPITALS = 3  # per cent of the code points
SYMBOLS = "[#$%&*|]"
SALTS = 997
LAST = 1 << (len(FILTERS) - 1)  # the bit of the last filter, which compares documents with each other


def text_mask(text: Column) -> Column:
    """Bits of A to D, the filters that read a document's own text; the bit of A is 1."""
    words = F.array_remove(F.split(text, SPACES), "")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]++", ""))
    fails = (
        F.size(words) < MIN_WORDS,
        100 * F.size(F.array_distinct(words)) < MIN_DISTINCT * F.size(words),
        100 * capitals > MAX_CAPITALS * F.length(text),
        text.rlike(SYMBOLS),
    )
    return sum((F.when(fail, 1 << k).otherwise(0) for k, fail in enumerate(fails)), F.lit(0))


def cells(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: documents of each part by the set of filters they fail, at most 32 rows a part.

    Equal texts are told by SHA-256, so no text is shuffled. Rows are counted by document, then by text, part and
    labels, before the least doc_id of a text meets them: a text that a third of all rows share is a few rows there.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    read = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("digest"), text_mask(text).alias("mask"),
    )
    # repeated rows become one with a count; rows without a doc_id are dealt by a salt and meet no label
    salt = F.when(F.col("doc_id").isNull(), 1 + F.pmod(F.xxhash64("digest"), SALTS)).otherwise(0)
    rows = read.groupBy("doc_id", "part", "digest", "mask").agg(F.count("*").alias("n"))
    rows = rows.withColumn("salt", salt).withColumn("of", F.coalesce("doc_id", F.lit(0)))
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("labelled")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")
    )
    rows = rows.join(known, (F.col("of") == F.col("labelled")) & (F.col("salt") == 0), "left")
    rows = rows.select("doc_id", "part", "digest", "mask", "n", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))

    # of each text, part and labels: the number of rows, the least doc_id and how many rows have it; a null doc_id is
    # neither smaller than another nor larger
    some = F.col("doc_id").isNotNull()
    kinds = rows.groupBy("digest", "mask", "part", "good", "toxic").agg(
        F.sum("n").alias("n"), F.min(F.when(some, F.struct("doc_id", "n"))).alias("first"), F.coalesce(F.sum(F.when(~some, F.col("n"))), F.lit(0)).alias("nameless")
    )
    held = kinds.withColumn("least", F.min("first.doc_id").over(Window.partitionBy("digest")))  # a row a part and label
    originals = F.col("nameless") + F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0)
    split = held.select(
        "part", "good", "toxic",
        F.explode(F.array(F.struct(F.col("mask").alias("mask"), originals.alias("n")), F.struct((F.col("mask") + LAST).alias("mask"), (F.col("n") - originals).alias("n")))).alias("cell"),
    )
    return split.where("cell.n > 0").groupBy("part", F.col("cell.mask").alias("mask")).agg(
        F.sum("cell.n").alias("n"), F.sum(F.when(F.col("good"), F.col("cell.n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), F.col("cell.n")).otherwise(0)).alias("toxic")
    )


def _bits(letters: Column) -> Column:
    return sum((F.when(F.instr(letters, f) > 0, 1 << k).otherwise(0) for k, f in enumerate(FILTERS)), F.lit(0))


def filter_orders(cells_: DataFrame) -> DataFrame:
    """All orders of the filters and their steps for each part, from its cells; see audit."""
    table = cells_.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # at most 32
    orders = F.split(F.lit(",".join("".join(p) for p in permutations(FILTERS))), ",")
    steps = table.select("part", "cells", F.explode(orders).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    steps = steps.withColumn("filter", F.substring("filter_order", F.col("step"), F.lit(1)))
    steps = steps.withColumn("own", _bits(F.col("filter"))).withColumn("before", _bits(F.substring("filter_order", F.lit(1), F.col("step") - 1)))

    def total(field: str, when: str) -> Column:
        return F.expr(f"aggregate(filter(cells, c -> {when}), 0L, (s, c) -> s + c.{field})")

    removed = "(c.mask & before) = 0 and (c.mask & own) <> 0"
    counted = steps.select(
        "part", "filter_order", "step", "filter",
        total("n", "(c.mask & (before | own)) = 0").alias("kept"),
        total("n", removed).alias("removed"),
        total("n", "(c.mask & before) <> 0 and (c.mask & own) <> 0").alias("redundant"),
        total("n", "c.mask = own").alias("unique_fails"),
        total("good", removed).alias("good_lost"),
        total("toxic", removed).alias("toxic_lost"),
    )
    shapley = F.sum("removed").over(Window.partitionBy("part", "filter"))  # 120 rows
    return counted.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", shapley.alias("shapley"))


def audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: 600 rows a part.

    A null text is an empty one: it fails A, and E if an earlier document is empty too. A null lang is the part of the
    empty string. A null doc_id is no smaller than any, and none is smaller than it, so its row never fails E; it has
    no labels. Repeated rows each count; as their doc_id is the same, they don't make each other fail E. If a doc_id has
    several labels, one that says 1 is enough. Texts of any length are read whole; an empty table gives no rows.
    Columns of either table beside doc_id, text, lang, quality and toxic are left out, whatever their names.
    """
    return filter_orders(cells(documents, labels))


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words, min(doc_id) OVER (PARTITION BY text) AS least FROM d
), m AS (
  SELECT doc_id, part,
    CASE WHEN len(words) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN doc_id > least THEN 16 ELSE 0 END AS mask
  FROM w
), l AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), c AS (
  SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY part, mask
), f AS (
  SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS t(f, bit)
), p AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM f a, f b, f c, f d, f e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit | b.bit | c.bit | d.bit | e.bit = 31
), s AS (
  SELECT filter_order, step, bits[step] AS own, CAST(coalesce(list_sum(bits[1:step - 1]), 0) AS INTEGER) AS before FROM p, range(1, 6) AS r(step)
), o AS (
  SELECT part, filter_order, step, own,
    sum(CASE WHEN mask & (before | own) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & before = 0 AND mask & own <> 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & before <> 0 AND mask & own <> 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = own THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & before = 0 AND mask & own <> 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & before = 0 AND mask & own <> 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM s, c GROUP BY part, filter_order, step, own
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM o
"""
