"""The LSH forest against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from brasswork.llm import lsh_forest
from brasswork.llm.common import Scratch

SCHEMA = "doc_id long, text string, lang string, key string, rep string, n int, label string"


def plain_set(text):
    words = [w.translate({c: c + 32 for c in range(65, 91)}) for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", text or "")]
    return {tuple(words)} if len(words) == 1 else set(zip(words, words[1:], strict=False))


def brute(rows):
    sets = [plain_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    out = []
    for i, (doc, _) in enumerate(rows):
        least = min((d for k, (d, _) in enumerate(rows) if root(k) == root(i) and d is not None), default=None)
        out.append((doc, len(sets[i]), least, doc == least))
    return out


def corpus(seed, near):
    r = random.Random(seed)
    names = ["".join(r.choice("abcDEÉß") for _ in range(r.randint(1, 8))) for _ in range(2000)]
    text = lambda k: [r.choice(names) for _ in range(k)]
    out = [None, "", " \n", "One", "oNE", "É", "é", "two words", "TWO\x0bwords", "a b a b a b"]
    out += [" ".join(text(r.randint(1, 200))) for _ in range(30)]
    for _ in range(6):  # chains: each differs from the one before it
        words = text(r.randint(40, 160))
        for _ in range(8):
            words = list(words)
            for _ in range(r.randint(0, len(words) // 18)):
                words[r.randrange(len(words))] = r.choice(names)
            out.append(" ".join(words))
    base = text(150)
    for _ in range(near):
        words = list(base)
        for _ in range(r.randint(0, 14)):
            words[r.randrange(150)] = r.choice(names)
        out.append(" ".join(words))
    return out


def check(spark, rows, **given):
    docs = spark.createDataFrame([(*x, "en", "k", "r", 1, "l") for x in rows], SCHEMA)
    got = [tuple(x) for x in lsh_forest.near_components(spark, docs, **given).collect()]
    order = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted(got, key=order) == sorted(brute(rows), key=order)


def test_all_pairs(spark):
    texts = corpus(1, 40)
    rows = [(i * 7 % 1009 - 3, t) for i, t in enumerate(texts)] + [(None, "nameless thing"), (None, texts[60]), (5000, texts[60]), (5000, texts[60]), (5000, texts[60].upper())]
    check(spark, rows)


@pytest.mark.parametrize("most", [4, 24])
def test_dense_parts_are_cut_without_loss(spark, most):
    check(spark, [(i, t) for i, t in enumerate(corpus(most, 120))], most=most)


def test_open_blocks_are_found(spark):
    """Members of a dense part that the deeper orders leave apart are compared in blocks."""
    r = random.Random(4)
    base = [f"w{r.randrange(10**6)}" for _ in range(200)]
    texts = []
    for k in range(90):
        words = list(base)
        for _ in range(16):
            words[r.randrange(200)] = f"x{k}y{r.randrange(10**6)}"
        texts.append(" ".join(words))
    sets = [plain_set(t) for t in texts]
    assert len({len(a & b) * 100 >= 80 * len(a | b) for a in sets for b in sets}) == 2
    check(spark, [(i, t) for i, t in enumerate(texts + [" ".join(base)])], most=3)


def test_repeated_rows_are_one(spark):
    docs = spark.range(40000).selectExpr("7L as doc_id", "'the very same text of some words' as text")
    docs = docs.union(spark.createDataFrame([(1, "the very same text of some words"), (2, "another")], docs.schema))
    got = lsh_forest.near_components(spark, docs).groupBy("doc_id", "component_id", "kept", "n_shingles").count().collect()
    assert sorted(tuple(x) for x in got) == [(1, 1, True, 6, 1), (2, 2, True, 1, 1), (7, 1, False, 6, 40000)]
    planned = spark.createDataFrame([(k,) for k in [r[0] for r in docs.select(F.xxhash64("doc_id", "text", F.length("text"))).distinct().collect()]], "rep long")
    assert lsh_forest._with_sets(docs, Scratch(spark).keep(planned, "p")).count() == 3


def test_regions_end_where_prefixes_are_short():
    labels = [b"aa", b"aa", b"ab", b"ba", b"bb", b"bb", b"bc"]
    assert lsh_forest.region_ends(labels, [1] * 7, 4) == [3]
    assert lsh_forest.region_ends(labels, [1] * 7, 7) == []
    assert lsh_forest.region_ends(labels, [3_000_000] * 3 + [1] * 4, 7) == [1, 2, 3]
    r = random.Random(0)
    for _ in range(50):
        labels = sorted(bytes(r.randrange(3) for _ in range(4)) for _ in range(r.randint(1, 60)))
        ends = [0, *lsh_forest.region_ends(labels, [1] * len(labels), 5), len(labels)]
        assert all(0 < b - a <= 5 for a, b in zip(ends, ends[1:], strict=False))


def test_sets():
    assert len(lsh_forest.shingles("A b\tA B")) == 2 and len(lsh_forest.shingles("x")) == 1 and not len(lsh_forest.shingles(" \x0c"))
    assert np.array_equal(lsh_forest.shingles("ÉA b"), lsh_forest.shingles("Éa B")) and not np.array_equal(lsh_forest.shingles("É"), lsh_forest.shingles("é"))


def test_empty_table(spark):
    assert lsh_forest.near_components(spark, spark.createDataFrame([], "doc_id long, text string")).collect() == []
