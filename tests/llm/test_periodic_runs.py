"""Periodic runs against brute force: suffix order, longest previous factors, runs and their digests."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from brasswork.llm import periodic_runs as pr


def brute_runs(words):
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                found[i, j + q] = min(q, found.get((i, j + q), q))
            i = max(j, i + 1)
    return sorted(((b, e, q) for (b, e), q in found.items()), key=lambda r: (r[0], r[2]))


def sequences(seed, count):
    r = random.Random(seed)
    for _ in range(count):
        k = r.choice((1, 2, 2, 3, 5, 40))
        w = [r.randrange(k) for _ in range(r.randint(0, 120))]
        unit = [r.randrange(3) for _ in range(r.randint(1, 9))]
        kind = r.randrange(4)
        if kind == 1:
            w = w[:40] + unit * r.randint(2, 8) + w[40:60] + unit * r.randint(2, 8) + (w[:40] + unit * 5) * 2
        elif kind == 2 and w:
            a = r.randrange(len(w))
            p = 1 + (len(w) - a) // r.randint(3, 9)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
        elif kind == 3:
            a, b = [0], [0, 1]
            for _ in range(r.randint(1, 7)):
                a, b = b, b + a
            w = (b * r.randint(1, 3) + w)[:200] * r.randint(1, 2)
        yield [b"%d" % x for x in w]


def test_suffixes_and_factors():
    for words in sequences(3, 150):
        codes = pr.word_codes(words)
        text = codes.tolist()
        order = pr.suffix_array(codes)
        assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:])

        def shared(i, j):
            n = 0
            while max(i, j) + n < len(text) and text[i + n] == text[j + n]:
                n += 1
            return n

        lcp = pr.common_prefixes(codes, order)
        assert lcp.tolist() == [0 if k == 0 else shared(order[k - 1], order[k]) for k in range(len(text))]
        length, source = pr.previous_factors(order, lcp)
        assert length == [max((shared(j, i) for j in range(i)), default=0) for i in range(len(text))]
        assert all(n == 0 or (j < i and shared(j, i) == n) for i, (n, j) in enumerate(zip(length, source, strict=True)))


def test_runs_equal_brute_force():
    total = 0
    for words in sequences(5, 1500):
        want = brute_runs(words)
        total += len(want)
        assert pr.runs(pr.word_codes(words)) == want
    assert total > 1000
    group = list(sequences(6, 40))
    assert pr.runs_of_all(group) == [brute_runs(w) for w in group]


def test_runs_inside_blocks_are_copied():
    unit = [b"x", b"y"] * 5
    words = [b"a", b"b", *unit, b"c", b"d", b"e", b"a", b"b", *unit, b"c", b"d", b"f"]
    assert pr.runs(pr.word_codes(words)) == [(2, 12, 2), (17, 27, 2)]
    codes = pr.word_codes(words)
    order = pr.suffix_array(codes)
    length, source = pr.previous_factors(order, pr.common_prefixes(codes, order))
    assert (length[15], source[15]) == (14, 0)  # the second run lies strictly inside this block


@pytest.mark.parametrize("words", [[b"a"] * 60000, [b"%d" % (i * i % 15013) for i in range(15013)] * 4])
def test_long_repetitions(words):
    found = pr.runs(pr.word_codes(words))
    assert max(e - b for b, e, _ in found) == len(words)


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute_runs(words)
    best = max(found, key=lambda r: (r[1] - r[0], -r[0], -r[2]), default=None)
    gone = {i for b, e, q in found for i in range(b + q, e)}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (
        doc_id, len(found), *((None,) * 4 if best is None else (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2])),
        sha("".join(f"{b},{e - b},{q}\n" for b, e, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


SCHEMA = "doc_id long, text string, lang string, n_runs string, start int, words string"


def test_documents(spark):
    r = random.Random(8)
    texts = [None, "", " \t\x0b ", "one", "a " * 5, "a " * 6, "é é " * 30, "\x1c " * 9, "x y " * 3000, "z" * 300000, "a\x00b " * 8]
    texts += [r.choice((" ", "\n", "\t ")).join(str(r.randrange(r.choice((2, 3, 500)))) for _ in range(r.randint(1, 400))) for _ in range(150)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "b " * 40), (-7, "b c " * 40), (20, texts[20]), (20, texts[20])]
    docs = spark.createDataFrame([(*x, "en", "s", 1, "w") for x in rows], SCHEMA)
    got = [tuple(x)[:8] for x in pr.digest_documents(docs).collect()]
    key = lambda x: tuple("" if v is None else str(v) for v in x)
    assert sorted(got, key=key) == sorted((expected(*x) for x in rows), key=key)
    assert sum(x[1] > 0 for x in got) > 15
    assert pr.digest_documents(docs.limit(0)).collect() == []


def test_collapsed_texts(spark):
    docs = spark.createDataFrame([(1, "so so so so so so it is", "k"), (2, None, "k"), (2, None, "k"), (3, "", "k")], "doc_id long, text string, words string")
    rows = pr.collapse_documents(docs).orderBy("doc_id").collect()
    assert [tuple(x) for x in rows] == [(1, "so so so so so so it is", "k", "so it is"), (2, None, "k", None), (2, None, "k", None), (3, "", "k", "")]
    with pytest.raises(ValueError):
        pr.collapse_documents(docs, into="Words")


def test_periodic_tail():
    doc = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0)
    moved = pr.periodic_tail(97, doc)
    g = zlib.crc32(str(doc).encode()) // 10
    a, p = g % 97, 1 + (97 - g % 97) // (3 + g % 8)
    assert moved.tolist() == [i if i < a else a + (i - a) % p for i in range(97)]
    assert pr.periodic_tail(0, doc) is None and pr.periodic_tail(9, None) is None
    assert np.array_equal(pr.periodic_tail(1, doc), [0])
