"""Joins, repeats, personal data, vectors and the pipeline, against brute force."""

import collections
import hashlib
import itertools
import math
import random
import re
import time
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import regex
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from brasswork.llm import near_duplicates, packing, pii, queries, repeats, suffix_sort, vector_index
from brasswork.llm.common import Scratch, clear_scratch
from brasswork.llm.components import connected_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, row string"


def corpus(seed: int, n: int = 60) -> list:
    r = random.Random(seed)
    names = ["".join(r.choice("abcdeéß") for _ in range(r.randint(1, 7))) for _ in range(300)]
    text = lambda k: " ".join(r.choice(names) for _ in range(k))
    shared = [text(90) for _ in range(3)]
    out = [None, "", "?", "one", "two words"] + [text(r.randint(5, 150)) for _ in range(n)]
    out += [text(r.randint(0, 40)) + " " + r.choice(shared) + " " + text(r.randint(0, 40)) for _ in range(n // 2)]
    base = text(120).split()
    for k in range(12):
        changed = list(base)
        changed[r.randrange(len(changed))] = f"new{k}"
        out.append(" ".join(changed))
    return out + out[6:12] + ["xy" * 600, "xyz" * 400]


def frame(spark, texts):
    rows = [(i, t, "en", "s", None if t is None else len(t), "k", "r") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(300 + i, 301 + i) for i in range(20)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    found = connected_components(Scratch(spark), spark.createDataFrame(edges, "a long, b long"), "t")
    wanted = {x: root(x) for e in edges if e[0] != e[1] for x in e}
    assert {r_["node"]: r_["label"] for r_ in found.collect()} == wanted


def test_scratch_tables_go(spark):
    own = len(Scratch.made)
    scratch = Scratch(spark)
    kept = scratch.keep(spark.range(3), "a")
    scratch.keep(spark.range(2), "b")
    scratch.drop("b")
    with pytest.raises(Exception):
        spark.read.parquet(f"{scratch.base}/b").count()
    assert kept.count() == scratch.read("a", kept.schema).count() == 3
    clear_scratch(own)
    assert len(Scratch.made) == own
    with pytest.raises(Exception):
        spark.read.parquet(f"{scratch.base}/a").count()


def brute_classes(texts, threshold=0.8):
    sets = [set(near_duplicates.shingles(t or "").tolist()) for t in texts]
    label, links = list(range(len(texts))), collections.Counter()
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= threshold * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                links[i] += 1
                links[j] += 1
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return {i: (label[i], links[i]) for i in range(len(texts))}


@pytest.mark.parametrize("block, codes", [(near_duplicates.BLOCK, near_duplicates.BLOCK_CODES), (4, near_duplicates.BLOCK_CODES), (1024, 300)])
def test_jaccard_join(spark, monkeypatch, block, codes):
    monkeypatch.setattr(near_duplicates, "BLOCK", block)
    monkeypatch.setattr(near_duplicates, "BLOCK_CODES", codes)
    texts = corpus(1)
    found = near_duplicates.jaccard_classes(spark, frame(spark, texts)).collect()
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in found} == brute_classes(texts)


def test_jaccard_join_odd_rows(spark):
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, None), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = near_duplicates.jaccard_classes(spark, docs).collect()
    assert sorted(r["n_links"] for r in found) == [0, 0, 2, 2, 2]
    assert near_duplicates.keep_one(spark, docs).count() == 2
    assert near_duplicates.jaccard_classes(spark, docs.limit(0)).count() == 0
    clashing = docs.selectExpr("*", "1 as row_key", "2 as kept_key", "3 as rep", "4 as row", "5 as intervals", "6 as spans_key")
    kept = near_duplicates.keep_one(spark, clashing)
    assert kept.columns == clashing.columns and {tuple(r)[2:] for r in kept.collect()} == {(1, 2, 3, 4, 5, 6)}
    for frame_ in (repeats.remove_repeats(spark, clashing), pii.sanitise(spark, clashing)):
        assert frame_.columns == clashing.columns and frame_.count() == 5 and {tuple(r)[2:] for r in frame_.collect()} == {(1, 2, 3, 4, 5, 6)}
    with pytest.raises(ValueError):
        near_duplicates.jaccard_classes(spark, docs, 0.5)


def test_pruning_keeps_pairs_over_the_threshold():
    r = np.random.default_rng(5)
    base = np.unique(r.integers(0, 2**63, 400).astype(np.uint64))
    near = [np.sort(np.concatenate([base[k:], r.integers(0, 2**63, k).astype(np.uint64)])) for k in range(0, 120, 10)]
    hashes = lambda sets: np.array([near_duplicates.min_hashes(s, 0, 128) for s in sets])
    found = near_duplicates.linked([base], near, hashes([base]), hashes(near), 0.8, 1e-6)[0]
    truth = [len(np.intersect1d(base, s)) >= 0.8 * len(np.union1d(base, s)) for s in near]
    assert found.tolist() == truth
    assert near_duplicates.least_matches(0.8, 1e-6, 4) == sorted(near_duplicates.least_matches(0.8, 1e-6, 4))


def test_suffix_sort():
    r = random.Random(3)
    for _ in range(120):
        base = bytes(r.choice(b"ab") for _ in range(r.randint(40, 200)))
        texts = [bytes(r.choice(b"ab") for _ in range(r.randint(1, 40))) + base[r.randint(0, 20) :] for _ in range(4)]
        depth = r.choice([10, 50, 120])
        suffixes = [(i, p) for i, t in enumerate(texts) for p in range(len(t))]
        wanted = collections.defaultdict(list)
        for i, p in suffixes:
            wanted[texts[i][p : p + depth]].append((i, p))
        found = suffix_sort.sorted_classes(texts, suffixes, depth)
        assert [sorted(c) for c in found] == [sorted(wanted[k]) for k in sorted(wanted)]


def brute_kept(texts, length):
    data = [(t or "").encode() for t in texts]
    counts = collections.Counter(d[p : p + length] for d in data for p in range(len(d) - length + 1))
    kept = []
    for d in data:
        gone = bytearray(len(d))
        for p in range(len(d) - length + 1):
            if counts[d[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        kept.append(bytes(x for x, g in zip(d, gone, strict=True) if not g))
    return kept


@pytest.mark.parametrize("length, part_bins", [(60, 1024), (100, 3), (400, 1024)])
def test_repeats(spark, monkeypatch, length, part_bins):
    monkeypatch.setattr(repeats, "PART_BINS", part_bins)
    texts = corpus(4)
    found = {r["doc_id"]: r for r in repeats.digest_documents(spark, frame(spark, texts), length).collect()}
    for i, kept in enumerate(brute_kept(texts, length)):
        assert found[i]["kept_sha256"] == hashlib.sha256(kept).hexdigest()
        assert found[i]["n_bytes"] - found[i]["n_removed"] == len(kept)


@pytest.mark.parametrize("length, passage, part_bins", [(100, 60, 3), (400, 240, 1024)])
def test_repeats_of_two_lengths(spark, monkeypatch, length, passage, part_bins):
    """A planted passage of 51 words has less than 400 bytes: the columns of the greater length leave it, those of the other don't."""
    monkeypatch.setattr(repeats, "PART_BINS", part_bins)
    r = random.Random(8)
    words = ["".join(r.choice("abcdeé") for _ in range(r.randint(3, 5))) for _ in range(2000)]
    planted = " ".join(r.choice(words) for _ in range(51))
    assert 240 <= len(planted.encode()) < 400
    around = lambda: " ".join(r.choice(words) for _ in range(60))
    texts = corpus(9) + [f"{around()} {planted} {around()}" for _ in range(3)]
    texts += [texts[40], f"{around()} {texts[40]}", f"{planted} {texts[40]} {planted}"]
    rows = repeats.digest_documents(spark, frame(spark, texts), length, passage).collect()
    found = {x["doc_id"]: x for x in rows}
    assert len(rows) == len(texts) and any(x["n_removed"] for x in rows)
    for i, (kept, less) in enumerate(zip(brute_kept(texts, length), brute_kept(texts, passage), strict=True)):
        assert found[i]["kept_sha256"] == hashlib.sha256(kept).hexdigest()
        assert found[i]["n_removed"] == found[i]["n_bytes"] - len(kept)
        assert found[i]["passage_removed"] == found[i]["n_bytes"] - len(less)
        assert found[i]["passage_text"] == less.decode("utf-8", "ignore")
    if length == 400:
        alone = [found[i] for i, t in enumerate(texts) if t and planted in t and not t.startswith(planted)]
        assert len(alone) == 3 and all(x["n_removed"] == 0 and x["text"].count(planted) == 1 for x in alone)
        assert not any(planted in x["passage_text"] for x in rows)
    with pytest.raises(ValueError):
        repeats.digest_documents(spark, frame(spark, texts), 100, 100)


def test_query_tells_short_passages(spark, tmp_path):
    r = random.Random(2)
    text = lambda k: " ".join("".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(k))
    planted = text(55)
    frame(spark, [f"{text(40)} {planted} {text(30)}", f"{text(20)} {planted}", text(200), None]).write.parquet(f"{tmp_path}/documents.parquet")
    found = sorted(queries.op8_suffix_dedup(spark, str(tmp_path)).collect())
    assert [(x["n_removed"], x["passage_spans"], planted in x["text"], planted in x["passage_text"]) for x in found] == [(0, 1, True, False)] * 2 + [(0, 0, False, False)] * 2


def test_repeats_odd_rows(spark):
    docs = spark.createDataFrame([(1, "é" * 300), (1, "é" * 300), (None, "z" * 399), (2, None)], "doc_id long, text string")
    found = sorted((r["doc_id"] or 0, r["n_removed"]) for r in repeats.digest_documents(spark, docs).collect())
    assert found == [(0, 0), (1, 600), (1, 600), (2, 0)]
    assert repeats.digest_documents(spark, docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        repeats.repeated_intervals(spark, docs, 30)
    cleaned = repeats.remove_repeats(spark, frame(spark, ["a" * 900, "short", None]))
    assert cleaned.columns == [c.split()[0] for c in SCHEMA.split(", ")] and {r["text"] for r in cleaned.collect()} == {"", "short", None}


PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def passes(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        doubled = [(2 * int(d) - 9 if int(d) > 4 else 2 * int(d)) if i % 2 else int(d) for i, d in enumerate(reversed(digits))]
        return 12 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def brute_spans(text):
    found = [(m.start(), n, m.end(), k) for n, (k, p) in enumerate(PLAIN.items()) for m in re.finditer(p, text or "", re.A) if passes(k, m[0])]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))


def test_base_spans(spark):
    r = random.Random(5)
    texts = [None, "", "4111 1111 1111 1111 a.b@c.d.e_f@g.h 1.2.3.4.5.6.7.8 300.1.1.1 +1 (415) 555-2671", "1 " * 20000, "a@b" + ".c" * 20000, "9" * 30000]
    texts += ["".join(r.choice("aB1.@-_+ %0927()\x01\x04é🙂\n") for _ in range(r.randint(1, 60))) for _ in range(1500)]
    texts += ["".join(r.choice("0123456789 -.+4") for _ in range(r.randint(10, 60))) for _ in range(1000)]
    for row in pii.digest_documents(spark, frame(spark, texts)).collect():
        assert row["base_sha256"] == hashlib.sha256(brute_spans(texts[row["doc_id"]]).encode()).hexdigest()


def brute_terms(texts, remove=0.9, generalise=0.75, least=2, smooth=0.5):
    """All spans of each text, and the disclosing terms with whether they go: counts and mutual information by plain loops."""
    texts = [t or "" for t in texts]
    base = [[(m.start(), n, m.end(), m[0].lower()) for n, (k, p) in enumerate(PLAIN.items()) for m in re.finditer(p, t, re.A) if passes(k, m[0])] for t in texts]
    wide = lambda k, v: "@" + v.split("@")[-1] if k == 0 else ".".join(v.split(".")[:2]) if k == 1 else re.sub("[^0-9]", "", v)[:4]
    entities = [{(k, level, f(k, v)) for _, k, _, v in found for level, f in enumerate((lambda k, v: v, wide))} for found in base]
    word = regex.compile(r"\p{L}+|\p{N}+")
    terms = [{w.lower() for w in word.findall(t)} for t in texts]
    n, told = len(texts), {}
    rows_of, rows_with = collections.defaultdict(set), collections.defaultdict(set)
    for i in range(n):
        for e in entities[i]:
            rows_of[e].add(i)
        for w in terms[i]:
            rows_with[w].add(i)
    for rows in rows_of.values():
        for w in set().union(*(terms[i] for i in rows)):
            both = rows & rows_with[w]
            if len({texts[i] for i in both}) >= least:
                mean = len(rows) / n
                value = math.log((len(both) + smooth * mean) / (len(rows_with[w]) + smooth) / mean) / math.log((n + 1) / len(rows))
                if value >= generalise:
                    told[w] = max(value, told.get(w, 0.0))
    spans = []
    for t, found in zip(texts, base, strict=True):
        inside = lambda m: any(a < m.end() and m.start() < b for a, _, b, _ in found)  # noqa: E731, B023
        own = [(m.start(), 4, m.end()) for m in word.finditer(t) if m[0].lower() in told and not inside(m)]
        spans.append(",".join(f"{[*PLAIN, 'term'][k]}:{a}:{b}" for a, k, b in sorted([x[:3] for x in found] + own)))
    return spans, {w: v >= remove for w, v in told.items()}


def brute_sanitised(texts):
    spans, told = brute_terms(texts)
    out = []
    for text, written in zip(texts, spans, strict=True):
        parts, at = [], 0
        for kind, a, b in sorted(((k, int(x), int(y)) for k, x, y in (s.split(":") for s in written.split(",") if s)), key=lambda s: s[1:]):
            if a >= at:  # a span that overlaps the one before goes with it
                put = f"[{kind.upper()}]" if kind != "term" else "" if told[text[a:b].lower()] else "[TERM]"
                parts += [text[at:a], put]
            at = max(at, b)
        out.append(text if text is None else "".join(parts) + text[at:])
    return out


@pytest.mark.parametrize("few", [100_000, 0])
def test_terms_equal_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(pii, "FEW", few)
    r = random.Random(11)
    names = ["".join(r.choice("abcdeéß") for _ in range(r.randint(1, 5))) for _ in range(700)]
    texts = [None, "", "Xy " * 500]
    for i in range(260):
        host = i % 9
        value = r.choice([f"{r.choice(names[:30])}@host{host}.example", f"10.{host}.1.{r.randrange(200)}", f"+49 30 555 {r.randrange(1000, 9999)}"]) if i % 4 == 0 else ""
        hint = f" Hint{host}" if value and r.random() < 0.8 else f" HINT{r.randrange(9)}" if r.random() < 0.03 else ""
        texts.append(" ".join(r.choice(names) for _ in range(r.randint(3, 30))) + hint + " " + value + " " + " ".join(r.choice(names) for _ in range(5)))
    texts += texts[3:12] + [texts[3] + " more", texts[3] + " other"]
    wanted, told = brute_terms(texts)
    found = {x["doc_id"]: x["spans"] for x in pii.digest_documents(spark, frame(spark, texts)).collect()}
    assert [found[i] for i in range(len(texts))] == wanted
    assert set(told.values()) == {True, False} and "term" in "".join(wanted)
    clean = {x["doc_id"]: x["text"] for x in pii.sanitise(spark, frame(spark, texts)).collect()}
    assert [clean[i] for i in range(len(texts))] == brute_sanitised(texts)


def test_terms_that_reveal_are_removed(spark):
    texts = [f"filler{i % 7} words here. Ask Quentinius{'' if i < 5 else 'x'} at q@who.example today number {i}" if i < 5 else f"plain filler{i % 7} words here today number {i}" for i in range(60)]
    docs = frame(spark, texts)
    spans = {r["doc_id"]: r["spans"] for r in pii.digest_documents(spark, docs).collect()}
    at = texts[0].index("Quentinius")
    assert f"term:{at}:{at + 10}" in spans[0] and "term" not in spans[30]
    clean = {r["doc_id"]: r for r in pii.sanitise(spark, docs).collect()}
    assert "Quentinius" not in clean[0]["text"] and "[EMAIL]" in clean[0]["text"] and clean[30]["text"] == texts[30]
    assert clean[0]["n_chars"] == len(clean[0]["text"])
    assert pii.digest_documents(spark, docs.limit(0)).count() == 0 and pii.sanitise(spark, docs.limit(0)).columns == docs.columns


def test_terms_that_reveal_go_wherever_they_stand(spark):
    gap = "plain words stand here for a while " * 6
    texts = [f"Quentinius and Xy 77301 came. {gap} write to q@who.example number {i}" for i in range(5)] + ["it was xy or QUENTINIUS with 77301", "nothing"]
    texts += [f"{gap} number {i}" for i in range(60)] + [texts[0]]
    docs = frame(spark, texts)
    spans = {r["doc_id"]: r["spans"] for r in pii.digest_documents(spark, docs).collect()}
    for i in (0, 4, 5, len(texts) - 1):
        for word in ("quentinius", "xy", "77301"):
            at = texts[i].lower().index(word)
            assert f"term:{at}:{at + len(word)}" in spans[i].split(",")
    assert spans[6] == spans[20] == "" and "term" not in spans[0].split("email")[1]
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(spark, docs).collect()}
    assert "[EMAIL]" in clean[0] and clean[20] == texts[20] and not re.search("quentinius|xy|77301", " ".join(clean.values()), re.I)


def test_codes_of_words_go_before_texts_are_shuffled(spark, monkeypatch):
    """Codes of all words are most of what is written; they are gone when the texts meet their terms, and so is what told these."""
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(8))
    texts = [" ".join(word() for _ in range(200)) + (f" Quentinius at q@who.example {i}" if i % 50 == 0 else "") for i in range(500)]
    written, left, keep = {}, {}, Scratch.keep

    def kept(self, frame_, name):
        out = keep(self, frame_, name)
        files = [p for p in Path(self.base).rglob("*.parquet")]
        written[name] = sum(p.stat().st_size for p in files)
        left[name] = {p.parent.name for p in files}
        return out

    monkeypatch.setattr(Scratch, "keep", kept)
    rows = pii.digest_documents(spark, frame(spark, texts)).collect()
    assert sum("term" in x["spans"] for x in rows) == 10
    assert max(written.values()) > 500 * 200 * 8 and written["terms"] < max(written.values()) / 4
    assert "hits" not in {p.parent.name for p in Path(Scratch.made[-1].base).rglob("*.parquet")} and left["terms"] == {"hits", "mentions", "terms"}


def test_pii_odd_rows(spark):
    docs = spark.createDataFrame([(None, "mail a@b.cd"), (1, "mail a@b.cd"), (1, "mail a@b.cd"), (2, None)], "doc_id long, text string")
    assert sorted(r["n_email"] for r in pii.digest_documents(spark, docs).collect()) == [0, 1, 1, 1]
    assert sorted(r["text"] or "" for r in pii.sanitise(spark, docs).collect()) == ["", *["mail [EMAIL]"] * 3]


@pytest.mark.parametrize("rows_per_part", [16384, 40])
def test_vectors(spark, rows_per_part):
    r = np.random.default_rng(6)
    x = r.normal(size=(300, 8)).astype(np.float32)
    x[10:40] = x[9]
    rows = [(i, [float(v) for v in x[i]]) for i in range(300)] + [(400, None), (450, [1.0, None, *[0.0] * 6]), (500, [float("nan")] * 8), (None, [0.0] * 8)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = vector_index.top_k(spark, docs, F.col("vec_id") % 50 == 0, pivots=6, rows_per_part=rows_per_part)
    q = np.floor(256 * x.astype(np.float64)).astype(np.int64)
    wanted = set()
    for i in range(0, 300, 50):
        score = q @ q[i]
        order = [j for j in np.lexsort((np.arange(300), -score)) if j != i][:5]
        wanted |= {(i, k + 1, j, int(score[j])) for k, j in enumerate(order)}
    assert {tuple(row) for row in found.collect()} == wanted
    assert vector_index.top_k(spark, docs.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_vectors_of_different_lengths_and_repeated_ids(spark):
    rows = [(0, [1.0, 2.0], "x"), (50, [], "x"), (1, [3.0], "x"), (2, [1.0, 1.0, 5.0], "x"), (2, [0.5], "x"), (0, [2.0], "x"), (0, [2.0], "x")]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>, part string")
    found = {tuple(r) for r in vector_index.top_k(spark, docs, F.col("vec_id") % 50 == 0, pivots=2, rows_per_part=2).collect()}
    one = 256 * 256
    zero = [(50, 1, 0, 0), (50, 2, 0, 0), (50, 3, 0, 0), (50, 4, 1, 0), (50, 5, 2, 0)]
    assert found == {(0, 1, 1, 3 * one), (0, 2, 2, 3 * one), (0, 3, 2, one // 2), (0, 4, 50, 0), *zero}


def test_clustered_vectors_are_pruned_before_the_shuffle(spark, monkeypatch):
    r = np.random.default_rng(8)
    x = np.concatenate([r.normal(size=(60, 6)) * 0.05 + centre for centre in 9 * np.eye(6)])
    docs = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<float>")
    kept = {}
    keep = Scratch.keep
    monkeypatch.setattr(Scratch, "keep", lambda self, frame, name: kept.setdefault(name, keep(self, frame, name)))
    found = vector_index.top_k(spark, docs, F.col("vec_id") % 10 == 0, pivots=6, rows_per_part=30)
    q = np.floor(256 * x.astype(np.float32).astype(np.float64)).astype(np.int64)
    wanted = {(i, int((q[i] @ q.T)[[j for j in range(len(q)) if j != i]].max())) for i in range(0, len(q), 10)}
    assert {(row["query_id"], row["score"]) for row in found.where("rank = 1").collect()} == wanted
    parts = kept["index"].select("part").distinct().count()
    assert kept["pairs"].count() < 0.7 * parts * (parts - 1)


def test_pipeline_stages_agree_with_brute_force(spark, tmp_path):
    texts = [t for t in corpus(7, 40)] + ["12345 ?!", "write to me@home.example now please my friend"]
    frame(spark, texts).drop("key", "row").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, str(tmp_path)).persist()
        assert after.columns == docs.columns
        ids = {r["doc_id"]: r["text"] for r in after.collect()}
        old = {r["doc_id"]: r["text"] for r in before.collect()}
        if name == "language_id":
            assert set(ids) == {i for i, t in old.items() if t and re.search(r"[^\W\d_]", t)}
        if name == "jaccard_join":
            order = sorted(old)
            classes = brute_classes([old[i] for i in order])
            assert set(ids) == {order[k] for k, (c, _) in classes.items() if c == k}
        if name == "suffix_dedup":
            order = sorted(old)
            assert corpus_pipeline.PASSAGE <= 250
            assert [ids[i] for i in order] == [k.decode("utf-8", "ignore") for k in brute_kept([old[i] for i in order], corpus_pipeline.PASSAGE)]
        if name == "pii":
            order = sorted(old)
            assert [ids[i] for i in order] == brute_sanitised([old[i] for i in order]) and any("[EMAIL]" in t for t in ids.values())
        before = after
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    sequences = collections.defaultdict(list)
    for doc_id, text in ids.items():
        wanted = [*tokenizer.encode(text, add_special_tokens=False).ids, 2]
        own = sorted((r for r in pieces if r["doc_id"] == doc_id), key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own))) and sum(r["length"] for r in own) == len(wanted)
        for r in own:
            part = np.array(wanted[r["start"] : r["start"] + r["length"]], "<u4")
            assert len(part) == r["length"] and zlib.crc32(part.tobytes()) == r["ids_crc32"]
            sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert {r["doc_id"] for r in pieces} == set(ids)
    for placed in sequences.values():
        placed.sort()
        assert [a for a, _ in placed] == [0, *itertools.accumulate(n for _, n in placed)][:-1] and sum(n for _, n in placed) <= 1024
    assert len(sequences) <= packing.lower_bound(np.array([r["length"] for r in pieces]), 1024) + 1


def test_every_operator_has_one_query():
    names = sorted(queries.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert set(queries.oracle_sql()) <= set(names)


def test_spans_of_a_text_of_many_addresses(spark):
    """Offsets are added up in time that doesn't grow with the square of the matches."""
    n = 40000
    text = "\n".join(f"user{i}@host{i % 977}.example.org 10.{i % 250}.{i % 7}.{i % 251} é" for i in range(n))
    docs = spark.createDataFrame([(1, text), (2, text), (3, "a@b.c")], "doc_id long, text string").repartition(3)
    began = time.monotonic()
    rows = {r["doc_id"]: r["mentions"] for r in pii.base_mentions(docs.where("doc_id <> 2")).select("doc_id", "mentions").collect()}
    assert time.monotonic() - began < 30  # 85 s for as many addresses where each match copied all before it
    found = rows[1]
    assert len(found) == 2 * n
    assert all(text[m["start"] : m["end"]] == m["value"] for m in found[::97])
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(spark, docs.where("doc_id <> 2")).select("doc_id", "text").collect()}
    assert clean[1].count("[EMAIL]") == clean[1].count("[IP]") == n and "@" not in clean[1] and clean[3] == "[EMAIL]"
    assert clean[1] == "\n".join(["[EMAIL] [IP] é"] * n)


def test_running_numbers(spark):
    r = random.Random(1)
    lists = [[], [5], *([r.randint(0, 99) for _ in range(k)] for k in (127, 128, 129, 700))]
    frame_ = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, x array<int>")
    rows = frame_.select("i", pii._before(F.col("x"), lambda a, b: a + b).alias("s"), pii._before(F.col("x"), lambda a, b: F.greatest(a, b)).alias("m")).collect()
    for row in rows:
        x = lists[row["i"]]
        assert row["s"] == [sum(x[:k]) for k in range(len(x) + 1)] and row["m"] == [max(x[:k], default=0) for k in range(len(x) + 1)]


def test_parts_of_chunked_texts(spark):
    r = random.Random(2)
    text = "".join(r.choice("aé\U0001f600\n ") for _ in range(5000))
    cuts = [(0, 0), (0, 5000), (1023, 1025), (1024, 2048), (5000, 5000), *((a, r.randint(a, 5000)) for a in (r.randrange(5000) for _ in range(60)))]
    rows = spark.createDataFrame([(text, a, b) for a, b in cuts], "text string, a int, b int")
    chunks = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{pii.TEXT_CHUNK}}}"), F.lit(0))
    assert all(x["p"] == text[x["a"] : x["b"]] for x in rows.select("a", "b", pii._part(chunks, F.col("a"), F.col("b")).alias("p")).collect())


def test_a_hundred_thousand_equal_rows(spark):
    """Repeated rows are one before sets or bins are made of them."""
    text = " ".join(f"word{i * i % 911}" for i in range(120))
    other = text.replace("word4 ", "wordx ")
    docs = spark.range(100000).select(F.lit(7).cast("long").alias("doc_id"), F.lit(text).alias("text"))
    docs = docs.union(spark.createDataFrame([(8, other), (9, "nothing like it")], docs.schema))
    rows = near_duplicates.jaccard_classes(spark, docs).groupBy("doc_id", "class_id", "n_links").count().collect()
    assert sorted(tuple(x) for x in rows) == [(7, 7, 100000, 100000), (8, 7, 100000, 1), (9, 9, 0, 1)]
    found = repeats.digest_documents(spark, docs).groupBy("doc_id", "n_bytes", "n_removed", "n_spans").count().collect()
    whole = len(text.encode())
    same = {x["doc_id"]: x for x in found}
    assert len(found) == 3 and same[7]["count"] == 100000 and same[7]["n_removed"] == whole and same[9]["n_removed"] == 0
