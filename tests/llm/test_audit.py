"""The filter audit against a plain recount of every order."""

import itertools
import re

from brasswork.llm import filter_audit

DOCS = "doc_id long, text string, lang string, source string, mask int, part string, n long, good string, digest string"


def brute(rows, labels):
    good = {d for d, q, _ in labels if q == 1}
    toxic = {d for d, _, t in labels if t == 1}
    docs = []
    for doc, text, lang in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        failed = set()
        if len(words) < 200:
            failed.add("A")
        if 100 * len(set(words)) < 50 * len(words):
            failed.add("B")
        if 100 * len(re.findall("[A-Z]", text)) > 3 * len(text):
            failed.add("C")
        if re.search("[#$%&*|]", text):
            failed.add("D")
        if doc is not None and any((t or "") == text and d is not None and d < doc for d, t, _ in rows):
            failed.add("E")
        docs.append((doc, lang or "", failed))
    out = {}
    for part in {p for _, p, _ in docs}:
        mine = [(d, f) for d, p, f in docs if p == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in map("".join, itertools.permutations("ABCDE")):
            left = mine
            for step, name in enumerate(order, 1):
                removed = [d for d, f in left if name in f]
                left = [(d, f) for d, f in left if name not in f]
                failing = sum(name in f for _, f in mine)
                shapley[name] += len(removed)
                out[part, order, step] = [
                    len(left), len(removed), failing - len(removed), sum(f == {name} for _, f in mine),
                    sum(d in good for d in removed), sum(d in toxic for d in removed), name,
                ]
        for (p, _, _), row in out.items():
            if p == part:
                row[6] = shapley[row[6]]
    return out


def test_audit_equals_a_recount(spark):
    long = " ".join(f"w{i}" for i in range(220))
    texts = [None, "", "short", long, long + " #", long.upper(), "same " * 300, "SAME " * 300 + "$", long, long, "short", "Ünï " + long, "\x0b\x1c" + long, "x" * 300000]
    rows = [(i, t, ("en", None, "", "de")[i % 4]) for i, t in enumerate(texts)]
    rows += [(None, long, "en"), (None, long, "en"), (3, long, "en"), (3, long, "de"), (40, long, "de"), (40, long, "de"), (-5, "short", "de")]
    labels = [(3, 1, 0), (3, 0, 1), (8, 1, 1), (9, None, 1), (40, 1, None), (0, 0, 1), (None, 1, 1)]
    docs = spark.createDataFrame([(*r, "s", 0, "p", 1, "g", "d") for r in rows], DOCS)
    found = filter_audit.audit(docs, spark.createDataFrame([(*x, "x") for x in labels], "doc_id long, quality int, toxic int, part string")).collect()
    got = {tuple(r)[:3]: list(r)[3:] for r in found}
    assert len(found) == len(got)
    assert got == brute(rows, labels)


def test_a_text_of_most_rows(spark):
    docs = spark.range(30000).selectExpr("id as doc_id", "if(id % 3 = 0, 'the same text', concat('text ', id)) as text", "'en' as lang")
    rows = filter_audit.cells(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    assert {(r["mask"], r["n"]) for r in rows} == {(1, 20001), (17, 9999)}


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(docs, labels).collect() == []
