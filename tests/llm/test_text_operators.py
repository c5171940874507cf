"""Codec, media, classifiers and packing: brute force, exact round trips, held-out accuracy, odd inputs."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from brasswork.llm import byte_bpe, language_id, linear, ogg, packing, quality, toxicity
from brasswork.llm.token_ids import encoder

MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PLAIN = public_tokenizers.path("byte_bpe_50k.tiktoken")
ODD = "abc é ß\n\t 　\xa0\x85x'sll 12²Ⅷ中文,.!?\r🙂"
TEXTS = [None, "", " ", "a", "word " * 3000, "x" * 20000, "one\n\ntwo  three", "ab'll don't  \n ", "12345", "¿qué? " * 50]


@pytest.fixture(scope="module")
def odd_documents(spark):
    """Null and repeated ids, null texts, repeated rows, and columns whose names clash with results."""
    rows = [(i, t, None, None, 7, "s", "k") for i, t in enumerate(TEXTS)] + [(None, "lost id", None, None, 7, "s", "k"), (3, "a", "en", None, 7, "s", "k"), (3, "a", "en", None, 7, "s", "k")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string, key string")


def test_bpe_equals_tiktoken():
    own = byte_bpe.codec(MULTI, public_tokenizers.PATTERN)
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(MULTI), special_tokens={})
    random.seed(1)
    texts = ["".join(random.choice(ODD) for _ in range(random.randint(0, 40))) for _ in range(3000)] + [t for t in TEXTS if t]
    for text in texts:
        ids = own.encode(text)
        assert ids == other.encode_ordinary(text)
        assert own.decode(ids) == text.encode()


def test_pairs_fit_by_definition():
    pieces = byte_bpe.codec(MULTI, public_tokenizers.PATTERN).pieces
    random.seed(2)
    short = [r for t, r in pieces.ranks.items() if len(t) <= 4]
    for _ in range(4000):
        a, b = random.choice(short), random.choice(short)
        assert pieces.compatible(a, b) == (byte_bpe.merge_by_rank(pieces.tokens[a] + pieces.tokens[b], pieces.ranks) == [a, b])


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_packed_ids_equal_tokenizers(text):
    assert encoder(PLAIN, public_tokenizers.PATTERN).encode(text) == np.array(_reference().encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def _reference(cache=[]):  # noqa: B006
    if not cache:
        cache.append(Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")))
        cache[0].encode_special_tokens = True
    return cache[0]


def test_packed_ids_with_added_tokens(spark):
    end, r = "<|endoftext|>", random.Random(8)
    texts = [f"end {end} next", end, end * 3, f"{end}\n\n a  {end}b", f"<|{end}|>", f"don{end}'t", end[:-1], f"{end[:-1]}{end}"]
    texts += ["".join(r.choice([end, "end", "<|", "|>", " ", "\n", "é", "word"]) for _ in range(12)) for _ in range(300)]
    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    wanted = [np.array(reference.encode(t, add_special_tokens=False).ids, "<u4") for t in texts]
    assert wanted[0].tolist() == [437, 220, 50256, 1306]
    for text, ids in zip(texts, wanted, strict=True):
        assert encoder(PLAIN, public_tokenizers.PATTERN).encode(text) == ids.tobytes()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for p in packing.pack_documents(spark, docs, PLAIN, public_tokenizers.PATTERN).collect():
        ids = np.array([*wanted[p["doc_id"]], 2], "<u4")
        assert (p["piece"], p["length"], p["ids_crc32"]) == (0, len(ids), zlib.crc32(ids.tobytes()))


def test_bpe_query_on_odd_rows(odd_documents):
    rows = byte_bpe.digest_documents(odd_documents, MULTI, public_tokenizers.PATTERN).collect()
    assert len(rows) == odd_documents.count()
    for r in rows:
        if r["doc_id"] is not None and r["doc_id"] < len(TEXTS):
            assert r["decoded_sha256"] == hashlib.sha256((TEXTS[r["doc_id"]] or "").encode()).hexdigest()
    assert byte_bpe.digest_documents(odd_documents.limit(0), MULTI, public_tokenizers.PATTERN).count() == 0
    assert byte_bpe.encode_documents(odd_documents, MULTI, public_tokenizers.PATTERN).where("doc_id = 0").first()["ids"] == []


def slow_checksum(data: bytes) -> int:
    value = 0
    for byte in data:
        value ^= byte << 24
        for _ in range(8):
            value = (value << 1 ^ 0x04C11DB7 if value & 0x80000000 else value << 1) & 0xFFFFFFFF
    return value


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=400))
def test_checksum_and_round_trip(data):
    assert ogg.page_checksum(data) == slow_checksum(data)
    assert ogg.read_samples(ogg.write_samples(ogg.pad(data))).payload == ogg.pad(data)


@pytest.mark.parametrize("size", [0, 63, 64, 4095, 4096, 65025, 65026, 200_000])
def test_media_sizes(size):
    data = random.Random(size).randbytes(size)
    found = ogg.read_samples(ogg.write_samples(ogg.pad(data)))
    assert found.payload[:size] == data and len(found.payload) % 64 == 0 and len(found.payload) >= 64
    assert found.times[-1] == pytest.approx(len(found.payload) / ogg.RATE)


def test_damaged_media():
    media = bytearray(ogg.write_samples(bytes(100_000)))
    media[50_000] ^= 1
    streams, damaged = ogg.read_streams(bytes(media))
    assert damaged == 1 and sum(s.lost_pages for s in streams.values()) == 1
    with pytest.raises(ValueError):
        ogg.read_samples(bytes(media))
    with pytest.raises(ValueError):
        ogg.read_samples(b"")


def test_packets_over_pages():
    writer = ogg.StreamWriter(9)
    data = [bytes([i]) * n for i, n in enumerate((0, 255, 510, 70_000, 1))]
    pages = b"".join(writer.packet(d, i) for i, d in enumerate(data)) + writer.flush(last=True)
    streams, damaged = ogg.read_streams(pages)
    assert not damaged and [p.data for p in streams[9].packets] == data and streams[9].ended


def test_media_features():
    quiet, loud = bytes([128]) * 40_000, bytes([28, 228]) * 20_000
    found = dict(x.split("=") for x in ogg.feature_of(ogg.read_samples(ogg.write_samples(quiet + loud))).split(";"))
    levels = [float(x) for x in found["levels"].split("/")]
    assert levels[0] < 1 and levels[3] == 100 and levels == sorted(levels)
    assert (found["low"], found["high"]) == ("28", "228") and abs(float(found["level"]) - 100 / 2**0.5) < 0.01 and 39_999 <= int(found["turns"]) <= 40_001
    assert int(found["streams"]) == 2 and float(found["seconds"]) > 0


def test_media_query(odd_documents):
    rows = ogg.digest_documents(odd_documents).collect()
    assert len(rows) == odd_documents.count()
    empty = [r for r in rows if r["doc_id"] in (0, 1)]
    assert {r["payload_bytes"] for r in empty} == {64} and len({r["media_sha256"] for r in empty}) == 1
    assert {r["tail_crc32"] for r in empty} == {zlib.crc32(bytes(64))}
    assert ogg.media_documents(odd_documents).where("doc_id = 3").distinct().count() == 1


def words(random_, mark, n):
    return " ".join(random_.choice(mark) for _ in range(n))


@pytest.fixture(scope="module")
def labelled(spark):
    """Made-up texts whose class shows in a few words."""
    r = random.Random(4)
    plain = ["mira", "tolen", "basket", "river", "stone", "walk", "green", "paper", "lamp", "cloud"]
    rows = []
    for i in range(400):
        bad = i % 4 == 0
        text = words(r, plain, 20) + ". You are a " + (r.choice(["vorkel", "vorkelish", "idiot"]) if bad else r.choice(plain)) + ". " + words(r, plain, 10)
        rows.append((text, int(bad)))
    return rows


def test_toxicity_learns_words(spark, labelled):
    model = toxicity.fit_sample(spark.createDataFrame(labelled[:300], "text string, label int"))
    right = sum((model.score(t) >= 0.5) == bool(y) for t, y in labelled[300:])
    assert right >= 0.95 * len(labelled[300:])
    assert model.score("") < 0.5 and model.clauses("") == []


def test_toxicity_is_fitted_to_clauses(spark, monkeypatch):
    seen, fit = [], toxicity.fit_logistic
    monkeypatch.setattr(toxicity, "fit_logistic", lambda x, y, **more: seen.append((x, y)) or fit(x, y, **more))
    r = random.Random(9)
    rows = [(" you idiot. ".join(words(r, [f"w{i}x{k}" for k in range(90)], 15) for _ in range(6)), 1) for i in range(40)]
    rows += [(" They said not idiot. ".join(words(r, [f"v{i}x{k}" for k in range(90)], 15) for _ in range(3)), 0) for i in range(40)]
    toxicity.fit_sample(spark.createDataFrame(rows + rows[:3], "text string, label int"))
    (x, y), = seen
    assert len(x) == 80 and x[y == 1, 2].min() > x[y == 0, 2].max() and np.ptp(x[y == 0, 2]) < 0.5
    assert x[y == 0, 0].max() < x[y == 1, 0].min()


def brute_score(model, text):
    """Every clause of a text, word by word, through the four transducers one after the other."""
    kinds = (toxicity.INSULT, toxicity.THREAT)
    chain = [
        toxicity.governed(toxicity.NOT, kinds, toxicity.DENIED, 3, 0.3), toxicity.governed(toxicity.SAYS, kinds, toxicity.QUOTED, 8, 0.5),
        toxicity.directed(toxicity.INSULT, 4, 1.5), toxicity.directed(toxicity.THREAT, 4, 2.0),
    ]
    weights = []
    for clause in re.split(r"[.!?;:\n]", text.lower()):
        states, total, last = [0] * 4, 0.0, 0.0
        for word in re.findall(r"\w+", clause.replace("'", "")):
            stems = [word[:n] for n in range(min(len(word), 6), 3, -1) if model.lexicon.get(word[:n], ("", 0, False))[2]]
            symbol, weight = model.lexicon[word][:2] if word in model.lexicon else model.lexicon[stems[0]][:2] if stems else (toxicity.WORD, 0.0)
            factors = 1.0
            for i, machine in enumerate(chain):
                states[i], symbol, factor = machine.step(states[i], symbol)
                factors *= factor
            if weight and symbol in (*kinds, toxicity.DENIED, toxicity.QUOTED):
                total += weight * factors
                last = weight * factors if symbol in kinds else last
            if symbol == toxicity.AIMED:
                total += last * factors
        if total:
            weights.append(total)
    x = [max(weights, default=0.0), np.log1p(sum(weights)), np.log1p(sum(min(w / 4, 1) for w in weights))]
    return 1 / (1 + np.exp(-(model.coefficients[:-1] @ x + model.coefficients[-1])))


def test_fitted_toxicity_follows_the_grammar(spark, labelled):
    model = toxicity.fit_sample(spark.createDataFrame(labelled[:300], "text string, label int"))
    assert (model.coefficients[:-1] >= 0).all() and model.coefficients[:-1].max() > 0
    strongest = max((w for w, (s, _, stem) in model.lexicon.items() if s == toxicity.INSULT and not stem), key=lambda w: model.lexicon[w][1])
    for word in ("idiot", strongest):
        targeted, plain, quoted, denied = map(model.score, (f"you are {word}", f"what {word}", f"it was claimed that what {word}", f"that is not {word}"))
        assert targeted > plain > denied and targeted > quoted > denied
        assert plain > model.score(f"they claimed {word}") * 0.999 and model.score("a walk in the park") < denied
    texts = [t for t, _ in labelled[300:]] + ["", "He said: you idiot! You are not an idiot; idiots", "\n".join(["kill you"] * 50)]
    for text in texts:
        assert np.isclose(model.score(text), brute_score(model, text), atol=1e-12)


def test_general_words_take_what_their_beginnings_weigh():
    texts = [({"idiots", "walk", f"x{i}"}, 1) for i in range(30)] + [({"walk", f"y{i}"}, 0) for i in range(300)]
    lexicon = toxicity.learn_lexicon(texts)
    assert lexicon["idiot"][:2] == lexicon["idio"][:2] and lexicon["idiot"][1] > 3 and not lexicon["idiot"][2]
    assert lexicon["moron"][1] == toxicity.PRIOR[toxicity.INSULT]


def test_learned_entries_are_read_as_their_neighbours():
    texts = [({"kill", "vorkel", f"x{i}"}, 1) for i in range(20)] + [({"idiot", "mudge", f"z{i}"}, 1) for i in range(20)] + [({"walk", f"y{i}"}, 0) for i in range(400)]
    lexicon = toxicity.learn_lexicon(texts)
    assert lexicon["vork"][0] == toxicity.THREAT and lexicon["mudg"][0] == toxicity.INSULT and lexicon["kill"][0] == toxicity.THREAT


def test_targets_before_and_behind():
    model = toxicity.Model({"kill": (toxicity.THREAT, 1.5, False), "idiot": (toxicity.INSULT, 2.0, False), "you": (toxicity.TARGET, 0.0, False), "not": (toxicity.NOT, 0.0, False)}, np.zeros(4))
    told = {c: model.clause_weight(c) for c in ("kill", "you kill", "i will kill you", "i will not kill you", "kill a b c d e you", "idiot you", "you idiot", "kill not idiot you")}
    assert told == pytest.approx({"kill": 1.5, "you kill": 3.0, "i will kill you": 3.0, "i will not kill you": 0.45, "kill a b c d e you": 1.5, "idiot you": 3.0, "you idiot": 3.0, "kill not idiot you": 1.5 + 0.6 + 1.5})


def test_positive_logistic_drops_what_would_be_negative():
    r = np.random.default_rng(3)
    x = r.normal(size=(400, 3))
    y = (x @ [2.0, -1.5, 0.0] + r.normal(size=400) > 0).astype(float)
    assert toxicity.fit_logistic(x, y)[1] < 0
    found = toxicity.fit_logistic(x, y, positive=True)
    assert found[1] == 0 and found[0] > 0 and (found[:3] >= 0).all()
    assert np.allclose(toxicity.fit_logistic(x[:, :1], y)[0], found[0], atol=0.5)


def test_grammar_weighs_clauses():
    model = toxicity.Model({w: (s, 1.0 if s in ("insult", "threat") else 0.0, False) for s, ws in toxicity.GENERAL.items() for w in ws}, np.array([1.0, 0.0, 0.0, -1.0]))
    weight = model.clause_weight
    assert weight("you idiot") > weight("an idiot") > weight("she said idiot") > 0
    assert weight("you are not an idiot") < weight("you are an idiot")
    assert weight("i will kill you") > 0 and weight("a walk in the park") == 0
    assert [text for text in ("Fine. You idiot! Fine.",) for w, a, b in model.clauses(text) if text[a:b].strip() == "You idiot"]


def test_composition_equals_running_one_after_the_other():
    denial = toxicity.governed(toxicity.NOT, (toxicity.INSULT,), toxicity.DENIED, 3, 0.3)
    direct = toxicity.directed(toxicity.INSULT, 4, 1.5)
    both = toxicity.compose(denial, direct)
    random.seed(3)
    for _ in range(300):
        a = b = c = 0
        for symbol in random.choices(toxicity.SYMBOLS, k=12):
            a, between, f = denial.step(a, symbol)
            b, out, g = direct.step(b, between)
            c, out2, h = both.step(c, symbol)
            assert (out, f * g) == (out2, h)


def test_toxicity_and_quality_on_odd_rows(spark, odd_documents, labelled):
    model = toxicity.fit_sample(spark.createDataFrame(labelled[:80], "text string, label int"))
    rows = toxicity.score_documents(odd_documents, model).collect()
    assert len(rows) == odd_documents.count() and all(0 <= r["score"] <= 1 for r in rows)
    nothing = spark.createDataFrame([], "text string, label int")
    assert 0 <= toxicity.fit_sample(nothing).score("x") <= 1
    scored = quality.score_documents(odd_documents, quality.fit_sample(nothing)).collect()
    assert len(scored) == odd_documents.count() and all(r["predicted"] == int(r["score"] >= 0.3) for r in scored)


def test_hinge_machine_equals_projected_gradient():
    """The dual of the hinge loss, by plain projected gradient on the whole kernel matrix."""
    r = np.random.default_rng(12)
    x = r.normal(size=(60, 8))
    signs = np.where(x @ r.normal(size=8) + r.normal(size=60) > 0.4, 1, -1)
    rows = [(np.arange(8), row) for row in x]
    weights, intercept = linear.fit_hinge(rows, signs, 8, cost=0.7, epochs=20_000, tolerance=1e-10)
    costs = np.array([0.7 * 60 / (2 * (signs == s).sum()) for s in signs])
    wide = np.column_stack([x, np.ones(60)]) * signs[:, None]
    kernel, alpha = wide @ wide.T, np.zeros(60)
    step = 1 / np.linalg.eigvalsh(kernel).max()
    for _ in range(200_000):
        alpha = np.clip(alpha - step * (kernel @ alpha - 1), 0, costs)
    assert np.allclose(wide.T @ alpha, [*weights, intercept], atol=1e-3)
    free = (alpha > 1e-6) & (alpha < costs - 1e-6)
    margins = signs * (x @ weights + intercept)
    assert np.allclose(margins[free], 1, atol=1e-2) and (margins[alpha < 1e-9] > 0.99).all() and (margins[alpha > costs - 1e-9] < 1.01).all()


def test_quality_equals_plain_counts():
    r = random.Random(15)
    texts = [(words(r, ["mira", "tolen", "walk"] if i % 3 else ["BUY", "NOW", "!!"], 12), int(bool(i % 3))) for i in range(60)]
    rows, labels = [quality.indicators(t) for t, _ in texts], np.array([y for _, y in texts], float)
    model = quality.fit(rows, labels)
    width = 1 << quality.BITS
    counts = {c: [1.0] * width for c in (0, 1)}
    for places, y in zip(rows, labels, strict=True):
        for p in places:
            counts[int(y)][p] += 1
    sums = {c: sum(counts[c]) for c in counts}
    ratio = {int(p): np.log(counts[1][p] / sums[1]) - np.log(counts[0][p] / sums[0]) for places in rows for p in places}
    scaled = [(p, np.array([ratio[int(i)] for i in p]) / np.sqrt(len(p))) for p in rows]
    weights, intercept = linear.fit_hinge(scaled, np.where(labels > 0, 1, -1), width, epochs=10, tolerance=0.01)
    mean = np.abs(weights[weights != 0]).mean()
    for places in rows[:20]:
        value = sum((0.5 * mean + 0.5 * weights[p]) * ratio[int(p)] for p in places) / np.sqrt(len(places)) + intercept
        assert np.isclose(model.score(places), 1 / (1 + np.exp(-(model.slope * value + model.offset))), atol=1e-4)


def test_language_is_told_by_family_first():
    r = random.Random(16)
    marks = {"en": ["the", "thing", "shall"], "de": ["sch", "und", "keit"], "fr": ["eau", "quex", "oire"], "es": ["cion", "ado", "rra"], "it": ["gli", "zione", "che"]}
    rows = [(words(r, marks[k], 20), k) for k in list(marks) * 30]
    model = language_id.fit([language_id.gram_counts(t) for t, _ in rows], [k for _, k in rows])
    for text, _ in [*rows[:40], ("x", "en"), ("the eau " * 3000, "en")]:
        places, n = language_id.gram_counts(text)
        dense = np.zeros(len(model.table))
        dense[places] = n / max(1, n.sum())
        margins = dense @ model.table.astype(float) + model.intercepts
        assert np.allclose(margins, model.margins(text), atol=1e-6)
        family = int(margins[: len(model.families)].argmax())
        votes = {k: 0.0 for k in model.langs[family]}
        for a, b, column in model.pairs[family]:
            votes[model.langs[family][a]] += 1 / (1 + np.exp(-2 * margins[column]))
            votes[model.langs[family][b]] += 1 / (1 + np.exp(2 * margins[column]))
        assert model.predict(text)[0] == max(votes, key=lambda k: (votes[k], -model.langs[family].index(k)))


def test_quality_learns_shapes(spark):
    r = random.Random(6)
    names = ["mira", "tolen", "basket", "river", "stone", "walk"]
    rows = [(words(r, names, 30) + ".", 1) for _ in range(150)] + [(words(r, names, 30).upper().replace(" ", "!! "), 0) for _ in range(75)]
    model = quality.fit_sample(spark.createDataFrame(rows, "text string, label int"))
    fresh = words(r, names, 25)
    assert model.score(quality.indicators(fresh)) > 0.5 > model.score(quality.indicators(fresh.upper().replace(" ", "!! ")))


def test_languages(spark, odd_documents):
    r = random.Random(7)
    marks = {"en": ["the", "thing", "shall", "with"], "de": ["sch", "und", "ach", "keit"], "fr": ["eau", "quex", "oire", "ment"], "es": ["cion", "ado", "rra", "los"]}
    rows = [(i, words(r, marks[k], 20), k) for i, k in enumerate(list(marks) * 60)]
    model = language_id.fit_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.families == ["germanic", "romance"]
    fresh = [(k, words(r, m, 15)) for k, m in marks.items() for _ in range(10)]
    assert sum(model.predict(t)[0] == k for k, t in fresh) >= 39
    assert model.predict(None) == model.predict("12 !?") == ("und", 0.0)
    found = language_id.predict_documents(odd_documents, model)
    assert found.columns == ["doc_id", "text", "lang", "source", "n_chars", "key", "lang_pred", "score"] and found.count() == odd_documents.count()
    kept = language_id.filter_documents(odd_documents, model, least_score=0.0)
    assert kept.columns == odd_documents.columns and kept.count() == odd_documents.where(F.coalesce("text", F.lit("")).rlike(r"\p{L}")).count()
    nothing = language_id.fit_documents(odd_documents.limit(0))
    assert nothing.predict("word") == ("und", 0.0)


def test_bounds_and_best_fit():
    random_ = np.random.default_rng(8)
    for _ in range(60):
        lengths = np.sort(random_.integers(1, 101, random_.integers(1, 40)))[::-1]
        bins = packing.best_fit_decreasing(lengths, 100)
        assert np.bincount(bins, weights=lengths).max() <= 100
        assert packing.lower_bound(lengths, 100) <= bins.max() + 1
    assert packing.lower_bound(np.array([60] * 7), 100) == 7
    assert packing.lower_bound(np.array([34] * 9), 100) == 5
    assert packing.cut_lengths(2500, 1024) == [452, 1024, 1024] and packing.cut_lengths(2048, 1024) == [1024, 1024]


def test_packing(spark, odd_documents):
    rows = packing.pack_documents(spark, odd_documents, PLAIN, public_tokenizers.PATTERN, bucket_rows=3).toPandas()
    assert len(rows[rows["doc_id"] == 0]) == 1 and rows[rows["doc_id"] == 0]["ids_crc32"].iloc[0] == zlib.crc32(np.array([2], "<u4").tobytes())
    for _, part in rows.groupby("sequence_id"):
        part = part.sort_values("offset")
        assert part["offset"].tolist() == np.concatenate([[0], np.cumsum(part["length"])[:-1]]).tolist() and part["length"].sum() <= 1024
    for i, text in enumerate(TEXTS):
        ids = np.array([*_reference().encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        own = rows[rows["doc_id"] == i].drop_duplicates("piece").sort_values("piece")
        assert own["length"].sum() == len(ids)
        for p in own.itertuples():
            assert p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())
    assert packing.pack_documents(spark, odd_documents.limit(0), PLAIN, public_tokenizers.PATTERN).count() == 0
