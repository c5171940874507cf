"""Toxicity as a weighted finite-state pattern grammar (operator 1).

Words of a clause become symbols: insult and threat (with a weight), target, negation, speech verb, other. Four
transducers read and write symbols: negation turns what it governs into a denied insult or threat, reported speech
turns it into a quoted one, and the insult and threat transducers score what is left, more if a target stands near.
Their composition is one machine that runs over each clause in which a lexicon entry occurs. Documents are scored by
their matched clauses. The lexicon is a short general one and, with learned weights, the words and word beginnings
that mark the toxic class of a bounded sample of labelled texts.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brasswork.llm.common import doc_texts, held_out, slices
from brasswork.llm.linear import fit_logistic, sigmoid

INSULT, THREAT, TARGET, NOT, SAYS, WORD = "insult", "threat", "target", "not", "says", "word"
DENIED, QUOTED, AIMED = "denied", "quoted", "aimed"
SYMBOLS = (INSULT, THREAT, TARGET, NOT, SAYS, WORD)
MARKED = (*SYMBOLS, DENIED, QUOTED, AIMED)
PRIOR = {INSULT: 2.0, THREAT: 1.5}  # weights of general words of which the sample tells nothing
FULL = 4.0  # a clause of this weight counts as a whole one

#: General English words of each symbol.
GENERAL = {
    INSULT: "idiot moron stupid loser scum trash worthless pathetic disgusting imbecile filth vermin".split(),
    THREAT: "kill murder hurt destroy shoot stab burn strangle".split(),
    TARGET: "you your youre he she him her they them we people everyone anyone someone".split(),
    NOT: "not no never nobody nothing neither nor isnt arent wasnt dont doesnt didnt wont cant".split(),
    SAYS: "said says say saying told tells claimed claims wrote writes called calls quoted asked replied".split(),
}
_BREAK = re.compile(r"[.!?;:\n]")
_WORD = re.compile(r"\w+")


@dataclass
class Transducer:
    """Arcs lead from (state, symbol read) to (state, symbol written, factor); a symbol without an arc goes on unchanged to idle."""

    arcs: dict[tuple[int, str], tuple[int, str, float]]
    idle: dict[int, int] = field(default_factory=dict)

    def step(self, state: int, symbol: str) -> tuple[int, str, float]:
        return self.arcs.get((state, symbol)) or (self.idle.get(state, 0), symbol, 1.0)

    def states(self) -> set[int]:
        return {0} | {s for s, _ in self.arcs} | {s for s, _, _ in self.arcs.values()} | set(self.idle) | set(self.idle.values())


def governed(opener: str, read: tuple[str, ...], written: str, reach: int, factor: float) -> Transducer:
    """Behind an opener, for `reach` more symbols, what is read is written as another symbol with a factor."""
    arcs: dict[tuple[int, str], tuple[int, str, float]] = {}
    for state in range(reach + 1):
        arcs[state, opener] = (reach, opener, 1.0)
        if state:
            for symbol in read:
                arcs[state, symbol] = (state - 1, written, factor)
    return Transducer(arcs, {state: max(0, state - 1) for state in range(reach + 1)})


def directed(read: str, reach: int, boost: float) -> Transducer:
    """A symbol near a target counts more: with a factor if the target stands before it, and if it stands behind, that
    target is written as AIMED with what the factor adds to the last weight.
    """
    number = {(t, r): (reach + 1) * r + t for t in range(reach + 1) for r in range(reach + 1)}  # symbols since a target, and since a symbol without one
    arcs: dict[tuple[int, str], tuple[int, str, float]] = {}
    for (t, r), state in number.items():
        arcs[state, TARGET] = (number[reach, 0], AIMED, boost - 1) if r else (number[reach, 0], TARGET, 1.0)
        arcs[state, AIMED] = (number[reach, 0], AIMED, 1.0)
        arcs[state, read] = (number[t - 1, 0], read, boost) if t else (number[0, reach], read, 1.0)
    return Transducer(arcs, {state: number[max(0, t - 1), max(0, r - 1)] for (t, r), state in number.items()})


def compose(first: Transducer, second: Transducer) -> Transducer:
    """The second reads what the first writes; factors multiply. Only pairs of states that can occur are built."""
    number = {(0, 0): 0}
    todo, arcs = [(0, 0)], {}
    while todo:
        pair = todo.pop()
        for symbol in MARKED:
            a, between, f = first.step(pair[0], symbol)
            b, out, g = second.step(pair[1], between)
            if (a, b) not in number:
                number[a, b] = len(number)
                todo.append((a, b))
            arcs[number[pair], symbol] = (number[a, b], out, f * g)
    return Transducer(arcs)


def grammar() -> Transducer:
    denial = governed(NOT, (INSULT, THREAT), DENIED, 3, 0.3)
    report = governed(SAYS, (INSULT, THREAT), QUOTED, 8, 0.5)
    return compose(compose(compose(denial, report), directed(INSULT, 4, 1.5)), directed(THREAT, 4, 2.0))


@dataclass
class Model:
    """lexicon: symbol, weight and whether only the beginning counts, by lower-case word."""

    lexicon: dict[str, tuple[str, float, bool]]
    coefficients: np.ndarray
    machine: Transducer = field(default_factory=grammar)
    _found: object = None

    def __getstate__(self):
        return {"lexicon": self.lexicon, "coefficients": self.coefficients, "machine": self.machine, "_found": None}

    def automaton(self):
        if self._found is None:
            self._found = ahocorasick.Automaton()
            for word, (symbol, _, _) in self.lexicon.items():
                if symbol in (INSULT, THREAT):
                    self._found.add_word(word, word)
            if len(self._found):
                self._found.make_automaton()
        return self._found

    def entry(self, word: str) -> tuple[str, float]:
        """The symbol and weight of a word: of itself, or else of its longest beginning in the lexicon."""
        own = self.lexicon.get(word)
        if own:
            return own[:2]
        for n in range(min(len(word), STEM_LENGTHS[-1]), STEM_LENGTHS[0] - 1, -1):
            own = self.lexicon.get(word[:n])
            if own and own[2]:
                return own[:2]
        return WORD, 0.0

    def clauses(self, text: str) -> list[tuple[float, int, int]]:
        """Weight, start and end of each clause in which the grammar matches."""
        lower = text.lower()
        automaton = self.automaton()
        if not len(automaton):
            return []
        found, done = [], -1
        for end, word in automaton.iter(lower):
            start = end + 1 - len(word)
            if start < done or start and lower[start - 1].isalnum():
                continue
            if not self.lexicon[word][2] and lower[end + 1 : end + 2].isalnum():
                continue
            left = max((m for m in (lower.rfind(mark, max(done, 0), start) for mark in ".!?;:\n")), default=-1) + 1
            stop = _BREAK.search(lower, end + 1)
            right = stop.start() if stop else len(lower)
            weight = self.clause_weight(lower[left:right])
            done = right
            if weight:
                found.append((weight, left, right))
        return found

    def clause_weight(self, clause: str) -> float:
        state, total, last = 0, 0.0, 0.0
        for match in _WORD.finditer(clause.replace("'", "").replace("’", "")):
            symbol, weight = self.entry(match[0])
            state, out, factor = self.machine.step(state, symbol)
            if weight and out in (INSULT, THREAT, DENIED, QUOTED):
                total += weight * factor
                last = weight * factor if out in PRIOR else last
            elif out == AIMED:
                total += last * factor
        return total

    def scored(self, text: str) -> tuple[float, int]:
        """The score of a text and the number of its matched clauses."""
        weights = [w for w, _, _ in self.clauses(text)]
        return float(sigmoid(np.dot(self.coefficients[:-1], features(weights)) + self.coefficients[-1])), len(weights)

    def score(self, text: str) -> float:
        return self.scored(text)[0]


def features(weights: list[float]) -> list[float]:
    """Of a text's clause weights: the greatest, their sum, and their number, in which a clause counts in proportion up to FULL. Each grows with every weight."""
    return [max(weights, default=0.0), float(np.log1p(sum(weights))), float(np.log1p(sum(min(w / FULL, 1.0) for w in weights)))]


STEM_LENGTHS = (4, 5, 6)
FOLDS = 5  # of the sample: each is weighed by the lexicon of the others


def sketch(text: str, size: int = 8) -> list[int]:
    """The least values of several hashes over a text's runs of five words, by which near copies are told."""
    words = np.fromiter((zlib.crc32(w.encode()) for w in _WORD.findall(text.lower())), np.uint64)
    if not len(words):
        return []
    runs = words[: max(1, len(words) - 4)].copy()
    for k in range(1, min(5, len(words))):
        runs = runs * np.uint64(0x9E3779B97F4A7C15) ^ words[k : k + len(runs)]
    return [int((runs * np.uint64(0xD6E8FEB86659FD93 + 2 * k) >> np.uint64(1)).min()) for k in range(size)]


def _distinct(texts: list[tuple[list[str], list[int], int, int]]) -> list[tuple[set[str], int, int]]:
    """Words, label and key of one text of each group of copies and near copies: those that share half of a sketch."""
    seen: set[tuple[int, int, int]] = set()
    kept = []
    for words, minima, label, key in texts:
        own = {(k, m, label) for k, m in enumerate(minima)}
        if not own or 2 * len(own & seen) < len(own):
            kept.append((set(words), label, key))
        seen |= own
    return kept


_SEEDS = {symbol: re.compile("|".join(words)) for symbol, words in GENERAL.items() if symbol in PRIOR}


def _symbol(word: str, stem: bool, toxic: list[tuple[set[str], dict[str, list[str]]]]) -> str:
    """What a learned entry is read as: as the general insults and threats are that stand in its toxic texts more often than in others; an insult if neither does.

    toxic has the words of each toxic text, and those that begin with a general insult or threat.
    """
    own = [seeds for words, seeds in toxic if (any(w.startswith(word) for w in words) if stem else word in words)]
    lift = {}
    for symbol in PRIOR:
        holds = lambda seeds, symbol=symbol: any(not w.startswith(word) for w in seeds[symbol])
        inside, all_ = sum(map(holds, own)), sum(holds(seeds) for _, seeds in toxic)
        lift[symbol] = (inside + 0.5) / (len(own) + 1) / ((all_ + 0.5) / (len(toxic) + 1)) if inside else 0.0
    return THREAT if lift[THREAT] > lift[INSULT] else INSULT


def learn_lexicon(texts: list[tuple[set[str], int]], least: int = 6, ratio: float = 3.5) -> dict[str, tuple[str, float, bool]]:
    """Words and beginnings whose share among toxic texts is far higher; weights are log ratios, at most 6."""
    n = Counter(label for _, label in texts)
    lexicon = {w: (symbol, PRIOR.get(symbol, 0.0), False) for symbol, words in GENERAL.items() for w in words}
    if not n[1] or not n[0]:
        return lexicon
    counts = {0: Counter(), 1: Counter()}
    for words, label in texts:
        stems = {(w[:k], True) for w in words for k in STEM_LENGTHS if len(w) > k}
        counts[label].update(stems | {(w, False) for w in words})
    weight = lambda key: float(np.log((counts[1][key] + 0.5) / (n[1] + 1)) - np.log((counts[0][key] + 0.5) / (n[0] + 1)))
    strong = {key: weight(key) for key, k in counts[1].items() if k >= least and weight(key) >= ratio}
    toxic = [(words, {symbol: [w for w in words if seed.match(w)] for symbol, seed in _SEEDS.items()}) for words, label in texts if label]
    for (word, stem), w in sorted(strong.items(), key=lambda x: (not x[0][1], x[0])):
        if word in lexicon:
            continue
        if not stem and any(strong.get((word[:k], True)) for k in STEM_LENGTHS):
            continue
        if stem and any(strong.get((word[:k], True)) for k in STEM_LENGTHS if k < len(word)):
            continue
        lexicon[word] = (_symbol(word, stem, toxic), min(6.0, w), stem)
    for word, (symbol, own, _) in list(lexicon.items()):  # general words: what the sample says of them or of their beginnings, or that they say nothing here
        if symbol in PRIOR and word in GENERAL[symbol]:
            told = [strong[key] for key in ((word, False), *((word[:k], True) for k in STEM_LENGTHS)) if key in strong]
            if told:
                lexicon[word] = (symbol, min(6.0, max(own, *told)), False)
            elif counts[0][word, False] >= least and weight((word, False)) < 1:
                lexicon[word] = (symbol, 0.1, False)
    return lexicon


def _clause_features(keyed: DataFrame, models: list[Model], folds: dict[tuple[int, int], int]) -> tuple[np.ndarray, np.ndarray]:
    """Features of whole texts, as in scoring, by the model of the fold that a text isn't in, and labels; one row for each entry of folds."""
    shared = keyed.sparkSession.sparkContext.broadcast((models, folds))  # of a bounded sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, folds = shared.value
        for batch in slices(batches):
            rows = []
            for key, text, label in zip(*(batch.column(c).to_pylist() for c in ("key", "text", "label")), strict=True):
                fold = folds.get((key, label))
                if fold is not None:
                    rows.append((key, label, features([w for w, _, _ in models[fold].clauses(text)])))
            yield pa.record_batch([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.int32(), pa.list_(pa.float64())))], names=["key", "label", "features"])

    found = keyed.mapInArrow(run, "key long, label int, features array<double>").toArrow()
    rows = {(key, label): x for key, label, x in zip(*(found[c].to_pylist() for c in ("key", "label", "features")), strict=True)}
    order = sorted(rows)
    return np.array([rows[k] for k in order], float).reshape(-1, 3), np.array([label for _, label in order], float)


def fit_sample(sample: DataFrame) -> Model:
    """From rows of text and label. Each of FOLDS parts of the distinct texts is weighed by the clauses that the lexicon of the others finds; then the lexicon is learned from all.

    Coefficients of clause features aren't negative, so that a clause can only add to a score and what the grammar takes
    from a denied or quoted one always lowers it. A learned entry is read as what the general words beside it are. Without two classes a fixed model is used.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            words = [sorted(set(_WORD.findall(t.lower()))) for t in texts]
            sketches = [sketch(t) for t in texts]
            yield pa.record_batch([batch.column("key"), batch.column("label"), pa.array(words, pa.list_(pa.string())), pa.array(sketches, pa.list_(pa.int64()))], names=["key", "label", "words", "sketch"])

    keyed = sample.select(F.xxhash64("text").alias("key"), "text", (F.col("label").cast("int") > 0).cast("int").alias("label"))
    found = keyed.mapInArrow(run, "key long, label int, words array<string>, sketch array<long>").toArrow()
    ordered = sorted(zip(found["sketch"].to_pylist(), found["label"].to_pylist(), found["words"].to_pylist(), found["key"].to_pylist(), strict=True))
    kept = _distinct([(words, minima, label, key) for minima, label, words, key in ordered])
    texts = [(words, label) for words, label, _ in kept]
    if len({label for _, label in texts}) < 2:
        return Model(learn_lexicon(texts), np.array([0.4, 0.4, 0.4, -2.0]))
    models = [Model(learn_lexicon([x for i, x in enumerate(texts) if i % FOLDS != fold]), np.zeros(4)) for fold in range(FOLDS)]
    found, labels = _clause_features(keyed, models, {(key, label): i % FOLDS for i, (_, label, key) in enumerate(kept)})
    return Model(learn_lexicon(texts), fit_logistic(found, labels, positive=True))


def score_documents(documents: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted, n_clauses for each row.

    A null text counts as empty and has the score of a text without matches; texts of any length are read whole; repeated
    rows get equal scores; a null doc_id is never held out. Other columns are left out, an empty table gives no rows.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)  # the lexicon comes from a bounded sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in slices(batches):
            found = [own.scored(t) for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array([s for s, _ in found], pa.float64()), pa.array([n for _, n in found], pa.int64())], names=["doc_id", "score", "n_clauses"])

    scored = doc_texts(documents).mapInArrow(run, "doc_id long, score double, n_clauses long")
    return scored.select("doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_clauses")
