"""Language identification in two levels (operator 7).

A text is counted as hashed n-grams of its characters. First linear machines, one for each language family against
the others, predict the family; then, within it, one linear machine for each pair of languages votes by its margin.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brasswork.llm.common import slices
from brasswork.llm.linear import Row, fit_hinge, sigmoid

#: ISO 639-1 codes by language family. A code that isn't here is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af lb",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk sl hr sr bs mk bg",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz",
    "indic": "hi ur bn mr ne pa gu",
    "semitic": "ar he mt",
}
_FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

BITS = 15
_SHIFT = np.uint32(32 - BITS)
_MIX = np.uint32(2654435761)
_PIECE = 1 << 18  # characters counted at a time


def family_of(lang: str) -> str:
    return _FAMILY_OF.get(lang.lower().replace("_", "-").partition("-")[0], lang)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def gram_places(text: str) -> Iterator[np.ndarray]:
    """Hashed places of all runs of one, two and three characters, by parts of a long text."""
    points = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    for start in range(0, max(len(points), 1), _PIECE):
        one = points[start : start + _PIECE + 2]
        mixed = one * _MIX
        two = mixed[:-1] * np.uint32(31) + one[1:] * np.uint32(40503) + np.uint32(17)
        three = (two[:-1] ^ (two[:-1] >> np.uint32(13))) * np.uint32(37) + one[2:] * np.uint32(48271) + np.uint32(91)
        n = min(len(one), _PIECE)  # the two characters behind a part only end its n-grams
        grams = np.concatenate([one[:n] * np.uint32(7) + np.uint32(5), two[:n], three[:n]])
        yield ((grams ^ (grams >> np.uint32(15))) * _MIX) >> _SHIFT


def gram_counts(text: str) -> Row:
    """Places that occur in a whole text, and how often."""
    total = sum((np.bincount(p, minlength=1 << BITS) for p in gram_places(text)), np.zeros(1 << BITS, np.int64))
    places = np.flatnonzero(total)
    return places.astype(np.int32), total[places].astype(np.int32)


@dataclass
class Model:
    families: list[str]
    langs: list[list[str]]  # of each family
    pairs: list[list[tuple[int, int, int]]]  # of each family: two of its languages, and their machine's column
    table: np.ndarray  # a row for each place, a column for each machine; the last column is 1
    intercepts: np.ndarray

    def margins(self, text: str) -> np.ndarray:
        total, n = np.zeros(self.table.shape[1]), 0
        for places in gram_places(text):
            total += self.table[places].sum(0, dtype=np.float64)
            n += len(places)
        return total / max(n, 1) + self.intercepts

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language and a score from 0 to 1; 'und' and 0 if there is no letter."""
        if not has_letter(text) or not self.families:
            return "und", 0.0
        margins = self.margins(text)
        own = margins[: len(self.families)]
        family = int(own.argmax())
        sure = float(own[family])
        langs = self.langs[family]
        votes, won = np.zeros(len(langs)), {}
        for a, b, column in self.pairs[family]:
            m = float(margins[column])
            votes[a] += sigmoid(2 * m)
            votes[b] += sigmoid(-2 * m)
            won[a, b], won[b, a] = m, -m
        best = int(votes.argmax())
        least = min((won[best, other] for other in range(len(langs)) if other != best), default=1.0)
        return langs[best], float(sigmoid(4 * min(sure, least)))


def fit(counts: list[Row], langs: list[str]) -> Model:
    """From n-gram counts of training texts (places and numbers) and their languages."""
    names = sorted(set(langs))
    families = sorted({family_of(x) for x in names})
    members = [[x for x in names if family_of(x) == f] for f in families]
    mean = np.zeros(1 << BITS)
    for places, n in counts:
        mean[places] += n / max(1, n.sum()) / len(counts)
    scale = 1 / np.sqrt(mean + 1e-5)
    rows = [(places, n / max(1, n.sum()) * scale[places]) for places, n in counts]
    columns, intercepts, pairs = [], [], []

    def machine(keep: list[int], positive: list[bool]) -> int:
        signs = np.where(positive, 1, -1)
        if len(set(positive)) < 2:
            weights, intercept = np.zeros(1 << BITS), float(signs[0]) if len(signs) else 0.0
        else:
            weights, intercept = fit_hinge([rows[i] for i in keep], signs, 1 << BITS, cost=10.0)
        columns.append(weights * scale)
        intercepts.append(intercept)
        return len(columns) - 1

    everything = list(range(len(rows)))
    for family in families:
        machine(everything, [family_of(x) == family for x in langs])
    for own in members:
        found = []
        for a, b in combinations(range(len(own)), 2):
            keep = [i for i, x in enumerate(langs) if x in (own[a], own[b])]
            found.append((a, b, machine(keep, [langs[i] == own[a] for i in keep])))
        pairs.append(found)
    table = np.column_stack(columns).astype(np.float32) if columns else np.zeros((1 << BITS, 1), np.float32)
    return Model(families, members, pairs, table, np.array(intercepts or [0.0]))


def training_rows(documents: DataFrame, per_lang: int, modulus: int = 4, remainder: int = 2) -> DataFrame:
    """Documents with a text and a language outside the held-out fold; about per_lang of each language, by a hash of doc_id."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == remainder, F.lit(True))
    usable = documents.where(~held & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return usable.select("text", "lang").limit(0)
    spread = F.pmod(F.xxhash64("doc_id", F.lit("lang")), F.lit(1 << 30))
    share = F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, min(1 << 30, int((1 << 30) * per_lang / n) + 1))])
    return usable.where(spread < share[F.col("lang")]).select("text", "lang")


def fit_documents(documents: DataFrame, per_lang: int = 500) -> Model:
    """Learns from a bounded sample: about per_lang training documents of each language, whole texts.

    The sample grows with the number of different lang values, and machines with its square within a family: lang must
    be a column of few languages, not a free text.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [gram_counts(t) for t in batch.column("text").to_pylist()]
            sparse, values = [places for places, _ in rows], [n for _, n in rows]
            yield pa.record_batch([batch.column("lang"), pa.array(sparse, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.int32()))], names=["lang", "places", "n"])

    found = training_rows(documents, per_lang).mapInArrow(count, "lang string, places array<int>, n array<int>").toArrow()
    langs = found["lang"].to_pylist()
    counts = [(places.values.to_numpy(), n.values.to_numpy()) for places, n in zip(found["places"], found["n"], strict=True)]
    # in an order that doesn't depend on how the rows were dealt out
    order = sorted(range(len(langs)), key=lambda i: (langs[i], zlib.crc32(counts[i][0].tobytes()), zlib.crc32(counts[i][1].tobytes())))
    return fit([counts[i] for i in order], [langs[i] for i in order])


def predict_documents(documents: DataFrame, model: Model) -> DataFrame:
    """All columns of documents, then lang_pred and score (in place of columns of these names).

    A text that is null or has no letter is 'und' with score 0, whatever its length; texts are read whole. Of languages
    that tie the first by name is told. Repeated rows get equal results, an empty table gives no rows.
    """
    kept = documents.drop("lang_pred", "score")
    shared = documents.sparkSession.sparkContext.broadcast(model)  # its size depends on the languages, not on the rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [shared.value.predict(t) for t in batch.column("text").to_pylist()]
            yield pa.record_batch(
                [*batch.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                names=[*batch.schema.names, "lang_pred", "score"],
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return kept.mapInArrow(run, f"{schema}, lang_pred string, score double")


def filter_documents(documents: DataFrame, model: Model, least_score: float = 0.5) -> DataFrame:
    """Documents whose language is recognised: 'und' and scores under least_score go. The columns stay as they are, whatever their names.

    A null, empty or letterless text is 'und' and goes. Texts of any length are read whole. Repeated rows stay or go
    together; of languages of equal score the first by name counts. An empty table gives no rows.
    """
    found = predict_documents(documents.select(F.struct("*").alias("row"), "text"), model)
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= least_score)).select("row.*")
