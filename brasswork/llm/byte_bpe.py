"""Byte-level BPE, encoding and decoding (operator 4).

A piece of text is a match of the splitting pattern. Its bytes, mapped one to one to Latin-1 characters, run
through an Aho-Corasick automaton of all tokens, which gives the tokens that start at each byte. The encoder takes
the longest one and steps back where it can't go on: two tokens may stand side by side only if the merges of their
joined bytes give just these two, which is looked up in a memo. A byte offset that led nowhere is never tried
again, so the work is linear in the piece.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from brasswork.llm.common import doc_texts, slices

#: Two neighbours of which one is a space, or other white space next to white space: words can't be told by single spaces.
_RUNS = re.compile(r"\s\s")


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge_by_rank(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The definition: join the neighbours of least rank, the left one on ties, until none joins."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        rank, at = min((ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
        if rank == 1 << 60:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


class PieceEncoder:
    """Ids of one piece of bytes."""

    def __init__(self, ranks: dict[bytes, int], memo_size: int = 1_000_000):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.memo: dict[tuple[int, int], bool] = {}
        self.memo_size = memo_size
        self.edges: dict[tuple[int, bool], list[tuple[bytes, int]]] = {}
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (rank, len(token)))
        self.automaton.make_automaton()

    def _halves(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The two parts whose merge makes a token; None for a single byte."""
        if len(token) == 1:
            return None
        left = merge_by_rank(token, {t: r for t, r in self._inside(token) if t != token})
        if len(left) != 2:
            raise ValueError(f"no merge makes token {token!r}")
        return self.tokens[left[0]], self.tokens[left[1]]

    def _inside(self, token: bytes) -> Iterator[tuple[bytes, int]]:
        for end, (rank, length) in self.automaton.iter(token.decode("latin-1")):
            yield token[end + 1 - length : end + 1], rank

    def _edge(self, rank: int, right: bool) -> list[tuple[bytes, int]]:
        """What stands at one end of a token while it is being merged, last first, each with the rank that ends its time."""
        found = self.edges.get((rank, right))
        if found is None:
            token, until, found = self.tokens[rank], 1 << 60, []
            while True:
                found.append((token, until))
                halves = self._halves(token)
                if halves is None:
                    break
                until, token = self.ranks[token], halves[right]
            self.edges[rank, right] = found
        return found

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the joined bytes of two tokens gives these two again.

        It does not if, at some time, what ends the left one and what begins the right one are neighbours that merge
        before either is used up. A merge further left goes first among equal ranks.
        """
        known = self.memo.get((left, right))
        if known is None:
            if len(self.memo) >= self.memo_size:
                self.memo.clear()
            rank_of, begins = self.ranks.get, self._edge(right, False)
            known = True
            for a, a_until in self._edge(left, True):
                for b, b_until in begins:
                    rank = rank_of(a + b)
                    if rank is not None and rank < a_until and rank <= b_until:
                        known = False
            self.memo[left, right] = known
        return known

    def encode(self, piece: bytes) -> list[int]:
        if not piece:
            return []
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        path = [found[0] for _, found in self.automaton.iter_long(piece.decode("latin-1"))]
        memo, left = self.memo, path[0]
        for token in path[1:]:
            if not (memo.get((left, token)) or self.compatible(left, token)):
                return self._backtrack(piece)
            left = token
        return path  # the longest matches, one behind the other, already fit

    def _backtrack(self, piece: bytes) -> list[int]:
        size = len(piece)
        starting: list[list[tuple[int, int]]] = [[] for _ in range(size)]
        for end, found in self.automaton.iter(piece.decode("latin-1")):
            starting[end + 1 - found[1]].append(found)  # by ascending length
        fruitless = bytearray(size + 1)
        path: list[int] = []
        places: list[tuple[int, int]] = []  # of each token in path: its start, and its place among those that start there
        at, choice = 0, len(starting[0]) - 1 if size else -1
        memo = self.memo
        while at < size:
            here = starting[at]
            while choice >= 0:
                token, length = here[choice]
                if not fruitless[at + length]:
                    if not path:
                        break
                    fits = memo.get((path[-1], token))
                    if fits or fits is None and self.compatible(path[-1], token):
                        break
                choice -= 1
            if choice >= 0:
                path.append(token)
                places.append((at, choice))
                at += length
                choice = len(starting[at]) - 1 if at < size else -1
            else:
                fruitless[at] = 1
                if not path:
                    raise ValueError("the vocabulary lacks single bytes")
                path.pop()
                at, choice = places.pop()
                choice -= 1
        return path


class WordCache(dict):
    """What a function gives for words of a text, kept for the first limit words; others are computed each time.

    A key is a word that follows a single space, which is not part of it; or, if it starts with a line feed, that
    line feed and the word behind it. Values are sequences: that of a word with a comma or full stop behind a letter
    is the word's and the mark's.
    """

    def __init__(self, compute, limit: int = 400_000, longest: int = 64):
        super().__init__()
        self.compute, self.limit, self.longest = compute, limit, longest
        self.marks = {mark: compute(mark) for mark in ".,"}

    def __missing__(self, word: str):
        if word[-1:] in self.marks and word[-2:-1].isalpha():
            value = self[word[:-1]] + self.marks[word[-1]]
        else:
            value = self.compute(word if word.startswith("\n") else " " + word)
        if len(word) <= self.longest and len(self) < self.limit:
            self[word] = value
        return value

    def values_of(self, text: str) -> Iterable:
        """Values whose concatenation is that of the whole text.

        The splitting pattern never joins what stands on both sides of a single space or line feed, so words can be
        encoded each for itself. Texts with runs of white space are computed whole.
        """
        if _RUNS.search(text):
            return (self.compute(text),)
        first, *words = text.replace("\n", " \n").split(" ")
        head = (self.compute(first),) if first else ()
        return chain(head, map(self.__getitem__, words))


class Codec:
    """Encodes and decodes texts by a rank file and a splitting pattern."""

    def __init__(self, path: str, pattern: str):
        self.pieces = PieceEncoder(load_ranks(path))
        self.pattern = regex.compile(pattern)
        self.tokens = [self.pieces.tokens.get(i, b"") for i in range(max(self.pieces.tokens) + 1)]
        self.decimals = list(map(str, range(len(self.tokens))))
        self.words = WordCache(self._ids)

    def _ids(self, text: str) -> tuple[int, ...]:
        encode = self.pieces.encode
        if (text[1:] if text[:1] == " " else text).isalpha():
            return tuple(encode(text.encode()))  # letters alone are one piece
        return tuple(i for piece in self.pattern.findall(text) for i in encode(piece.encode()))

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(self.words.values_of(text)))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One codec for each worker process."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(path, pattern)
    return _CODECS[path, pattern]


def encode_documents(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids array<int>. A null text counts as empty and gives no ids; repeated rows give repeated results.

    Texts of any length are encoded whole; an empty table gives no rows, and columns other than doc_id and text are left
    out, whatever their names. The cache of words is right for patterns that, like the given one, never match across a
    single space before a word; others need a codec without it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in slices(batches):
            ids = [own.encode(text) for text in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return doc_texts(documents).mapInArrow(run, "doc_id long, ids array<int>")


def digest_documents(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each row: what encoding gives and what decoding its ids gives back.

    A null text is an empty one: no tokens, and the checksums of nothing. Texts of any length are encoded whole, one at a
    time; ties cannot occur, as a text has one encoding. Repeated rows get equal results, a null doc_id stays null. An
    empty table gives no rows; columns other than doc_id and text are left out, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in slices(batches):
            counts, encoded, decoded = [], [], []
            for text in batch.column("text").to_pylist():
                ids = own.encode(text)
                counts.append(len(ids))
                encoded.append(hashlib.sha256(",".join(map(own.decimals.__getitem__, ids)).encode()).hexdigest())
                decoded.append(hashlib.sha256(own.decode(ids)).hexdigest())
            yield pa.record_batch([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(encoded, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return doc_texts(documents).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
