"""Ids of whole texts in a byte-level vocabulary given as ranks, as packed little-endian 32-bit numbers.

A tokenizer file beside the ranks (the same name with .json) may declare added tokens. Like the tokenizers library, the
encoder takes these out of a text first, the leftmost and longest where they overlap, and encodes what stands between.
"""

from __future__ import annotations

import json
import os
import re
from itertools import compress

import numpy as np
import tiktoken

from brasswork.llm.byte_bpe import load_ranks

_RUNS = re.compile(r"\s\s")


def added_tokens(path: str) -> dict[str, int]:
    """Ids of the added tokens that the tokenizer file beside a rank file declares; none without such a file."""
    beside = os.path.splitext(path)[0] + ".json"
    if not os.path.exists(beside):
        return {}
    with open(beside, encoding="utf-8") as file:
        tokens = json.load(file).get("added_tokens", [])
    odd = [t["content"] for t in tokens if t.get("single_word") or t.get("lstrip") or t.get("rstrip")]
    if odd:
        raise ValueError(f"added tokens that depend on what stands beside them: {odd}")
    return {t["content"]: t["id"] for t in tokens}


class PackedEncoder:
    """Encodes texts; keeps the ids of the first `limit` words it meets and encodes a text's other words in one call.

    Words are what stands between single spaces and line feeds, across which the splitting pattern never matches.
    """

    def __init__(self, path: str, pattern: str, limit: int = 400_000, longest: int = 48):
        ranks = load_ranks(path)
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        added = added_tokens(path)
        self.added = {token: np.array([number], "<u4").tobytes() for token, number in added.items()}
        self.split = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True))))
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.sizes[rank] = len(token)
        self.limit, self.longest = limit, longest
        self.words: dict[str, bytes] = {"": self.whole(" ")}

    def whole(self, text: str) -> bytes:
        return np.array(self.encoding.encode_ordinary(text), "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if not any(token in text for token in self.added):
            return self.between(text)
        parts, start = [], 0
        for match in self.split.finditer(text):
            parts += [self.between(text[start : match.start()]), self.added[match[0]]]
            start = match.end()
        return b"".join(parts) + self.between(text[start:])

    def between(self, text: str) -> bytes:
        """Ids of a text without added tokens."""
        if _RUNS.search(text):
            return self.whole(text)
        first, *words = text.replace("\n", " \n").split(" ")
        parts = list(map(self.words.get, words))
        unknown = [part is None for part in parts]
        if any(unknown):
            missing = list(compress(words, unknown))
            spelled = [word if word.startswith("\n") else " " + word for word in missing]
            ids = np.array(self.encoding.encode_ordinary("".join(spelled)), "<u4")
            ends = np.cumsum([len(s.encode()) for s in spelled])
            cuts = (np.searchsorted(np.cumsum(self.sizes[ids]), ends) + 1) * 4
            packed, start = ids.tobytes(), 0
            found = []
            for end in cuts.tolist():
                found.append(packed[start:end])
                start = end
            own = iter(found)
            parts = [next(own) if part is None else part for part in parts]
            if len(self.words) < self.limit:
                self.words.update((w, f) for w, f in zip(missing, found, strict=True) if len(w) <= self.longest)
        return (self.whole(first) if first else b"") + b"".join(parts)


_ENCODERS: dict[tuple[str, str], PackedEncoder] = {}


def encoder(path: str, pattern: str) -> PackedEncoder:
    """One encoder for each worker process."""
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = PackedEncoder(path, pattern)
    return _ENCODERS[path, pattern]
