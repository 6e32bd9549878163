"""Token counts and positions under a public tokenizer's byte-level vocabulary.

The vocabulary file's path is a parameter of every operator; it is read where
it lies, on each executor, and never copied.  Text between a non-space and a space can be encoded
by itself, since no token of the split pattern goes across, so counts of the
repeated pieces are remembered.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np
import tiktoken

#: How byte-level vocabularies of this family split text (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_PIECE = re.compile(r"\s*\S+|\s+")


class Counter(dict):
    LIMIT = 500_000

    def __init__(self, vocabulary: str) -> None:
        super().__init__()
        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("byte_level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.widths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.widths[rank] = len(token)

    def __missing__(self, piece: str) -> int:
        n = len(self.encoding.encode_ordinary(piece))
        if len(piece) <= 40:
            if len(self) >= self.LIMIT:
                self.clear()
            self[piece] = n
        return n

    def count(self, text: str | None) -> int:
        return sum(map(self.__getitem__, _PIECE.findall(text))) if text else 0

    def encode(self, text: str) -> list[int]:
        return self.encoding.encode_ordinary(text)


@lru_cache(maxsize=2)
def counter(vocabulary: str) -> Counter:
    return Counter(vocabulary)
