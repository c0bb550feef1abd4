"""Words and shingles as arrays of 64-bit hashes (inside tasks)."""

from __future__ import annotations

import numpy as np
import xxhash

from thicket.llm.common import LONG, Memo, claim, mix64

ROOM = 48 << 20  # bytes


class WordHashes(dict):
    """A memo, bounded by bytes, of 64-bit hashes of words: what lies between white space (space and 0x09 to 0x0D, as bytes.split() has it)."""

    used = 0

    def __init__(self):
        super().__init__()
        claim("words")

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= LONG:
            self[word] = h
            self.used += len(word) + Memo.ENTRY
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        if self.used > ROOM:
            self.clear()
            self.used = 0
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def _multiplier(j: int) -> np.uint64:
    return np.uint64(mix64(np.array([j + 1], np.uint64))[0] | np.uint64(1))


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of every ``n`` consecutive words; of fewer words, one hash of the whole sequence."""
    if not len(h):
        return h
    with np.errstate(over="ignore"):
        if len(h) < n:
            total = np.uint64(len(h))
            for j, x in enumerate(h):
                total = total + x * _multiplier(1000 + j)
            return mix64(np.array([total], np.uint64))
        out = np.zeros(len(h) - n + 1, np.uint64)
        for j in range(n):
            out += h[j : len(h) - n + 1 + j] * _multiplier(j)
    return mix64(out)
