"""Words and hashed word shingles of whole texts."""

from __future__ import annotations

import numpy as np
import xxhash

MEMO = 1 << 20
ONE, TWO = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class WordHashes(dict):
    """64-bit hash of each word, kept for words met again; emptied when it holds 2^20 words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def words_of(text: bytes) -> list[bytes]:
    """A-Z in lower case, split at blank, tab, line feed, vertical tab, form feed and carriage return."""
    return text.lower().split()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * TWO
    x = (x ^ (x >> np.uint64(32))) * TWO
    return x ^ (x >> np.uint64(32))


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash for each run of k words; shorter texts give one hash of all their words, empty texts none."""
    n = len(hashes)
    if n == 0:
        return hashes
    size = min(k, n)
    out = np.full(n - size + 1, np.uint64(size))
    for i in range(size):
        out = mixed(out * ONE + hashes[i : n - size + 1 + i])
    return out


def shingle_set(hashes: np.ndarray, k: int) -> np.ndarray:
    return np.unique(windows(hashes, k))
