"""Hashes of words and of windows of words, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

#: Words remembered by a Python worker, and the longest word that is.
CACHE_WORDS, CACHE_CHARS = 100_000, 64
ODD = np.uint64(0x9E3779B97F4A7C15)


def hash64(data: bytes, seed: int = 0) -> int:
    return xxhash.xxh64_intdigest(data, seed)


class WordHashes(dict):
    """64-bit hash of a word; words met before are remembered up to a bound."""

    def __missing__(self, word: str) -> int:
        value = hash64(word.encode("utf-8", "surrogatepass"))
        if len(self) < CACHE_WORDS and len(word) <= CACHE_CHARS:
            self[word] = value
        return value


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * ODD
    return x ^ (x >> np.uint64(29))


def windows(tokens: np.ndarray, width: int) -> np.ndarray:
    """Hash of each window of ``width`` token hashes, in order; none if there are fewer tokens."""
    n = len(tokens) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        out = out * ODD + tokens[k : k + n]
    return mix(out)


def shingles(text: str, words: WordHashes, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the word windows of a text, in lower case.

    A text of fewer words is one shingle of them all, one without words has none.
    """
    own = text.lower().split()
    tokens = np.fromiter(map(words.__getitem__, own), dtype=np.uint64, count=len(own))
    if 0 < len(tokens) < width:
        return windows(tokens, len(tokens))
    return np.unique(windows(tokens, width))
