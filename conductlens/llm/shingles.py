"""Word shingles as 64-bit hashes, for Arrow batches inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)  # fixed values of a public 64-bit finaliser
STEP = np.uint64(0x9E3779B97F4A7C15)
CACHE_WORDS = 500_000


class WordHashes(dict):
    """word bytes -> 64-bit hash; emptied when it holds CACHE_WORDS words, so memory stays bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX_A
    x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, width: int, cache: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles; A-Z lower-cased, words split at ASCII white space.

    A text of fewer than ``width`` words is one shingle; without words the set is empty.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(cache.__getitem__, words), np.uint64, n)
    w = min(width, n)
    out = np.full(n - w + 1, np.uint64(w), np.uint64)
    for k in range(w):
        out = mix(out * STEP + h[k : n - w + 1 + k])
    out.sort()
    if len(out) > 1:
        out = out[np.concatenate(([True], out[1:] != out[:-1]))]
    return out
