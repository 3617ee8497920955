"""Word helpers shared by the operators.

``word_lists`` runs inside tasks on Arrow batches: bytes.lower() changes A-Z only and
bytes.split() splits at 0x20 and 0x09-0x0D, which is what the contracts ask for.
"""
from __future__ import annotations

import numpy as np
import xxhash

U64 = np.uint64


class WordHash(dict):
    """word (bytes) -> 64-bit hash, remembered while the task runs (bounded)."""

    def __init__(self, seed: int = 0, limit: int = 300_000):
        super().__init__()
        self.seed, self.limit = seed, limit

    def __missing__(self, w: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[w] = xxhash.xxh3_64_intdigest(w, self.seed)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), U64, len(words))


def word_list(text: bytes | None) -> list[bytes]:
    """Words of a whole text, A-Z lower-cased; none for null."""
    return text.lower().split() if text else []


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective mixing of 64-bit values."""
    x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


def odd_multipliers(n: int, seed: int) -> np.ndarray:
    """n fixed odd 64-bit numbers."""
    return mix64(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed)) | U64(1)


def shingle_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k words, one per position; the whole sequence as one when
    there are fewer words; empty when there is none."""
    if len(h) == 0:
        return h
    if len(h) < k:
        m = odd_multipliers(len(h), 77)
        return mix64(np.array([(h * m).sum(dtype=U64) + U64(len(h))], U64))
    m = odd_multipliers(k, 5)
    n = len(h) - k + 1
    out = np.zeros(n, U64)
    for i in range(k):
        out += h[i:i + n] * m[i]
    return mix64(out)
