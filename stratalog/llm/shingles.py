"""Word shingles of whole texts as sorted sets of 64-bit hashes; the code that runs inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

_MASK = (1 << 64) - 1
_MIX = np.uint64(0xFF51AFD7ED558CCD)
#: Words whose hash a worker remembers; the memory is emptied when it is full.
REMEMBERED_WORDS = 200_000


def odd_numbers(seed: int, n: int) -> np.ndarray:
    """n odd 64-bit numbers that depend on the seed alone."""
    return np.array([xxhash.xxh3_64_intdigest(f"{seed}:{i}") | 1 for i in range(n)], np.uint64)


class WordHashes(dict):
    """Hash of a word (bytes), remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def window_hashes(h: np.ndarray, size: int, factors: np.ndarray) -> np.ndarray:
    """Hash of every window of ``size`` consecutive word hashes; of the whole sequence where it is shorter."""
    size = min(size, len(h))
    n = len(h) - size + 1
    acc = h[:n] * factors[0]
    for i in range(1, size):
        acc += h[i : i + n] * factors[i]
    acc ^= acc >> np.uint64(31)
    acc *= _MIX
    acc ^= acc >> np.uint64(29)
    return acc


def shingle_set(text: bytes | None, size: int, factors: np.ndarray, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct shingles of a text, A-Z lower-cased; empty for a text without words."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    return np.unique(window_hashes(h, size, factors))


class MinHash:
    """``n`` minhashes of a set, each kept to its upper 32 bits."""

    def __init__(self, n: int, seed: int) -> None:
        self.a, self.b = odd_numbers(seed, n)[:, None], odd_numbers(seed + 1, n)[:, None]

    def __call__(self, values: np.ndarray, block: int = 512) -> np.ndarray:
        least = np.full(len(self.a), _MASK, np.uint64)
        for i in range(0, len(values), block):
            np.minimum(least, (self.a * values[None, i : i + block] + self.b).min(axis=1), out=least)
        return (least >> np.uint64(32)).astype(np.uint32).view(np.int32)
