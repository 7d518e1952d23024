"""Word shingles and MinHash over many texts at once."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd

#: A word for near-duplicate work: letters, digits and underscores, in lower case.
WORD = re.compile(r"\w+")
K = 5


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def hashed(parts: list[str]) -> np.ndarray:
    """64-bit hashes of words; the same in every process."""
    return pd.util.hash_array(np.array(parts, dtype=object), categorize=False) if parts else np.zeros(0, dtype=np.uint64)


def odd(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


class Shingles:
    """The hashed shingles of several texts, one text after another; texts of fewer than K words have none."""

    def __init__(self, texts: list[list[str]]):
        n = np.array([len(t) for t in texts], dtype=np.int64)
        h = hashed([w for t in texts for w in t])
        coefficients = odd(11, K)
        if len(h) >= K:
            s = sum(h[j : len(h) - K + 1 + j] * coefficients[j] for j in range(K))
        else:
            s = np.zeros(0, dtype=np.uint64)
        starts = np.cumsum(n) - n
        self.n = np.maximum(n - K + 1, 0)
        self.starts = np.cumsum(self.n) - self.n
        keep = np.repeat(starts - self.starts, self.n) + np.arange(self.n.sum())
        self.h = mixed(s[keep])

    def of(self, k: int) -> np.ndarray:
        return self.h[self.starts[k] : self.starts[k] + self.n[k]]


def multipliers(n: int, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    return odd(seed, n), odd(seed + 1, n)


def signatures(s: Shingles, n_hashes: int) -> np.ndarray:
    """(texts that have shingles, n_hashes)."""
    at = s.starts[s.n > 0]
    out = np.empty((len(at), n_hashes), dtype=np.uint64)
    for j, (a, b) in enumerate(zip(*multipliers(n_hashes), strict=True)):
        out[:, j] = np.minimum.reduceat(s.h * a + b, at) if len(at) else 0
    return out


def chunks(texts: list[str], most: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` characters; a longer text is a range of its own."""
    start = size = 0
    for k, t in enumerate(texts):
        if size and size + len(t) > most:
            yield start, k
            start, size = k, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)
