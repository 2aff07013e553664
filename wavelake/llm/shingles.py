"""Words and word shingles as 64-bit numbers, the same in every process."""

from __future__ import annotations

import numpy as np
import pandas as pd

GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[str]) -> np.ndarray:
    if not words:
        return np.zeros(0, np.uint64)
    cells = np.empty(len(words), object)
    cells[:] = words
    return pd.util.hash_array(cells, categorize=False)


def kmers(words: np.ndarray, k: int) -> np.ndarray:
    """The number of each run of k words; of all of them if there are fewer."""
    n = len(words)
    if not n:
        return words
    k = min(k, n)
    with np.errstate(over="ignore"):
        out = np.zeros(n - k + 1, np.uint64)
        for j in range(k):
            out = out * GOLD + words[j : n - k + 1 + j]
        return mix(out)
