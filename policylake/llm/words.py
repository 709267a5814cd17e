"""Words and hashes shared by the operators of this subpackage."""

from __future__ import annotations

import re

import numpy as np
import xxhash

WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    """Runs of letters and digits, lower-cased."""
    return WORD.findall(text.lower())


class WordHashes(dict):
    """64-bit hashes of words, the same in every process; emptied when it holds a million."""

    def __missing__(self, w: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        h = xxhash.xxh3_64_intdigest(w)
        self[w] = h
        return h

    def array(self, ws: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, ws), np.uint64, len(ws))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(h: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct 32-bit fingerprints of the runs of ``n`` words whose hashes are ``h``."""
    m = len(h) - n + 1
    if m <= 0:
        return np.empty(0, np.uint32)
    x = np.zeros(m, np.uint64)
    for i in range(n):
        x = mix(x * np.uint64(0x9E3779B97F4A7C15) + h[i : i + m])
    return np.unique((x >> np.uint64(32)).astype(np.uint32))
