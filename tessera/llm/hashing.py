"""64-bit hashing of words, shingles and sets, on NumPy arrays."""

from __future__ import annotations

import re

import numpy as np
import xxhash

WORD = re.compile(r"[^\W_]+")
U64 = np.uint64
_STEP, _A, _B = U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x + _STEP
    x = (x ^ (x >> U64(30))) * _A
    x = (x ^ (x >> U64(27))) * _B
    return x ^ (x >> U64(31))


def seeds(n: int, salt: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers."""
    with np.errstate(over="ignore"):
        return mix64(np.arange(1, n + 1, dtype=np.uint64) * _B + U64(salt))


class TokenHashes(dict):
    """Token to 64-bit hash, remembered while there are fewer than ``room`` tokens."""

    def __init__(self, room: int = 200_000):
        super().__init__()
        self.room = room

    def __missing__(self, token: str) -> int:
        if len(self) >= self.room:
            self.clear()
        self[token] = h = xxhash.xxh3_64_intdigest(token.encode("utf-8", "surrogatepass"))
        return h


def words(text: str) -> list[str]:
    """Maximal runs of letters and digits of the lower-cased text."""
    return WORD.findall(text.lower())


def runs(hashes: np.ndarray, lengths: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k consecutive tokens that stay within one text, and the number of runs of each text.

    ``hashes`` holds the tokens of all texts in sequence, ``lengths`` the number of tokens of each.
    """
    counts = np.maximum(lengths - k + 1, 0)
    if not counts.sum():
        return np.empty(0, np.uint64), counts
    starts = np.cumsum(lengths) - lengths
    at = np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    out = np.zeros(len(at), np.uint64)
    for i, s in enumerate(seeds(k, 7) | U64(1)):
        out += mix64(hashes[at + i] ^ s) * s
    return mix64(out), counts
