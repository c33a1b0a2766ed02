"""Similarity sketches with rounds of hashed bin placement.

Each of the first t rounds throws every element of a set into one random bin;
a bin keeps its least value, and values of later rounds are greater than those
of earlier ones.  Round t + j throws all elements into bin j, so that after 2t
rounds no bin of a non-empty set can be empty.  A set whose bins are all filled
takes no further part; a set of n elements needs about t ln(t) / n rounds.
Two sets agree in a coordinate with a probability equal to their Jaccard
similarity, with the concentration of sampling without replacement.
"""

from __future__ import annotations

import numpy as np

from .hashing import U64, mix64, seeds

EMPTY = np.iinfo(np.uint64).max


def sketch(elements: np.ndarray, counts: np.ndarray, t: int, salt: int = 1) -> np.ndarray:
    """The t coordinates of each set, one row per set; rows of empty sets hold EMPTY.

    ``elements`` holds the distinct 64-bit elements of all sets in sequence,
    ``counts`` the number of elements of each set.
    """
    n = len(counts)
    out = np.full((n, t), EMPTY, np.uint64)
    flat = out.reshape(-1)
    live = np.flatnonzero(counts)
    owner = np.repeat(np.arange(n), counts)
    round_seeds = seeds(2 * t, salt)
    for r in range(2 * t):
        if not len(live):
            break
        h = mix64(elements ^ round_seeds[r])
        value = (h & U64(0xFFFFFFFF)) | U64(r << 32)
        bins = ((h >> U64(32)) * U64(t) >> U64(32)).astype(np.int64) if r < t else r - t
        np.minimum.at(flat, owner * t + bins, value)
        done = (out[live] != EMPTY).all(axis=1)
        if done.any():
            live = live[~done]
            open_ = np.zeros(n, bool)
            open_[live] = True
            keep = open_[owner]
            elements, owner = elements[keep], owner[keep]
    return out


def band_keys(coordinates: np.ndarray, rows: int) -> np.ndarray:
    """A signed 64-bit key for each band of ``rows`` coordinates; the number of the band goes into it."""
    n, t = coordinates.shape
    bands = coordinates[:, : t // rows * rows].reshape(n, t // rows, rows)
    key = np.broadcast_to(seeds(t // rows, 13), bands.shape[:2])
    for i, s in enumerate(seeds(rows, 11) | U64(1)):
        key = mix64((key ^ bands[:, :, i]) * s)
    return key.view(np.int64)
