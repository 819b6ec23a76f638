"""HyperMinHash registers: a leading-zero count and mantissa bits per bucket.

Every element falls into ``REPLICAS`` buckets (drawn with replacement from ``m``), so small
sets fill the sketch too; a bucket keeps its smallest 32-bit value, compressed to six bits
of leading zeros and ten bits after the leading one.  Two compressed registers can agree by
chance, hence the collision correction in :func:`jaccard_estimate`.
"""

from __future__ import annotations

import numpy as np

from .hashing import _splitmix, mix

MANTISSA_BITS = 10
EMPTY = np.uint16(0xFFFF)
REPLICAS = 32
_MULT = np.array([_splitmix(5_000 + j) | 1 for j in range(REPLICAS)], np.uint64)
_ADD = np.array([_splitmix(9_000 + j) for j in range(REPLICAS)], np.uint64)
_NONE = np.uint32(0xFFFFFFFF)


def _minima(elements: np.ndarray, m: int) -> np.ndarray:
    low = np.full(m, _NONE, np.uint32)
    for at in range(0, len(elements), 1 << 14):
        y = elements[at : at + (1 << 14), None] * _MULT + _ADD
        bucket = ((y >> np.uint64(48)) * np.uint64(m)) >> np.uint64(16)
        value = ((y >> np.uint64(12)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        np.minimum.at(low, bucket.ravel().astype(np.intp), value.ravel())
    return low


def compress(low: np.ndarray) -> np.ndarray:
    """uint32 minima -> (leading zeros << 10 | mantissa) as uint16; empty stays apart."""
    v = low.astype(np.uint64)
    length = np.zeros(len(v), np.int64)
    some = v > 0
    length[some] = np.floor(np.log2(v[some].astype(np.float64))).astype(np.int64) + 1
    shift = length - 1 - MANTISSA_BITS
    tail = np.where(shift >= 0, v >> np.maximum(shift, 0).astype(np.uint64), v << np.maximum(-shift, 0).astype(np.uint64))
    out = ((32 - length) << MANTISSA_BITS | (tail & np.uint64((1 << MANTISSA_BITS) - 1)).astype(np.int64)).astype(np.uint16)
    out[low == _NONE] = EMPTY
    return out


def registers(elements: np.ndarray, m: int) -> np.ndarray:
    """The ``m`` compressed registers of one set of 64-bit hashes."""
    return compress(_minima(elements, m))


def band_keys(regs: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(band numbers, 64-bit keys) of the bands that hold at least one filled bucket."""
    bands = regs.reshape(-1, rows)
    acc = np.arange(len(bands), dtype=np.uint64) * np.uint64(_splitmix(77) | 1)
    for k in range(rows):
        acc += (bands[:, k].astype(np.uint64) + np.uint64(1)) * np.uint64(_splitmix(300 + k) | 1)
    filled = (bands != EMPTY).any(axis=1)
    return np.flatnonzero(filled), mix(acc)[filled]


def expected_collisions(n: np.ndarray, k: np.ndarray, m: int) -> np.ndarray:
    """Expected share of buckets where different minima compress to the same register.

    The closed approximation of the HyperMinHash paper: 0.1699 * 4 nk / (n + k)**2 / 2**r
    for loads n and k, r mantissa bits.
    """
    n, k = np.maximum(n, 1).astype(float), np.maximum(k, 1).astype(float)
    return 0.169919487159739 * 4 * n * k / (n + k) ** 2 / (1 << MANTISSA_BITS)


def jaccard_estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Collision-corrected Jaccard estimates of the rows of two register matrices."""
    filled = (a != EMPTY) | (b != EMPTY)
    same = ((a == b) & filled).sum(axis=1)
    share = same / np.maximum(filled.sum(axis=1), 1)
    chance = expected_collisions(n, k, a.shape[1])
    return np.clip((share - chance) / (1 - chance), 0, 1)
