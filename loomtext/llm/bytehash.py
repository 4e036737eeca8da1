"""Hashes of byte strings from prefix sums, in numpy.

With sums[i] the sum of r[b[j]] * BASE^j over j < i, the string from s to e has
the hash mixed((sums[e] - sums[s]) * BASE^-s), all modulo 2^64. So any number
of substrings are hashed at a few operations each.
"""

from __future__ import annotations

import numpy as np

_rng = np.random.default_rng(5190)
BYTES = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE, BASE_INV = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers (at least) of BASE and of its inverse."""
    if not _powers or len(_powers[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        _powers[:] = [np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, b, np.uint64))]) for b in (BASE, BASE_INV)]
    return _powers[0], _powers[1]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTES[data] * powers(len(data) or 1)[0][: len(data)], dtype=np.uint64)])


def substring_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mixed((sums[ends] - sums[starts]) * powers(len(sums))[1][starts])
