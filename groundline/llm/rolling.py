"""Hashes of stretches of a sequence, from prefix sums: polynomials modulo 2**64, mixed.

Two stretches of equal content have equal hashes wherever they stand. Of m different
stretches, two have one 64-bit hash with a probability of about m²/2^65, taking hashes as
random.
"""

from __future__ import annotations

import numpy as np

_rng = np.random.default_rng(20240607)
_M1, _M2 = (np.uint64(int(x) | 1) for x in _rng.integers(1 << 62, 1 << 63, 2))
_BASES = [np.uint64(int(x) | 1) for x in _rng.integers(1 << 62, 1 << 63, 3)]
_SALTS = [np.uint64(int(x) | 1) for x in _rng.integers(1 << 62, 1 << 63, 3)]
#: Powers are products of two from short tables (of one step, of ``STEP`` steps), so that no long table stays in a worker.
STEP = 1 << 12


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x *= _M1
    x ^= x >> np.uint64(29)
    x *= _M2
    x ^= x >> np.uint64(32)
    return x


class _Powers:
    """Powers 0 to n of a number modulo 2**64."""

    def __init__(self, x: np.uint64, n: int):
        run = lambda y, m: np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(m, y, np.uint64)]))
        self.one = run(x, STEP - 1)
        self.many = run(np.uint64(pow(int(x), STEP, 1 << 64)), n // STEP)

    def first(self, n: int) -> np.ndarray:
        return (self.many[:, None] * self.one).ravel()[:n]

    def at(self, k: np.ndarray) -> np.ndarray:
        return self.many[k // STEP] * self.one[k % STEP]


class Rolling:
    """Hashes of [start, end) of ``values`` by base ``k``."""

    def __init__(self, values: np.ndarray, k: int):
        n = len(values)
        self.ahead = _Powers(_BASES[k], n)
        self.salt = _SALTS[k]
        self.total = np.zeros(n + 1, np.uint64)
        weighed = _Powers(np.uint64(pow(int(_BASES[k]), -1, 1 << 64)), n).first(n)
        weighed *= values
        np.cumsum(weighed, out=self.total[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.total[end] - self.total[start]) * self.ahead.at(start) + (end - start).astype(np.uint64) * self.salt)


def slid(x: np.ndarray, n: int, pick) -> np.ndarray:
    """pick (minimum, maximum) over every n neighbours."""
    if len(x) < n:
        return x[:0]
    k = 1
    while k * 2 <= n:
        x = pick(x[:-k], x[k:])
        k *= 2
    return pick(x[: len(x) - (n - k)], x[n - k :]) if n > k else x
