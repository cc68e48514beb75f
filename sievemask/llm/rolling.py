"""Rolling fingerprints: prefix polynomials modulo 2^64, from which the hash of any stretch of values is two reads and a product."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from sievemask.llm.common import mixed

BASE = 0x9E3779B97F4A7C15
SHARED = 20  # prefixes of fewer than 2^20 values share one table of powers, whatever their number
BYTE_VALUES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(size, BASE, np.uint64), np.full(size, pow(BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


class Prefixes:
    """Prefix polynomials of 64-bit values."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        up, self._down = _powers(1 << max(SHARED, int(n).bit_length()))
        self._sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * up[:n], out=self._sums[1:])

    def stretches(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A hash of each stretch [start, end), wherever it stands."""
        lengths = np.asarray(ends - starts).astype(np.uint64)
        return mixed((self._sums[ends] - self._sums[starts]) * self._down[starts] + lengths)

    def windows(self, width: int) -> np.ndarray:
        """A hash of each stretch of `width` values."""
        count = max(0, len(self._sums) - width)
        return mixed((self._sums[width:] - self._sums[:count]) * self._down[:count] + np.uint64(width))


def leftmost_minima(values: np.ndarray, width: int) -> np.ndarray:
    """For each window of `width` values the place of its least value, the leftmost of equal ones; values count by their high bits, those
    above the bits that a place needs."""
    n = len(values)
    count = n - width + 1
    if count <= 0:
        return np.zeros(0, np.int64)
    mask = np.uint64((1 << max(1, int(n).bit_length())) - 1)
    ranked = (values & ~mask) | np.arange(n, dtype=np.uint64)
    blocks = -(-n // width)
    grid = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    grid[:n] = ranked
    grid = grid.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(behind[:count], ahead[width - 1 : width - 1 + count]) & mask).astype(np.int64)
