"""Whole numbers of any size from doubles, and what of them fits into doubles."""

from __future__ import annotations

import numpy as np

BIG_KEY = 288  # bytes; a sum of products of scaled doubles has fewer than 2,100 bits and a few for their number


def whole(values, scale: int, big: bool) -> np.ndarray:
    """floor(scale * x), exactly: as 64-bit numbers, or as Python integers (a double from 2^53 on is an integer)."""
    x = np.asarray(values, np.float64)
    if not big:
        return np.floor(x * scale).astype(np.int64)
    return np.array([int(v) * scale if abs(v) >= 2.0**53 else int(np.floor(v * scale)) for v in x.tolist()], object)


def as_float(value) -> float:
    """The nearest double; integers beyond their range become infinite."""
    try:
        return float(value)
    except OverflowError:
        return np.inf if value > 0 else -np.inf


def as_floats(values: np.ndarray) -> np.ndarray:
    if values.dtype != object:
        return values.astype(np.float64)
    return np.array([as_float(v) for v in values.ravel().tolist()], np.float64).reshape(values.shape)


def key_of(score, size: int) -> bytes:
    """A number as `size` bytes that sort as numbers do."""
    return (int(score) + (1 << (8 * size - 1))).to_bytes(size, "big")


def number_of(key: bytes) -> int:
    return int.from_bytes(key, "big") - (1 << (8 * len(key) - 1))


def clipped(number: int) -> int:
    """The nearest 64-bit number."""
    return max(-(2**63), min(2**63 - 1, number))
