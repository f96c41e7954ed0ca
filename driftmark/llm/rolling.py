"""Vectorised hashes of all k-byte (or k-word) windows, and minima over windows."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values, so that any of their bits may be used alone."""
    values = values ^ (values >> np.uint64(33))
    values = values * np.uint64(0xFF51AFD7ED558CCD)
    values ^= values >> np.uint64(29)
    values *= np.uint64(0xC4CEB9FE1A85EC53)
    values ^= values >> np.uint64(32)
    return values


def windows(units: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Mixed polynomial hashes of the k units from each position; len(units) - k + 1 of them.

    Windows of doubling lengths are joined, so the work is in proportion to log k.
    """
    if len(units) < k:
        return np.empty(0, np.uint64)
    level = units.astype(np.uint64) + np.uint64(1 + seed)
    size, base, out, have = 1, _BASE, None, 0
    rest = k
    while True:
        if rest & 1:
            if out is None:
                out, have = level, size
            else:
                n = len(level) - have
                out = out[:n] * np.uint64(base) + level[have : have + n]
                have += size
        rest >>= 1
        if not rest:
            return mixed(out[: len(units) - k + 1])
        level = level[:-size] * np.uint64(base) + level[size:]
        base, size = base * base & _MASK, size * 2


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each width values in a row; len(values) - width + 1 of them."""
    if len(values) < width:
        return np.empty(0, values.dtype)
    size, level = 1, values
    while size * 2 <= width:
        level = np.minimum(level[:-size], level[size:])
        size *= 2
    n = len(values) - width + 1
    return np.minimum(level[:n], level[width - size : width - size + n])
