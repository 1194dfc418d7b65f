"""Vectorised hashes of byte ranges.

One running sum of ``value(byte) * B ** position`` (modulo 2**64) gives the hash of any range by two
look-ups, independent of where the range lies; ``mix`` spreads the bits.
"""

from __future__ import annotations

import numpy as np

_B = 0x9E3779B97F4A7C15
_VALUE = np.random.default_rng(2024).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_up = np.ones(1, np.uint64)
_down = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _up, _down
    if len(_up) < n:
        n = max(n, 1 << 21)
        up, down = np.full(n, _B, np.uint64), np.full(n, pow(_B, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _up, _down = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _up, _down


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


class RangeHash:
    """``h(a, b)``: hashes of ``data[a:b]`` for arrays of range ends."""

    def __init__(self, data: np.ndarray):
        up, self.down = _powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_VALUE[data] * up[: len(data)], out=self.sums[1:])

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((self.sums[b] - self.sums[a]) * self.down[a] + (b - a).astype(np.uint64))

    def rolling(self, k: int) -> np.ndarray:
        """Hashes of all ranges of ``k`` bytes."""
        return mix((self.sums[k:] - self.sums[:-k]) * self.down[: len(self.sums) - k])


def window_min(x: np.ndarray, w: int) -> np.ndarray:
    """Smallest of every ``w`` neighbours, by doubling."""
    k = 1
    while 2 * k <= w:
        x = np.minimum(x[:-k], x[k:])
        k *= 2
    return np.minimum(x[: len(x) - (w - k)], x[w - k :]) if k < w else x
