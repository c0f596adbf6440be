"""Array hashing of bytes: polynomials modulo 2^64 over random byte values, as prefix sums."""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
#: Random 64-bit values of the byte values.
VALUES = np.random.default_rng(40_427).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


class Powers:
    """Powers of the base and of its inverse, made as far as needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, b, np.uint64)])) for b in (BASE, INVERSE))
        return self.up[:n], self.down[:n]


POWERS = Powers()


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Prefix sums (one more than bytes): the hash of data[i:j] is ``between(prefix, i, j)``."""
    up, _ = POWERS.reach(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(VALUES[data] * up[: len(data)], out=out[1:])
    return out


def between(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the ranges [start, end), the same for equal bytes wherever they stand."""
    _, down = POWERS.reach(len(prefix))
    return (prefix[end] - prefix[start]) * down[start]


def roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest number in the component of each of n nodes, by the edges (left, right)."""
    label = np.arange(n)
    while len(left):
        a, b = label[left], label[right]
        low = np.minimum(a, b)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while True:
            shorter = label[label]
            if (shorter == label).all():
                break
            label = shorter
        live = label[left] != label[right]
        left, right = left[live], right[live]
    return label
