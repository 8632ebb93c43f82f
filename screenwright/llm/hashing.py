"""Numpy hashes of stretches of a text, the same in every process."""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Stretches:
    """Hashes of any stretch of a byte string: differences of prefix sums of byte values times powers of a base."""

    def __init__(self, data: bytes) -> None:
        n = len(data)
        powers = np.empty(n + 1, np.uint64)
        powers[0] = 1
        powers[1:] = _BASE
        with np.errstate(over="ignore"):
            np.multiply.accumulate(powers, out=powers)
            values = mixed(np.arange(256, dtype=np.uint64) + np.uint64(1))[np.frombuffer(data, np.uint8)]
            self.sums = np.zeros(n + 1, np.uint64)
            np.cumsum(values * powers[:n], out=self.sums[1:])
            powers[1:] = _INVERSE
            powers[0] = 1
            np.multiply.accumulate(powers, out=powers)
        self.inverse = powers

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mixed((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))


def word_bounds(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a byte string in which single spaces or line ends separate words."""
    if not data:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    raw = np.frombuffer(data, np.uint8)
    gaps = np.flatnonzero((raw == 32) | (raw == 10))
    return np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(data)]])
