"""Rolling hashes of sequences as numpy columns: any window's hash in constant time from prefix sums modulo 2**64."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit words."""
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(31)
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base and of its inverse, kept for the next call."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        made = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        _powers = tuple(made)
    return _powers[0][:n], _powers[1][:n]


class Rolling:
    """Hashes of windows of a sequence of 64-bit values."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        up, self.down = powers(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * up[:n], out=self.sums[1:])

    def windows(self, length: int) -> np.ndarray:
        """Hash of every window of ``length`` values."""
        n = len(self.sums) - 1
        if length > n:
            return np.empty(0, np.uint64)
        return mix((self.sums[length:] - self.sums[: n - length + 1]) * self.down[: n - length + 1])

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of the values in [start, end), the length included."""
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least value of every ``width`` neighbours, from running minima of blocks forwards and backwards."""
    n = len(values)
    if n < width:
        return np.empty(0, values.dtype)
    full = np.concatenate([values, np.full(-n % width, np.iinfo(values.dtype).max, values.dtype)]).reshape(-1, width)
    ahead = np.minimum.accumulate(full, axis=1).ravel()
    back = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the runs of true values."""
    edges = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
