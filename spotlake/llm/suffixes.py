"""Suffix order of a bounded text as numpy columns: ranks of ever longer strings, and longest common prefixes from them."""

from __future__ import annotations

import numpy as np


def _dense(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, dense rank) of integers."""
    order = np.argsort(values)
    by = values[order]
    rank = np.empty(len(values), np.int64)
    rank[order] = np.cumsum(np.concatenate([[0], (by[1:] != by[:-1]).astype(np.int64)]))
    return order, rank


def _ahead(values: np.ndarray, by: int) -> np.ndarray:
    """The value ``by`` places on, 0 past the end (values start at 1)."""
    out = np.zeros_like(values)
    if by < len(values):
        out[: len(values) - by] = values[by:]
    return out


class Suffixes:
    """The suffixes of a sequence of codes in the order of their first ``depth`` values, at least."""

    def __init__(self, codes: np.ndarray, depth: int):
        _, self.codes = _dense(codes)
        self.codes += 1
        bits = int(self.codes.max(initial=1)).bit_length()
        size = 63 // bits
        packed = np.zeros(len(codes), np.int64)
        for i in range(size):
            packed = (packed << bits) | _ahead(self.codes, i)
        self.order, rank = _dense(packed)
        self.levels = [(size, rank + 1)]
        while size < depth and len(rank) and rank.max() + 1 < len(rank):
            one = rank + 1
            base = int(one.max()) + 1
            times = 3 if base < 1 << 20 else 2
            joined = np.zeros(len(one), np.int64)
            for i in range(times):
                joined = joined * base + _ahead(one, i * size)
            size *= times
            self.order, rank = _dense(joined)
            self.levels.append((size, rank + 1))

    def common(self, a: np.ndarray, b: np.ndarray, least: int) -> np.ndarray:
        """Length of the common prefix of the suffixes at a and b (not equal); exact where it is ``least`` or more.

        It counts in whole suffixes: strings that reach the end of the sequence together are not told apart from it.
        """
        n = len(self.codes)
        length = np.zeros(len(a), np.int64)
        for at, (size, rank) in reversed(list(enumerate(self.levels))):
            below = self.levels[at + 1][0] // size - 1 if at + 1 < len(self.levels) else 1
            for _ in range(below):
                i, j = a + length, b + length
                same = (i < n) & (j < n) & (rank[np.minimum(i, n - 1)] == rank[np.minimum(j, n - 1)])
                length[same] += size
        rest = np.flatnonzero(length + self.levels[0][0] > least)
        for _ in range(self.levels[0][0] - 1):
            i, j = a[rest] + length[rest], b[rest] + length[rest]
            same = (i < n) & (j < n)
            same &= self.codes[np.minimum(i, n - 1)] == self.codes[np.minimum(j, n - 1)]
            rest = rest[same]
            length[rest] += 1
        return length
