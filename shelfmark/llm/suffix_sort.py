"""Sorting of short suffixes by prefix hashes.

The hash of any stretch of a text follows from two prefix hashes, so the common beginning of two
suffixes is found by bisection. Mergesort with that comparison sorts them; all groups of suffixes
and all comparisons of a round are done by array operations.
"""

from __future__ import annotations

from functools import cache

import numpy as np

BASE = 0x9E3779B97F4A7C15
U = np.uint64


@cache
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i modulo 2^64 for i < n."""
    out = []
    for b in (BASE, pow(BASE, -1, 1 << 64)):
        p = np.full(n, b, U)
        p[0] = 1
        out.append(np.cumprod(p))
    return out[0], out[1]


def room(n: int) -> int:
    """Table sizes grow by doubling, so few are made."""
    return 1 << max(12, n.bit_length())


class Hashes:
    """Prefix hashes of one buffer of bytes."""

    def __init__(self, data: bytes | np.ndarray):
        self.data = np.frombuffer(data, np.uint8) if isinstance(data, bytes) else data
        n = len(self.data)
        power, self.inverse = powers(room(n + 1))
        self.sums = np.zeros(n + 1, U)
        np.cumsum((self.data.astype(U) + U(1)) * power[:n], out=self.sums[1:])

    def of(self, start, end) -> np.ndarray:
        """Hashes of data[start:end], mixed so that their order says nothing of the text."""
        h = (self.sums[end] - self.sums[start]) * self.inverse[start]
        h ^= h >> U(31)
        h *= U(0xBF58476D1CE4E5B9)
        return h ^ (h >> U(29))

    def common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Length, `most` at most, of the common beginning of the suffixes at a and at b."""
        low, high = np.zeros(len(a), np.int64), most.astype(np.int64)
        while (low < high).any():
            mid = (low + high + 1) >> 1
            same = self.of(a, a + mid) == self.of(b, b + mid)
            low, high = np.where(same, mid, low), np.where(same, high, np.maximum(mid - 1, low))
        return low


def mergesort(hashes: Hashes, at: np.ndarray, length: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Order of the suffixes data[at : at + length] within each group; `group` is ascending.

    Shorter before longer where one begins the other; equal ones stay in their order.
    """
    n = len(at)
    begin = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if n else np.zeros(0, np.int64)
    size = np.diff(np.r_[begin, n])
    first, of = np.repeat(begin, size), np.repeat(size, size)
    order, last = np.arange(n), len(hashes.data) - 1

    def before(x: np.ndarray, y: np.ndarray, ties: np.ndarray) -> np.ndarray:
        """Whether suffix y comes before x; where equal, `ties`."""
        shorter = np.minimum(length[x], length[y])
        same = hashes.common(at[x], at[y], shorter)
        inside = same < shorter
        less = hashes.data[np.minimum(at[y] + same, last)] < hashes.data[np.minimum(at[x] + same, last)]
        return np.where(inside, less, (length[y] < length[x]) | ((length[y] == length[x]) & ties))

    width = 1
    while n and width < size.max():
        moving = np.flatnonzero(of > width)
        place = moving - first[moving]
        run = place // width
        twin = (run ^ 1) * width
        other = np.clip(of[moving] - twin, 0, width)
        right = (run & 1).astype(bool)
        low, high = np.zeros(len(moving), np.int64), other.copy()
        while len(live := np.flatnonzero(low < high)):
            mid = (low[live] + high[live]) >> 1
            y = order[first[moving[live]] + twin[live] + mid]
            earlier = before(order[moving[live]], y, right[live])
            low[live] = np.where(earlier, mid + 1, low[live])
            high[live] = np.where(earlier, high[live], mid)
        target = first[moving] + (run >> 1) * 2 * width + place % width + low
        new = order.copy()
        new[target] = order[moving]
        order, width = new, 2 * width
    return order
