"""Suffix order of short texts by prefix polynomial hashes, in numpy.

Texts lie in one buffer. A prefix hash gives the hash of any piece in constant time, a
binary search over lengths the common extension of two positions, and the byte after it
their order. Sorting is a bottom-up mergesort inside groups: every element finds its rank
in the neighbouring run by binary search, all elements at once.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

SLICE = 1000
BASE = 0x9E3779B97F4A7C15 | 1


@lru_cache(maxsize=8)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i modulo 2^64, for i < n."""
    up = np.full(n, BASE, np.uint64)
    down = np.full(n, pow(BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def prefix_hashes(data: np.ndarray, up: np.ndarray) -> np.ndarray:
    """Sums of (byte + 1) * BASE^i before each position."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=out[1:])
    return out


class Texts:
    """Texts in one buffer, each with a mark; extensions are taken forward and backward from the marks."""

    def __init__(self, texts: list[bytes], marks: np.ndarray):
        self.buffer = b"".join(texts)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.start = np.cumsum(sizes) - sizes
        self.marks, self.at = marks, self.start + marks
        self.right, self.left = sizes - marks, marks.copy()
        data = np.frombuffer(self.buffer, np.uint8)
        self.data = np.concatenate((data, np.zeros(1, np.uint8)))
        n = 1 << int(max(sizes.max(initial=1), 1)).bit_length()
        up, self.down = powers(n)
        self.prefix = np.zeros(len(data) + 1, np.uint64)
        for a in range(0, len(texts), SLICE):  # eight bytes for each of the texts, and little besides
            own, from_ = sizes[a : a + SLICE], self.start[a : a + SLICE]
            lo, hi = int(from_[0]), int(from_[-1] + own[-1])
            local = np.arange(lo, hi) - np.repeat(from_, own)
            np.cumsum((data[lo:hi].astype(np.uint64) + np.uint64(1)) * up[local], out=self.prefix[lo + 1 : hi + 1])
            self.prefix[lo + 1 : hi + 1] += self.prefix[lo]

    def piece(self, i: np.ndarray, offset: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The hash of size bytes from offset before or after the marks of texts i."""
        a = self.at[i] + offset
        return (self.prefix[a + size] - self.prefix[a]) * self.down[self.marks[i] + offset]

    def extension(self, i: np.ndarray, j: np.ndarray, forward: bool) -> np.ndarray:
        """Bytes that texts i and j share from their marks on, or before them."""
        low = np.zeros(len(i), np.int64)
        high = np.minimum(self.right[i], self.right[j]) if forward else np.minimum(self.left[i], self.left[j])
        zero = np.zeros(len(i), np.int64)
        while (low < high).any():
            middle = (low + high + 1) >> 1
            offset = zero if forward else -middle
            same = self.piece(i, offset, middle) == self.piece(j, offset, middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low

    def before(self, i: np.ndarray, j: np.ndarray, forward: bool) -> np.ndarray:
        """Whether text i comes before text j; equal ones are in neither order."""
        n = self.extension(i, j, forward)
        own, other = (self.right, self.right) if forward else (self.left, self.left)
        ends_i, ends_j = n >= own[i], n >= other[j]
        step = n if forward else -n - 1
        a = self.data[np.where(ends_i, 0, self.at[i] + step)]
        b = self.data[np.where(ends_j, 0, self.at[j] + step)]
        return np.where(ends_i | ends_j, ends_i & ~ends_j, a < b)

    def order(self, first: np.ndarray, size: np.ndarray, forward: bool) -> np.ndarray:
        """Texts in suffix order inside each group; group g has texts first[g] to first[g] + size[g] - 1."""
        order = np.arange(len(self.at))
        start, total = np.repeat(first, size), np.repeat(size, size)
        local = np.arange(len(order)) - start
        width, most = 1, int(size.max(initial=0))
        while width < most:
            run = local // width
            other = run ^ 1
            low = start + np.minimum(other * width, total)
            high = start + np.minimum((other + 1) * width, total)
            base = low.copy()
            is_left = (run & 1) == 0
            # Of the other run: what is smaller, and for the right run also what is equal.
            while (active := np.flatnonzero(low < high)).size:
                middle = (low[active] + high[active]) >> 1
                mine, theirs = order[active], order[middle]
                left = is_left[active]
                ahead = np.empty(len(active), bool)
                ahead[left] = self.before(theirs[left], mine[left], forward)
                ahead[~left] = ~self.before(mine[~left], theirs[~left], forward)
                low[active] = np.where(ahead, middle + 1, low[active])
                high[active] = np.where(ahead, high[active], middle)
            place = start + (run & ~1) * width + (local - run * width) + (low - base)
            merged = np.empty_like(order)
            merged[place] = order
            order = merged
            width *= 2
        return order
