"""A wavelet tree with vectorised range reporting."""

from __future__ import annotations

import numpy as np


class WaveletTree:
    """Numbers below 2 ** bits, level by level from the highest bit, in the layout that puts all left
    children of a level before all right ones. ``report`` answers many rectangles at once, in time
    of the levels times the rectangles and the numbers found."""

    def __init__(self, values: np.ndarray) -> None:
        self.bits = max(1, int(values.max(initial=0)).bit_length())
        self.ones: list[np.ndarray] = []
        for level in reversed(range(self.bits)):
            bit = (values >> level) & 1
            ones = np.zeros(len(values) + 1, np.int64)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            values = np.concatenate((values[bit == 0], values[bit == 1]))

    def report(self, lo: np.ndarray, hi: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All numbers v with low <= v < high at places lo to hi - 1, of each rectangle: (its number, v)."""
        query, node = np.arange(len(lo)), np.zeros(len(lo), np.int64)
        for level, ones in zip(reversed(range(self.bits)), self.ones):
            zeros = len(ones) - 1 - ones[-1]
            before, until = ones[lo], ones[hi]
            lo, hi = np.concatenate((lo - before, zeros + before)), np.concatenate((hi - until, zeros + until))
            query, node = np.concatenate((query, query)), np.concatenate((2 * node, 2 * node + 1))
            met = (lo < hi) & (node << level < high[query]) & ((node + 1) << level > low[query])
            lo, hi, query, node = lo[met], hi[met], query[met], node[met]
        return np.repeat(query, hi - lo), np.repeat(node, hi - lo)
