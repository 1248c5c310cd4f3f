"""Elias-Fano coding of monotone sequences in numpy, with vectorised access and successor search.

A sequence of ``n`` values below ``u`` keeps ``log2(u / n)`` low bits of each value packed, and the
high parts in unary in a bit vector with counts per 64-bit word. All arrays can be views of a memory
map.
"""

from __future__ import annotations

import numpy as np

_ONE = np.uint64(1)


def _select_in_word(word: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the k-th (from 0) set bit of every word."""
    place = np.zeros(len(word), np.int64)
    word, k = word.copy(), k.copy()
    for width in (32, 16, 8, 4, 2, 1):
        low = word & np.uint64((1 << width) - 1)
        count = np.bitwise_count(low).astype(np.int64)
        up = k >= count
        k -= np.where(up, count, 0)
        place += np.where(up, width, 0)
        word = np.where(up, word >> np.uint64(width), low)
    return place


class EliasFano:
    """``parts`` are the arrays to store; ``meta`` is what is needed to read them."""

    def __init__(self, n: int, low_bits: int, lows: np.ndarray, highs: np.ndarray, ones: np.ndarray):
        self.n, self.low_bits, self.lows, self.highs, self.ones = n, low_bits, lows, highs, ones
        # Zeros before each word, for selecting zeros.
        self.zeros = np.arange(len(highs) + 1, dtype=np.int64) * 64 - ones.astype(np.int64)

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        """From a non-decreasing array of non-negative whole numbers."""
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) + 1 if n else 1
        bits = max(0, int(np.floor(np.log2(top / n)))) if n else 0
        shift = np.uint64(bits)
        highs = (values >> shift).astype(np.int64)
        length = (int(highs[-1]) if n else 0) + n + 2
        vector = np.zeros(-(-length // 64) + 1, np.uint64)
        at = highs + np.arange(n)
        np.bitwise_or.at(vector, at >> 6, _ONE << (at & 63).astype(np.uint64))
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(vector))]).astype(np.uint32)
        lows = np.zeros(n * bits // 64 + 2, np.uint64)
        if bits:
            low = values & np.uint64((1 << bits) - 1)
            start = np.arange(n, dtype=np.int64) * bits
            off = (start & 63).astype(np.uint64)
            np.bitwise_or.at(lows, start >> 6, low << off)
            over = (start & 63) + bits > 64
            np.bitwise_or.at(lows, (start[over] >> 6) + 1, low[over] >> (np.uint64(64) - off[over]))
        return cls(n, bits, lows, vector, ones)

    @property
    def meta(self) -> tuple[int, int]:
        return self.n, self.low_bits

    @property
    def parts(self) -> list[np.ndarray]:
        return [self.lows, self.highs, self.ones]

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        start = i * self.low_bits
        off = (start & 63).astype(np.uint64)
        word = self.lows[start >> 6] >> off
        spare = (np.uint64(64) - off) & np.uint64(63)
        above = np.where(off > 0, self.lows[(start >> 6) + 1] << spare, np.uint64(0))
        return (word | above) & np.uint64((1 << self.low_bits) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        """Values at places ``i`` (0 <= i < n)."""
        i = np.asarray(i, np.int64)
        word = np.searchsorted(self.ones, i, "right") - 1
        place = word * 64 + _select_in_word(self.highs[word], i - self.ones[word].astype(np.int64))
        return ((place - i).astype(np.uint64) << np.uint64(self.low_bits)) | self._low(i)

    def _bucket_start(self, high: np.ndarray) -> np.ndarray:
        """How many values have a smaller high part."""
        out = np.zeros(len(high), np.int64)
        some = high > 0
        k = high[some] - 1  # behind the k-th zero
        beyond = k >= self.zeros[-1]
        k = np.minimum(k, max(int(self.zeros[-1]) - 1, 0))
        word = np.searchsorted(self.zeros, k, "right") - 1
        place = word * 64 + _select_in_word(~self.highs[word], k - self.zeros[word])
        out[some] = np.where(beyond, self.n, np.minimum(place - k, self.n))
        return out

    def successor(self, x: np.ndarray) -> np.ndarray:
        """First place whose value is at least ``x``, ``n`` if there is none."""
        x = np.asarray(x, np.uint64)
        high = (x >> np.uint64(self.low_bits)).astype(np.int64)
        lo, hi = self._bucket_start(high), self._bucket_start(high + 1)
        want = x & np.uint64((1 << self.low_bits) - 1)
        while True:  # binary search of all buckets at once
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                return lo
            mid = (lo[open_] + hi[open_]) >> 1
            less = self._low(mid) < want[open_]
            lo[open_[less]] = mid[less] + 1
            hi[open_[~less]] = mid[~less]
