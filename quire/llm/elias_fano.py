"""Elias-Fano sequences over numpy arrays that may lie in a memory-mapped file."""

from __future__ import annotations

import numpy as np

_WORD = np.uint64(64)
_BYTE_COUNT = np.array([bin(b).count("1") for b in range(256)], np.uint8)
# position of the k-th set bit of a byte
_BYTE_SELECT = np.zeros((256, 8), np.uint8)
for _b in range(256):
    for _k, _p in enumerate(p for p in range(8) if _b >> p & 1):
        _BYTE_SELECT[_b, _k] = _p


def _select_in_words(words: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Position of the k-th set bit (from 0) of each 64-bit word."""
    by = np.ascontiguousarray(words).view(np.uint8).reshape(-1, 8)
    upto = np.cumsum(_BYTE_COUNT[by], axis=1, dtype=np.int64)
    byte = (upto <= k[:, None]).sum(axis=1)
    rows = np.arange(len(k))
    before = np.where(byte > 0, upto[rows, np.maximum(byte - 1, 0)], 0)
    return byte * 8 + _BYTE_SELECT[by[rows, byte], k - before]


class EliasFano:
    """A non-decreasing sequence of n values below ``universe``: about 2 + log2(universe / n) bits a value.

    ``low`` holds the lower bits packed, ``high`` the unary gaps of the upper bits; ``ones``
    and ``zeros`` count the bits before each 64-bit word of ``high``.
    """

    FIELDS = ("low", "high", "ones", "zeros")

    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray, zeros: np.ndarray):
        self.n, self.bits = n, bits
        self.low, self.high, self.ones, self.zeros = low, high, ones, zeros

    @classmethod
    def build(cls, values: np.ndarray, universe: int) -> EliasFano:
        n = len(values)
        bits = max(0, (max(int(universe), 1) // max(n, 1)).bit_length() - 1)
        v = values.astype(np.uint64)
        if bits:
            at = np.arange(n, dtype=np.uint64) * np.uint64(bits)
            word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            part = v & np.uint64((1 << bits) - 1)
            low = np.zeros((n * bits >> 6) + 2, np.uint64)
            np.bitwise_or.at(low, word, part << shift)
            over = shift + np.uint64(bits) > _WORD
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (_WORD - shift[over]))
        else:
            low = np.zeros(1, np.uint64)
        up = (v >> np.uint64(bits)).astype(np.int64)
        length = n + (int(up[-1]) if n else 0) + 1
        flags = np.zeros(-(-length // 64) * 64, np.uint8)
        flags[up + np.arange(n)] = 1
        high = np.packbits(flags, bitorder="little").view(np.uint64)
        count = np.bitwise_count(high).astype(np.int64)
        ones = np.concatenate([[0], np.cumsum(count)])
        return cls(n, bits, low, high, ones, np.arange(len(ones), dtype=np.int64) * 64 - ones)

    def _lower(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.int64)
        at = i.astype(np.uint64) * np.uint64(self.bits)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        part = self.low[word] >> shift
        over = shift + np.uint64(self.bits) > _WORD
        if over.any():
            part[over] |= self.low[word[over] + 1] << (_WORD - shift[over])
        return (part & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def _select(self, directory: np.ndarray, k: np.ndarray, flip: bool) -> np.ndarray:
        word = np.searchsorted(directory, k, side="right") - 1
        w = self.high[word]
        return word * 64 + _select_in_words(~w if flip else w, k - directory[word])

    def access(self, i: np.ndarray) -> np.ndarray:
        """Values at the positions ``i``."""
        i = np.asarray(i, np.int64)
        if not len(i):
            return i
        return (self._select(self.ones, i, False) - i) << self.bits | self._lower(i)

    def next_geq(self, x: np.ndarray) -> np.ndarray:
        """Position of the first value not below each ``x`` (n if there is none)."""
        x = np.asarray(x, np.int64)
        if not self.n or not len(x):
            return np.zeros(len(x), np.int64)
        h = x >> self.bits
        top = int(self.zeros[-1])  # zeros in all, padding included
        inside = h < top
        hc = np.minimum(h, top - 1)
        # values with upper bits below h come before the (h - 1)-th zero, those up to h before the h-th
        lo = np.where(hc > 0, self._select(self.zeros, np.maximum(hc - 1, 0), True) - (hc - 1), 0)
        hi = self._select(self.zeros, hc, True) - hc
        lo, hi = np.minimum(lo, self.n), np.minimum(hi, self.n)
        want = x & ((1 << self.bits) - 1)
        live = np.flatnonzero(lo < hi)
        while len(live):  # binary search of the lower bits inside the run of equal upper bits
            mid = (lo[live] + hi[live]) >> 1
            below = self._lower(mid) < want[live]
            lo[live[below]] = mid[below] + 1
            hi[live[~below]] = mid[~below]
            live = live[lo[live] < hi[live]]
        return np.where(inside, lo, self.n)
