"""Elias-Fano coding of monotone sequences, with vectorised access and successor search.

A value's low bits are stored in whole bytes; its high part is a one in a bit vector after as many
zeros as the part says. A directory of ones per 64-bit word gives rank and select.
"""

from __future__ import annotations

import numpy as np

_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)
#: Place of the k-th one (k from 0) of each byte.
_SELECT = np.zeros((256, 8), np.uint8)
for _b in range(256):
    for _k, _i in enumerate(i for i in range(8) if _b >> i & 1):
        _SELECT[_b, _k] = _i
_PAIRS, _FOURS, _BYTES, _STEP, _HIGH = (np.uint64(x) for x in (0x5555555555555555, 0x3333333333333333, 0x0F0F0F0F0F0F0F0F, 0x0101010101010101, 0x8080808080808080))
_ALL, _NONE = np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0)


def encode(values: np.ndarray, universe: int) -> dict[str, np.ndarray]:
    """Arrays of a non-decreasing sequence of unsigned values below universe."""
    n = len(values)
    wide = max(0, int(universe // max(1, n)).bit_length() - 1)
    width = -(-wide // 8)
    high = (values >> np.uint64(8 * width)).astype(np.int64)
    bits = np.zeros(-(-(n + (int(universe) >> (8 * width)) + 2) // 64) * 64, np.uint8)
    bits[high + np.arange(n)] = 1
    packed = np.packbits(bits, bitorder="little")
    ones = _ONES[packed].reshape(-1, 8).sum(1, dtype=np.int64)
    low = np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(n, 8)[:, :width]
    return {"low": np.ascontiguousarray(low).ravel(), "bits": packed, "ones": np.concatenate([[0], np.cumsum(ones)]).astype(np.uint32), "shape": np.array([n, width], np.int64)}


class EliasFano:
    def __init__(self, a: dict[str, np.ndarray], prefix: str = ""):
        self.n, self.width = (int(x) for x in a[f"{prefix}shape"])
        self.low, self.bits, self.ones = a[f"{prefix}low"].reshape(self.n, self.width), a[f"{prefix}bits"], a[f"{prefix}ones"]
        self.words, self.zeros = self.bits.view("<u8"), None

    def _select(self, k: np.ndarray, before: np.ndarray, flip: np.uint64) -> np.ndarray:
        """Place of the k-th one, or zero with flip = _ALL: the word by the directory, the byte by sums of all of a word's bytes at once."""
        word = np.searchsorted(before, k, "right") - 1
        left = (k - before[word].astype(np.int64)).astype(np.uint64)
        x = self.words[word] ^ flip
        s = x - ((x >> np.uint64(1)) & _PAIRS)
        s = (s & _FOURS) + ((s >> np.uint64(2)) & _FOURS)
        s = ((s + (s >> np.uint64(4))) & _BYTES) * _STEP  # ones up to and with each byte
        at = ((((((left * _STEP) | _HIGH) - s) & _HIGH) >> np.uint64(7)) * _STEP >> np.uint64(56)) << np.uint64(3)
        at = np.minimum(at, np.uint64(56))
        left -= ((s << np.uint64(8)) >> at) & np.uint64(255)
        return word * 64 + at.astype(np.int64) + _SELECT[((x >> at) & np.uint64(255)).astype(np.int64), np.minimum(left, np.uint64(7)).astype(np.int64)]

    def select0(self, k: np.ndarray) -> np.ndarray:
        if self.zeros is None:
            self.zeros = np.arange(len(self.ones), dtype=np.int64) * 64 - self.ones
        return self._select(k, self.zeros, _ALL)

    def _low(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), np.uint64)
        for b in range(self.width):
            out |= self.low[i, b].astype(np.uint64) << np.uint64(8 * b)
        return out

    def access(self, i: np.ndarray) -> np.ndarray:
        high = (self._select(i, self.ones, _NONE) - i).astype(np.uint64)
        return (high << np.uint64(8 * self.width)) | self._low(i)

    def successor(self, x: np.ndarray) -> np.ndarray:
        """Index of the first value that is at least x, n where there is none."""
        high = (x >> np.uint64(8 * self.width)).astype(np.int64)
        top = len(self.bits) * 8 - self.n - 1
        high = np.minimum(high, top)
        lo = np.where(high > 0, self.select0(np.maximum(high - 1, 0)) + 1 - high, 0)
        hi = np.minimum(self.select0(high) - high, self.n)
        low = x & np.uint64((1 << (8 * self.width)) - 1)
        while True:  # bisect all ranges at once
            open_ = lo < hi
            if not open_.any():
                return lo
            mid = np.minimum((lo + hi) // 2, self.n - 1)
            less = open_ & (self._low(mid) < low)
            lo = np.where(less, mid + 1, lo)
            hi = np.where(open_ & ~less, mid, hi)
