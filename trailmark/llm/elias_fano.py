"""Compact sorted sequences over numpy arrays that may be memory maps."""

from __future__ import annotations

import numpy as np

U = np.uint64
#: Values that are looked through one by one.
FEW = 3


class Bits:
    """n values of `width` bits each, one after the other."""

    def __init__(self, width: int, data: np.ndarray):
        self.width, self.data = width, data
        self.words = np.ndarray(max(0, len(data) - 7), "<u8", data, strides=(1,))

    @staticmethod
    def pack(values: np.ndarray, width: int) -> np.ndarray:
        bit = np.arange(len(values), dtype=U) * U(width)
        out = np.zeros(int(len(values) * width) // 64 + 3, U)
        if width:
            at, shift = (bit >> U(6)).astype(np.int64), bit & U(63)
            np.bitwise_or.at(out, at, values << shift)
            over = (shift + U(width)) > U(64)
            np.bitwise_or.at(out, at[over] + 1, values[over] >> (U(64) - shift[over]))
        return out.view(np.uint8)

    def get(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), U)
        bit = i.astype(U) * U(self.width)
        return (self.words[(bit >> U(3)).astype(np.int64)] >> (bit & U(7))) & U((1 << self.width) - 1)


#: Place of the (k+1)-th one of each byte, at 8 * byte + k.
_IN_BYTE = np.zeros(256 * 8, np.uint8)
for _byte in range(256):
    _ones = [k for k in range(8) if _byte >> k & 1]
    _IN_BYTE[8 * _byte : 8 * _byte + len(_ones)] = _ones


def _select(word: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the (k+1)-th one of each word: first its byte, by the ones up to each byte, then its place there."""
    s = word - ((word >> U(1)) & U(0x5555555555555555))
    s = (s & U(0x3333333333333333)) + ((s >> U(2)) & U(0x3333333333333333))
    s = ((s + (s >> U(4))) & U(0x0F0F0F0F0F0F0F0F)) * U(0x0101010101010101)
    byte = (s.view(np.uint8).reshape(-1, 8) <= k.astype(np.uint8)[:, None]).sum(1, dtype=np.uint8)
    shift = byte.astype(U) << U(3)
    before = ((s << U(8)) >> shift) & U(255)
    return shift + _IN_BYTE[(((word >> shift) & U(255)) << U(3)).astype(np.int64) + (k - before.astype(np.int64))]


class EliasFano:
    """A sequence that never falls: low bits stored plainly (at most 56), high bits as gaps in unary, and how many ones
    and zeros come before each word of the high bits."""

    def __init__(self, n: int, low: Bits, high: np.ndarray, ones: np.ndarray, zeros: np.ndarray):
        self.n, self.low, self.high, self.ones, self.zeros = n, low, high, ones, zeros

    @staticmethod
    def build(values: np.ndarray, universe: int) -> dict[str, np.ndarray]:
        """Arrays to store; universe: above every value, at most 2^64."""
        n = len(values)
        width = min(56, max(0, (universe // max(n, 1)).bit_length() - 1))
        top = (universe - 1 >> width) + 1 if n else 1
        high = np.zeros((n + top) // 64 + 2, U)
        place = (values >> U(width)) + np.arange(n, dtype=U)
        np.bitwise_or.at(high, (place >> U(6)).astype(np.int64), U(1) << (place & U(63)))
        low = Bits.pack(values & U((1 << width) - 1), width)
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(high).astype(np.int64))])
        return {"head": np.array([n, width], np.int64), "low": low, "high": high, "ones": ones, "zeros": np.arange(len(ones)) * 64 - ones}

    @classmethod
    def load(cls, parts: dict[str, np.ndarray]) -> EliasFano:
        n, width = map(int, parts["head"])
        return cls(n, Bits(width, parts["low"]), parts["high"], parts["ones"], parts["zeros"])

    def get(self, i: np.ndarray) -> np.ndarray:
        """The i-th values."""
        at = np.searchsorted(self.ones, i, "right") - 1
        place = at.astype(U) * U(64) + _select(self.high[at], i - self.ones[at])
        return ((place - i.astype(U)) << U(self.low.width)) | self.low.get(i)

    def _zero(self, k: np.ndarray) -> np.ndarray:
        """Place of the (k+1)-th zero of the high bits."""
        at = np.minimum(np.searchsorted(self.zeros, k, "right") - 1, len(self.high) - 1)
        return at * 64 + _select(~self.high[at], k - self.zeros[at]).astype(np.int64)

    def successor(self, x: np.ndarray) -> np.ndarray:
        """Place of the first value that is not under x; n if there is none."""
        return self._search(x)[0]

    def _search(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Successors' places, and which of them are x itself."""
        if not self.n or not len(x):
            return np.full(len(x), self.n, np.int64), np.zeros(len(x), bool)
        bucket = (x >> U(self.low.width)).astype(np.int64)
        beyond = bucket >= self.zeros[-1]
        bucket = np.where(beyond, 0, bucket)
        at = np.where(bucket > 0, self._zero(np.maximum(bucket - 1, 0)) - np.maximum(bucket - 1, 0), 0)
        end = np.minimum(self._zero(bucket) - bucket, self.n)
        low = x & U((1 << self.low.width) - 1)
        # lows rise within a bucket
        lo, hi = at, end.copy()
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                break
            mid = (lo[open_] + hi[open_]) // 2
            less = self.low.get(mid) < low[open_]
            lo[open_[less]] = mid[less] + 1
            hi[open_[~less]] = mid[~less]
        exact = (lo < end) & ~beyond
        exact[exact] = self.low.get(lo[exact]) == low[exact]
        return np.where(beyond, self.n, lo), exact

    def find(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Place of x among the values from lo to hi, or -1. Short ranges are looked through."""
        out = np.full(len(x), -1, np.int64)
        size = hi - lo
        for j in range(FEW):
            here = np.flatnonzero((size > j) & (size <= FEW))
            hit = here[self.get(lo[here] + j) == x[here]]
            out[hit] = lo[hit] + j
        many = np.flatnonzero(size > FEW)
        place, exact = self._search(x[many])
        ok = exact & (place >= lo[many]) & (place < hi[many])
        out[many[ok]] = place[ok]
        return out
