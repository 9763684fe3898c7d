"""Elias-Fano coded monotone sequences in plain arrays, searched and read by vector operations.

A value's low bits (a whole number of bytes) stand in byte planes; its high bits are coded in unary in a
bit vector: value i sets bit (high + i). Directories of zeros and of ones before each 64-bit word make
`select0` and `select1` one binary search and a few word operations each.
"""

from __future__ import annotations

import numpy as np

_L8, _H8 = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)
_IN_BYTE = np.asarray([[([b for b in range(8) if byte >> b & 1] + [0] * 8)[k] for byte in range(256)] for k in range(8)], np.uint8).ravel()


def _u(x) -> np.uint64:
    return np.uint64(x)


def build(values: np.ndarray, universe: int) -> dict[str, np.ndarray]:
    """values: sorted uint64 below universe."""
    n = len(values)
    low_bytes = max(0, min(7, ((max(1, universe // max(1, n))).bit_length() + 3) // 8))
    low = values & _u((1 << (8 * low_bytes)) - 1)
    high = (values >> _u(8 * low_bytes)).astype(np.int64)
    zeros = ((universe - 1) >> (8 * low_bytes)) + 1
    words = np.zeros((n + zeros) // 64 + 1, np.uint64)
    at = high + np.arange(n)
    if n:
        word = at >> 6
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        words[word[first]] = np.bitwise_or.reduceat(_u(1) << (at & 63).astype(np.uint64), first)
    ones = np.bitwise_count(words).astype(np.int64)
    kind = np.uint32 if n + zeros < 1 << 32 else np.uint64
    before, ones = (np.concatenate([[0], np.cumsum(x)[:-1]]).astype(kind) for x in (64 - ones, ones))
    planes = [(low >> _u(8 * b)).astype(np.uint8) for b in range(low_bytes)]
    return {"high": words, "before": before, "ones": ones, "low": np.concatenate(planes) if planes else np.zeros(0, np.uint8), "size": np.asarray([n, low_bytes], np.int64)}


class EliasFano:
    def __init__(self, arrays: dict[str, np.ndarray]):
        self.high, self.before, self.ones = arrays["high"], arrays["before"], arrays["ones"]
        self.n, self.low_bytes = (int(x) for x in arrays["size"])
        self.planes = [arrays["low"][b * self.n : (b + 1) * self.n] for b in range(self.low_bytes)]

    def low(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), np.uint64)
        for b, plane in enumerate(self.planes):
            out |= plane[i].astype(np.uint64) << _u(8 * b)
        return out

    def select0(self, k: np.ndarray) -> np.ndarray:
        """Where the k-th zero stands, from 0."""
        word = np.searchsorted(self.before, k.astype(self.before.dtype), side="right") - 1
        rest = (k - self.before[word].astype(np.int64)).astype(np.uint64)
        return word * 64 + _select_in_word(~self.high[word], rest)

    def access(self, i: np.ndarray) -> np.ndarray:
        """The i-th values, from 0."""
        word = np.searchsorted(self.ones, i.astype(self.ones.dtype), side="right") - 1
        rest = (i - self.ones[word].astype(np.int64)).astype(np.uint64)
        high = (word * 64 + _select_in_word(self.high[word], rest) - i).astype(np.uint64)
        return (high << _u(8 * self.low_bytes)) | self.low(i)

    def rank(self, high: np.ndarray) -> np.ndarray:
        """Values whose high bits are below high."""
        out = np.zeros(len(high), np.int64)
        some = high > 0
        k = high[some] - 1
        out[some] = self.select0(k) - k
        return out

    def search(self, values: np.ndarray) -> np.ndarray:
        """Where each value stands, or -1."""
        if not self.n:
            return np.full(len(values), -1, np.int64)
        high = (values >> _u(8 * self.low_bytes)).astype(np.int64)
        low = values & _u((1 << (8 * self.low_bytes)) - 1)
        left, right = self.rank(high), self.rank(high + 1)
        end = right.copy()
        active = np.flatnonzero(left < right)
        while len(active):
            middle = (left[active] + right[active]) >> 1
            less = self.low(middle) < low[active]
            left[active[less]] = middle[less] + 1
            right[active[~less]] = middle[~less]
            active = active[left[active] < right[active]]
        found = left < end
        found[found] = self.low(left[found]) == low[found]
        return np.where(found, left, -1)

    def values(self) -> np.ndarray:
        """All values, for tests and small sequences."""
        bits = np.flatnonzero(np.unpackbits(np.ascontiguousarray(self.high).view(np.uint8), bitorder="little"))[: self.n]
        return ((bits - np.arange(self.n)).astype(np.uint64) << _u(8 * self.low_bytes)) | self.low(np.arange(self.n))


def _select_in_word(word: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Where the k-th one of each word stands (broadword selection)."""
    s = word - ((word >> _u(1)) & _u(0x5555555555555555))
    s = (s & _u(0x3333333333333333)) + ((s >> _u(2)) & _u(0x3333333333333333))
    s = ((s + (s >> _u(4))) & _u(0x0F0F0F0F0F0F0F0F)) * _L8  # ones up to and with each byte
    less = (((k * _L8) | _H8) - s) & _H8  # bytes whose sum is at most k
    place = (((less >> _u(7)) * _L8) >> _u(53)) & _u(0x78)
    inside = k - (((s << _u(8)) >> place) & _u(0xFF))
    byte = (word >> place) & _u(0xFF)
    return (place + _IN_BYTE[(inside << _u(8) | byte).astype(np.int64)]).astype(np.int64)
