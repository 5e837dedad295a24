"""Elias-Fano sequences and trie levels over mapped files.

An ascending sequence of n numbers below u keeps the low log2(u / n) bits of each number in a
packed array and its high bits in unary: about 2 + log2(u / n) bits a number. Zeros and ones of
the unary part are counted per word, so the numbers with given high bits are found by selecting
two zeros, and the successor of a value by a short binary search over their low bits. All
look-ups take arrays of queries.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64


_BYTES = _U(0x0101010101010101)
#: Place of the k-th one of a byte, at 8 * byte + k.
_ONE_IN_BYTE = np.array([([i for i in range(8) if b >> i & 1] + [0] * 8)[:8] for b in range(256)], np.int8).ravel()


def _zero_in_word(words: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Position in each 64-bit word of its k-th zero: the byte by the running sums of zeros, all
    eight in one word, and the place in it from a table."""
    left, k = ~words, k.astype(_U)
    sums = left - (left >> _U(1) & _U(0x5555555555555555))
    sums = (sums & _U(0x3333333333333333)) + (sums >> _U(2) & _U(0x3333333333333333))
    sums = ((sums + (sums >> _U(4))) & _U(0x0F0F0F0F0F0F0F0F)) * _BYTES
    # The high bit of a byte stays where the sum up to it is at most k.
    before = np.bitwise_count(((k * _BYTES | _U(0x8080808080808080)) - sums) & _U(0x8080808080808080))
    at = np.minimum(before, 7).astype(_U) << _U(3)
    k -= (sums << _U(8)) >> at & _U(0xFF)
    return at.astype(np.int64) + _ONE_IN_BYTE[((left >> at & _U(0xFF)) << _U(3) | k & _U(7)).astype(np.int64)]


def _packed_words(bits: np.ndarray) -> np.ndarray:
    """Bits (0/1, first is lowest) as 64-bit words, with a spare word at the end."""
    data = np.packbits(bits, bitorder="little")
    words = np.zeros(len(data) // 8 + 2, "<u8")
    words.view(np.uint8)[: len(data)] = data
    return words


class Sequence:
    """An ascending sequence of distinct or repeated numbers, read from arrays. zeros and ones:
    how many of the unary part are before each word. Nothing that grows with the sequence is kept
    beside the arrays, since a reader has thousands of sequences open."""

    PARTS = ("low", "high", "zeros", "ones")

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray, zeros: np.ndarray, ones: np.ndarray):
        self.n, self.width, self.low, self.high, self.zeros, self.ones = n, width, low, high, zeros, ones

    @classmethod
    def build(cls, values: np.ndarray) -> Sequence:
        values = values.astype(_U)
        n = len(values)
        width = max(0, (int(values[-1]) + 1) // n).bit_length() - 1 if n else 0
        width = max(width, 0)
        low = values & _U((1 << width) - 1)
        step = 1 << 16
        bits = np.concatenate(
            [((low[i : i + step, None] >> np.arange(width, dtype=_U)) & _U(1)).astype(np.uint8).ravel() for i in range(0, n, step)]
            or [np.empty(0, np.uint8)]
        )
        ups = (values >> _U(width)).astype(np.int64)
        unary = np.zeros(n + (int(ups[-1]) if n else 0) + 1, np.uint8)
        unary[ups + np.arange(n)] = 1
        high = _packed_words(unary)
        ones = np.cumsum(np.r_[0, np.bitwise_count(high[:-1])], dtype=np.int64)
        zeros = 64 * np.arange(len(high)) - ones
        kind = "<u4" if len(high) < 1 << 26 else "<u8"
        return cls(n, width, _packed_words(bits), high, zeros.astype(kind), ones.astype(kind))

    def _select_zero(self, k: np.ndarray) -> np.ndarray:
        """Position of the k-th zero (from 0) of the unary part."""
        word = np.searchsorted(self.zeros, k.astype(self.zeros.dtype), side="right") - 1
        return word * 64 + _zero_in_word(self.high[word], k - self.zeros[word].astype(np.int64))

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), _U)
        at = i * self.width
        if self.width <= 57:  # within eight bytes from the one in which it begins
            data = np.ndarray(self.low.nbytes - 7, "<u8", self.low, strides=(1,))
            return data[at >> 3] >> (at & 7).astype(_U) & _U((1 << self.width) - 1)
        word, off = at >> 6, (at & 63).astype(_U)
        value = self.low[word] >> off
        spill = off + _U(self.width) > _U(64)
        more = self.low[word + 1] << ((_U(64) - off) & _U(63))
        return np.where(spill, value | more, value) & _U((1 << self.width) - 1)

    def _bounds(self, up: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and past-last index of the numbers with the given high bits: the ones between
        two zeros, of which the second is mostly in sight of the first."""
        at = np.zeros(len(up), np.int64)
        later = up > 0
        at[later] = self._select_zero(up[later] - 1) + 1
        start = at - up
        word, off = at >> 6, (at & 63).astype(_U)
        ahead = np.minimum(word + 1, len(self.high) - 1)
        bits = self.high[word] >> off
        bits |= np.where(off > 0, self.high[ahead] << ((_U(64) - off) & _U(63)), _U(0))
        ones = np.bitwise_count(bits & ~(bits + _U(1))).astype(np.int64)  # trailing ones
        end = start + ones
        far = ones == 64
        if far.any():
            end[far] = self._select_zero(up[far]) - up[far]
        return start, end

    def _search(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first number that is not smaller, and whether it is the value itself."""
        values = values.astype(_U)
        at, hit = np.full(len(values), self.n, np.int64), np.zeros(len(values), bool)
        up = (values >> _U(self.width)).astype(np.int64)
        inside = up <= self._top()  # beyond the last number there are no zeros to select
        if not inside.any():
            return at, hit
        start, end = self._bounds(up[inside])
        low = values[inside] & _U((1 << self.width) - 1)
        until = end.copy()
        while (open_ := np.flatnonzero(start < end)).size:
            mid = (start[open_] + end[open_]) >> 1
            less = self._low(mid) < low[open_]
            start[open_[less]] = mid[less] + 1
            end[open_[~less]] = mid[~less]
        same = np.zeros(len(start), bool)
        some = np.flatnonzero(start < until)
        same[some] = self._low(start[some]) == low[some]
        at[inside], hit[inside] = start, same
        return at, hit

    def successor(self, values: np.ndarray) -> np.ndarray:
        """Index of the first number that is not smaller (n if there is none)."""
        return self._search(values)[0]

    def find(self, values: np.ndarray) -> np.ndarray:
        """Index of each value, or -1."""
        at, hit = self._search(values)
        return np.where(hit, at, -1)

    def _top(self) -> int:
        """The high bits of the last number; -1 without numbers."""
        word = len(self.high) - 1
        while self.n and not self.high[word]:  # a few words at the end
            word -= 1
        return word * 64 + int(self.high[word]).bit_length() - self.n if self.n else -1

    def get(self, i: np.ndarray) -> np.ndarray:
        """The numbers at the given indices."""
        word = np.searchsorted(self.ones, i.astype(self.ones.dtype), side="right") - 1
        position = word * 64 + _zero_in_word(~self.high[word], i - self.ones[word].astype(np.int64))
        return ((position - i).astype(_U) << _U(self.width)) | self._low(i)
