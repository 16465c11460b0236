"""Elias-Fano sequences in numpy: monotone integers as packed low bits and a unary bit vector of high parts."""

from __future__ import annotations

import numpy as np

#: Words of a block; ones and zeros are counted before each block.
BLOCK = 4
#: Ones of a byte, and the place of its k-th one.
_ONES = np.bitwise_count(np.arange(256, dtype=np.uint8))
_PLACE = np.array([([k for k in range(8) if b >> k & 1] + [0] * 8)[:8] for b in range(256)], np.int64)


class Bits:
    """A bit vector in 64-bit words with the number of ones and of zeros before every fourth word."""

    def __init__(self, words: np.ndarray, ones: np.ndarray, zeros: np.ndarray):
        self.words, self.before = words, (zeros, ones)

    @classmethod
    def build(cls, bits: np.ndarray) -> Bits:
        """From an array of 0 / 1 bytes. A spare block at the end keeps reads inside."""
        size = 64 * BLOCK
        padded = np.zeros((len(bits) // size + 2) * size, np.uint8)
        padded[: len(bits)] = bits
        words = np.packbits(padded, bitorder="little").view(np.uint64)
        held = np.bitwise_count(words).reshape(-1, BLOCK).sum(axis=1, dtype=np.int64)
        ones = np.cumsum(held) - held
        return cls(words, ones, size * np.arange(len(ones)) - ones)

    def select(self, k: np.ndarray, bit: int) -> np.ndarray:
        """Position of the k-th (from 0) bit of that value; k must be present."""
        block = np.searchsorted(self.before[bit], k, "right") - 1
        left = k - self.before[bit][block]
        word_at = block * BLOCK
        flip = np.uint64(0) if bit else ~np.uint64(0)
        word = self.words[word_at] ^ flip
        count = np.bitwise_count(word).astype(np.int64)
        behind = np.flatnonzero(left >= count)
        while len(behind):  # at most BLOCK - 1 times
            left[behind] -= count[behind]
            word_at[behind] += 1
            word[behind] = self.words[word_at[behind]] ^ flip
            count[behind] = np.bitwise_count(word[behind])
            behind = behind[left[behind] >= count[behind]]
        inside = word.view(np.uint8).reshape(-1, 8)
        ones = _ONES[inside]
        upto = ones.cumsum(axis=1, dtype=np.uint8)
        byte = (upto <= left[:, None].astype(np.uint8)).sum(axis=1)
        row = np.arange(len(k))
        rest = left - upto[row, byte] + ones[row, byte]
        return (word_at << 6) + 8 * byte + _PLACE[inside[row, byte], rest]


class EliasFano:
    """A non-decreasing sequence of n integers below 2^64."""

    PARTS = ("head", "low", "high", "ones", "zeros")

    def __init__(self, head: np.ndarray, low: np.ndarray, high: np.ndarray, ones: np.ndarray, zeros: np.ndarray):
        self.n, self.width, self.top = (int(x) for x in head)
        self.mask = np.uint64((1 << self.width) - 1)
        self.low_bytes = low
        self.words_at = np.ndarray((max(1, low.nbytes - 7),), "<u8", low, 0, (1,))
        self.bits = Bits(high, ones, zeros)

    @classmethod
    def parts(cls, values: np.ndarray) -> dict[str, np.ndarray]:
        values = np.asarray(values, np.uint64)
        n, universe = len(values), int(values[-1]) + 1 if len(values) else 1
        width = min(56, max(0, (universe // max(1, n)).bit_length() - 1))
        bits = ((values[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8) if n else np.zeros((0, width), np.uint8)
        low = np.concatenate([np.packbits(bits.ravel(), bitorder="little"), np.zeros(8, np.uint8)])
        high = (values >> np.uint64(width)).astype(np.int64)
        top = int(high[-1]) if n else 0
        unary = np.zeros(n + top + 1, np.uint8)
        unary[high + np.arange(n)] = 1
        packed = Bits.build(unary)
        return {"head": np.array([n, width, top], np.int64), "low": low, "high": packed.words, "ones": packed.before[1], "zeros": packed.before[0]}

    def _low(self, index: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(index), np.uint64)
        bit = index * self.width
        return (self.words_at[bit >> 3] >> (bit & 7).astype(np.uint64)) & self.mask

    def access(self, index: np.ndarray) -> np.ndarray:
        """The values at these places."""
        index = np.asarray(index, np.int64)
        return ((self.bits.select(index, 1) - index).astype(np.uint64) << np.uint64(self.width)) | self._low(index)

    def find(self, value: np.ndarray) -> np.ndarray:
        """Place of each value in a strictly increasing sequence, -1 where it is absent: jump to the elements with the value's
        high part, then find the successor among their low bits."""
        value = np.asarray(value, np.uint64)
        out = np.full(len(value), -1, np.int64)
        high = value >> np.uint64(self.width)
        todo = np.flatnonzero(high <= np.uint64(self.top)) if self.n else np.zeros(0, np.int64)
        part = high[todo].astype(np.int64)
        low = np.zeros(len(todo), np.int64)
        later = part > 0
        low[later] = self.bits.select(part[later] - 1, 0) + 1 - part[later]
        end = self.bits.select(part, 0) - part
        wanted, last = value[todo] & self.mask, end - 1
        live = np.flatnonzero(low < end)
        while len(live):  # halve [low, end) until low is the successor
            middle = (low[live] + end[live]) >> 1
            below = self._low(middle) < wanted[live]
            low[live] = np.where(below, middle + 1, low[live])
            end[live] = np.where(below, end[live], middle)
            live = live[low[live] < end[live]]
        some = np.flatnonzero(low <= last)
        hit = some[self._low(low[some]) == wanted[some]]
        out[todo[hit]] = low[hit]
        return out
