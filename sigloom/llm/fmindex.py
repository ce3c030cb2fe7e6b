"""A compressed FM-index over word sequences: the Burrows-Wheeler transform in a wavelet matrix, searched backwards.

All searches run over arrays of patterns at once. Suffixes are sorted by their first DEPTH words, which orders the
intervals of all patterns of up to DEPTH words correctly.
"""

from __future__ import annotations

import numpy as np

DEPTH = 16


class Bits:
    """A bit vector with constant-time rank: words of 64 bits and the ones before each of them."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.frombuffer(packed.tobytes() + b"\0" * (16 - len(packed) % 8), np.uint64)
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))[:-1].astype(np.int32)
        self.zeros = len(bits) - int(bits.sum())

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, size: int):
        self.levels: list[Bits] = []
        self.depth = max(1, int(size - 1).bit_length())
        first = np.zeros(size, np.int64)
        every = np.arange(size)
        for level in range(self.depth - 1, -1, -1):
            one = (symbols >> level & 1).astype(bool)
            bits = Bits(one)
            self.levels.append(bits)
            symbols = np.concatenate((symbols[~one], symbols[one]))
            first = self._down(bits, every >> level & 1, first)
        self.first = first

    @staticmethod
    def _down(bits: Bits, one: np.ndarray, at: np.ndarray) -> np.ndarray:
        ones = bits.rank(at)
        return np.where(one, bits.zeros + ones, at - ones)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        for k, bits in enumerate(self.levels):
            at = self._down(bits, symbol >> (self.depth - 1 - k) & 1, at)
        return at - self.first[symbol]


class FMIndex:
    """text: symbols 1..size-1, 0 between sequences (a pattern holds no 0, so no match crosses sequences)."""

    def __init__(self, text: np.ndarray, size: int):
        order = text.astype(np.int64)
        step = 1
        while step < DEPTH:
            after = np.zeros(len(order), np.int64)
            after[:-step] = order[step:] + 1 if step < len(order) else 0
            order = order * (int(order.max(initial=0)) + 2) + after
            step *= 2
            if step < DEPTH:  # the last keys are sorted below: their ranks are not needed
                _, order = np.unique(order, return_inverse=True)
        self.places = np.argsort(order, kind="stable")
        self.less = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=size))))
        self.wavelet = WaveletMatrix(text[self.places - 1], size)

    def matching(self, text: np.ndarray, ends: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each pattern text[end - most : end], read backwards: how many words match more than one place (the
        matching statistic, `most` at most), and the interval of the last match."""
        symbol = text[ends - 1]
        low, high = self.less[symbol], self.less[symbol + 1]
        length = (high - low > 1).astype(np.int64)
        left = np.flatnonzero(length)
        for k in range(2, most + 1):
            s = text[ends[left] - k]
            n = len(left)
            both = self.wavelet.rank(np.concatenate((s, s)), np.concatenate((low[left], high[left])))
            a, b = self.less[s] + both[:n], self.less[s] + both[n:]
            more = b - a > 1
            left = left[more]
            low[left], high[left] = a[more], b[more]
            length[left] = k
        return length, low, high
