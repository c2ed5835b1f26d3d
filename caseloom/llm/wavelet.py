"""A wavelet matrix: ranks of small symbols at any place of a sequence."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np


class BitVector:
    """Bits with the number of ones before every 64th of them."""

    def __init__(self, bits: np.ndarray) -> None:
        n = len(bits)
        packed = np.packbits(bits, bitorder="little")
        words = np.zeros(n // 64 + 1, np.uint64)
        words.view(np.uint8)[: len(packed)] = packed
        self.words = words
        self.before = np.zeros(len(words), np.int64)
        np.cumsum(np.bitwise_count(words[:-1]), out=self.before[1:])

    def ones(self, at: np.ndarray) -> np.ndarray:
        """How many of the first ``at`` bits are one."""
        word = at >> 6
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & low)


class WaveletMatrix:
    """Symbols below ``2**levels``, one bit vector for each bit, highest bit first.

    Below each level the symbols stand with the zeros of that bit first, in
    their order, so a rank walks down by one rank of bits per level.
    """

    def __init__(self, symbols: np.ndarray, levels: int) -> None:
        self.n, self.levels = len(symbols), []
        for level in range(levels - 1, -1, -1):
            bits = (symbols >> level) & 1
            zero = bits == 0
            self.levels.append((level, BitVector(bits), int(zero.sum())))
            symbols = np.concatenate([symbols[zero], symbols[~zero]])

    def rank(self, symbol: int, at: np.ndarray) -> np.ndarray:
        """How often ``symbol`` stands among the first ``at`` symbols."""
        first, last = np.zeros_like(at), at
        for level, bits, zeros in self.levels:
            a, b = bits.ones(first), bits.ones(last)
            first, last = (zeros + a, zeros + b) if symbol >> level & 1 else (first - a, last - b)
        return last - first

    def count(self, symbols: Iterable[int], at: np.ndarray) -> np.ndarray:
        """How many of the first ``at`` symbols are among ``symbols``: the sum of their ranks."""
        return sum((self.rank(s, at) for s in symbols), np.zeros_like(at))

    def select(self, symbols: Iterable[int], number: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Place of the ``number``-th (from 0) of ``symbols`` in [first, last), by bisection on ranks; ``last`` if there are fewer."""
        symbols = tuple(symbols)
        wanted = self.count(symbols, first) + number
        low, high = first.copy(), last.copy()
        while (active := np.flatnonzero(low < high)).size:
            middle = (low[active] + high[active]) // 2
            short = self.count(symbols, middle + 1) <= wanted[active]
            low[active[short]] = middle[short] + 1
            high[active[~short]] = middle[~short]
        return low
