"""FM-index over a sequence of small integers, with batches of searches in numpy."""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Positions of the suffixes in order, by prefix doubling; a shorter suffix comes first."""
    n = len(symbols)
    _, rank = np.unique(symbols, return_inverse=True)
    rank, k = rank.astype(np.int64), 1
    while True:
        after = np.zeros(n, np.int64)
        after[: n - k if k < n else 0] = rank[k:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank[order] = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
        if n < 2 or rank[order[-1]] == n - 1:
            return order
        k *= 2


class _Bits:
    """A bit vector with constant-time rank."""

    def __init__(self, bits: np.ndarray):
        words = np.zeros(len(bits) // 64 + 1, np.uint64)
        packed = np.packbits(bits, bitorder="little")
        words.view(np.uint8)[: len(packed)] = packed
        self.words = words
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)))[:-1]
        self.ones = int(bits.sum())
        self.zeros = len(bits) - self.ones

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Set bits before each position."""
        word = at >> 6
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & low).astype(np.int64)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1


class Wavelet:
    """Wavelet tree, its levels laid out one after the other (a wavelet matrix)."""

    def __init__(self, symbols: np.ndarray, alphabet: int):
        self.levels = max(1, int(alphabet - 1).bit_length())
        self.bits = []
        rest = symbols
        for level in range(self.levels - 1, -1, -1):
            bit = (rest >> level & 1).astype(bool)
            self.bits.append(_Bits(bit))
            rest = np.concatenate((rest[~bit], rest[bit]))
        every = np.arange(alphabet)
        self.start = self._follow(every, np.zeros(alphabet, np.int64))

    def _follow(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, bits in zip(range(self.levels - 1, -1, -1), self.bits, strict=True):
            ones = bits.rank(at)
            at = np.where(symbol >> level & 1, bits.zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each position."""
        return self._follow(symbol, at) - self.start[symbol]

    def get(self, at: np.ndarray) -> np.ndarray:
        symbol = np.zeros(len(at), np.int64)
        for bits in self.bits:
            one, ones = bits.get(at), bits.rank(at)
            at = np.where(one, bits.zeros + ones, at - ones)
            symbol = symbol << 1 | one
        return symbol


class FMIndex:
    """Count and locate patterns in ``text``, symbols from 1 to ``alphabet - 1``."""

    def __init__(self, text: np.ndarray, alphabet: int, sample: int = 16):
        text = np.concatenate((text, [0])).astype(np.int64)  # 0 ends the text and is its smallest symbol
        order = suffix_array(text)
        last = text[order - 1]
        self.size = len(text)
        self.tree = Wavelet(last, alphabet)
        counts = np.bincount(text, minlength=alphabet)
        self.first = np.concatenate(([0], np.cumsum(counts)))
        marked = order % sample == 0
        self.marked = _Bits(marked)
        self.samples = order[marked]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix-array interval [low, high) of each row of ``patterns``, by backward search."""
        count, length = patterns.shape
        low, high = np.zeros(count, np.int64), np.full(count, self.size, np.int64)
        live = np.arange(count)
        for step in range(length - 1, -1, -1):
            symbol = patterns[live, step]
            low[live] = self.first[symbol] + self.tree.rank(symbol, low[live])
            high[live] = self.first[symbol] + self.tree.rank(symbol, high[live])
            live = live[low[live] < high[live]]
        return low, high

    def locate(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pattern number, text position) of every occurrence, by steps to the next sampled suffix."""
        size = high - low
        owner = np.repeat(np.arange(len(low)), size)
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low, size)
        place = np.zeros(len(at), np.int64)
        steps, open_ = np.zeros(len(at), np.int64), np.arange(len(at))
        while len(open_):
            there = self.marked.get(at[open_])
            done = open_[there]
            place[done] = self.samples[self.marked.rank(at[done])] + steps[done]
            open_ = open_[~there]
            symbol = self.tree.get(at[open_])
            at[open_] = self.first[symbol] + self.tree.rank(symbol, at[open_])
            steps[open_] += 1
        return owner, place
