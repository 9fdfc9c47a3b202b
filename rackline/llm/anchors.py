"""Content-defined anchors: positions that equal strings share, whatever surrounds them."""

from __future__ import annotations

import numpy as np

#: Bytes of a gram.  Each string of LENGTH bytes has its smallest gram, by hash, as an anchor.
GRAM = 64
LENGTH = 200
REACH = LENGTH - GRAM

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_VALUES = np.random.default_rng(12345).integers(1, 1 << 63, 256, dtype=np.uint64)
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Hashes:
    """Hashes of all substrings of ``data`` in constant time each."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_VALUES[data] * _powers(_BASE, n), dtype=np.uint64)))
        self.inverse = _powers(_INVERSE, n + 1)

    def of(self, start, end) -> np.ndarray:
        """Equal for equal strings; the length counts too."""
        value = (self.sums[end] - self.sums[start]) * self.inverse[start]
        return mix(value + np.asarray(end - start).astype(np.uint64))


def _sliding(op, x: np.ndarray, width: int) -> np.ndarray:
    """``op`` over [i, i + width) for every i where that fits."""
    done, k = x, 1
    while 2 * k <= width:
        done = op(done[:-k], done[k:])
        k *= 2
    rest = width - k
    return op(done[: len(done) - rest], done[rest:]) if rest else done


def anchors(hashes: Hashes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of anchors and the hashes of their grams, for texts at [start, end) of one buffer.

    Texts shorter than LENGTH have none.
    """
    n = len(hashes.sums) - 1
    if n < LENGTH:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    at = np.arange(n - GRAM + 1)
    gram = hashes.of(at, at + GRAM)
    # Grams that cross from one text to the next are no grams.
    crossing = np.zeros(n + 1, np.int32)
    np.add.at(crossing, np.maximum(starts - GRAM + 1, 0), 1)
    np.add.at(crossing, starts, -1)
    gram[np.cumsum(crossing)[: len(gram)] > 0] = _TOP
    width = REACH + 1
    if len(gram) < width:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    low = _sliding(np.minimum, gram, width)
    none = np.zeros(width - 1, np.uint64)
    high = _sliding(np.maximum, np.concatenate((none, low, none)), width)
    found = np.flatnonzero((high == gram) & (gram != _TOP))
    text = np.searchsorted(starts, found, "right") - 1
    long = ends[text] - starts[text] >= LENGTH
    return found[long], gram[found[long]]
