"""K2-treap: points with weights on a square grid, as a compressed quadtree of maxima."""

from __future__ import annotations

import numpy as np

from rackline.llm.fmindex import _Bits


def _spread(x: np.ndarray) -> np.ndarray:
    """The bits of numbers below 2^31, each followed by a zero bit."""
    x = x.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | x << np.uint64(shift)) & np.uint64(mask)
    return x


class K2Treap:
    """Points (row, column, weight), each cell at most once, weights above 0.

    Nodes are numbered level by level from the root, 0.  A node has four bits, one for
    each quadrant that holds a point, in one bitmap; the child behind a set bit is the
    number of set bits up to it.  ``most`` is the largest weight in each node's quadrant.
    """

    def __init__(self, rows: np.ndarray, columns: np.ndarray, weights: np.ndarray):
        side = int(max(rows.max(initial=0), columns.max(initial=0))) + 1
        self.height = max(1, (side - 1).bit_length())
        code = _spread(rows) << np.uint64(1) | _spread(columns)
        order = np.argsort(code)
        code, most = code[order], weights[order].astype(np.int64)
        levels, bits = [most], []
        for _ in range(self.height):
            parent = code >> np.uint64(2)
            first = np.concatenate(([True], parent[1:] != parent[:-1]))
            number = np.cumsum(first) - 1
            bit = np.zeros(4 * (int(number[-1]) + 1), bool)
            bit[4 * number + (code & np.uint64(3)).astype(np.int64)] = True
            starts = np.flatnonzero(first)
            code, most = parent[starts], np.maximum.reduceat(most, starts)
            levels.append(most)
            bits.append(bit)
        self.bits = _Bits(np.concatenate(bits[::-1]))
        small = levels[-1][0] <= np.iinfo(np.int32).max
        self.most = np.concatenate(levels[::-1]).astype(np.int32 if small else np.int64)

    def child(self, node: np.ndarray, quadrant: np.ndarray) -> np.ndarray:
        """The child in a quadrant (twice the row's half plus the column's), -1 if it is empty or there is no node."""
        at = 4 * np.maximum(node, 0) + quadrant
        return np.where((node >= 0) & self.bits.get(at), self.bits.rank(at) + 1, -1)

    def weight(self, node: np.ndarray) -> np.ndarray:
        """The largest weight below each node, 0 where there is none."""
        return np.where(node >= 0, self.most[node], 0)


def best_columns(
    treap: K2Treap, rows: np.ndarray, factors: np.ndarray, k: int, least: int = 1, batch: int = 256
) -> tuple[np.ndarray, np.ndarray]:
    """(columns, scores) of the k columns with the highest sum of factor times weight over ``rows``.

    Only scores of at least ``least`` count; of columns that tie for the last places all
    are returned.  The paths of all rows descend together over ranges of columns, those of
    the highest bounds first and ``batch`` at a time: a range's bound is the sum over the
    rows of factor times the maximum in its cell.
    """
    height = treap.height
    column, level = np.zeros(1, np.int64), np.zeros(1, np.int64)
    node = np.zeros((1, len(rows)), np.int64)
    bound = treap.weight(node) @ factors
    found, scores = [], []
    best = np.empty(0, np.int64)
    while True:
        open_ = np.flatnonzero(bound >= least)
        if not len(open_):
            break
        if len(open_) > batch:
            open_ = open_[np.argpartition(bound[open_], len(open_) - batch)]
            chosen, rest = open_[len(open_) - batch :], open_[: len(open_) - batch]
        else:
            chosen, rest = open_, open_[:0]
        done = level[chosen] == height
        ended, chosen = chosen[done], chosen[~done]
        if len(ended):  # a single column: its bound is its score
            found.append(column[ended])
            scores.append(bound[ended])
            best = np.concatenate((best, bound[ended]))
            if len(best) >= k:
                best = np.partition(best, len(best) - k)[len(best) - k :]
                least = max(least, int(best.min()))
        shift = height - 1 - level[chosen]
        half = rows[None, :] >> shift[:, None] & 1
        below = [treap.child(node[chosen], 2 * half + b) for b in (0, 1)]
        node = np.concatenate((node[rest], *below))
        column = np.concatenate((column[rest], column[chosen] << 1, column[chosen] << 1 | 1))
        level = np.concatenate((level[rest], level[chosen] + 1, level[chosen] + 1))
        bound = np.concatenate((bound[rest], *(treap.weight(n) @ factors for n in below)))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    found, scores = np.concatenate(found), np.concatenate(scores)
    keep = scores >= least
    return found[keep], scores[keep]
