"""Suffix arrays by grouping: linear construction without recursive renaming.

A suffix's Lyndon prefix is its longest prefix that is smaller than all of its own proper
suffixes; it ends where the next smaller suffix begins.  Suffixes start in groups by their
first symbol.  Groups are taken in descending order: every member points at the nearest
suffix before it whose group is smaller, and what is pointed at by k members continues with
their common prefix k times, so within its group it moves behind all that are pointed at
less.  In the end a group holds the suffixes of one Lyndon prefix, and groups are in order.

The second phase goes through the suffixes in ascending order, as they become known, and
puts in place those whose Lyndon prefix ends there; they are met along the pointers.
"""

from __future__ import annotations

import numpy as np


def grouped_suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffix array of ``symbols``, whose last one must be smaller than all others."""
    n = len(symbols)
    if n == 1:
        return np.zeros(1, np.int64)
    _, value = np.unique(symbols, return_inverse=True)
    sizes = np.bincount(value)
    starts = np.cumsum(sizes) - sizes
    # A group is named by its first place in ``order``.
    order = np.argsort(value, kind="stable").tolist()
    group = starts[value].tolist()
    place = [0] * n
    for at, suffix in enumerate(order):
        place[suffix] = at
    end = dict(zip(starts.tolist(), (starts + sizes).tolist(), strict=True))
    before = [-1] * n

    high = n
    while high > 0:
        low = group[order[high - 1]]
        members = order[low:high]
        members.sort()
        pointed: dict[int, int] = {}
        for i in members:
            p = i - 1
            while p >= 0 and group[p] >= low:
                p = before[p]
            before[i] = p
            if p >= 0:
                pointed[p] = pointed.get(p, 0) + 1
        if pointed:
            by_count: dict[int, list[int]] = {}
            for p, k in pointed.items():
                by_count.setdefault(k, []).append(p)
            for k in sorted(by_count, reverse=True):
                moved: dict[int, int] = {}
                chosen = by_count[k]
                for p in chosen:
                    g = group[p]
                    last = moved[g] = moved.get(g, end[g]) - 1
                    here, other = place[p], order[last]
                    order[here], order[last] = other, p
                    place[other], place[p] = here, last
                for p in chosen:
                    g = group[p]
                    new = moved[g]
                    if new != g:
                        group[p] = new
                for g, new in moved.items():
                    if new != g:
                        end[new] = end[g]
                        end[g] = new
        high = low

    result = [-1] * n
    result[0] = n - 1
    done = bytearray(n)
    done[n - 1] = 1
    free = dict.fromkeys(end, 0)
    for at in range(n):
        s = result[at] - 1
        while s >= 0 and not done[s]:
            g = group[s]
            result[g + free[g]] = s
            free[g] += 1
            done[s] = 1
            s = before[s]
    return np.array(result, np.int64)
