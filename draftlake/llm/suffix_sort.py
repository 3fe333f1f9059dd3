"""Suffix arrays by induced sorting, and permuted common prefixes.

Suffixes are classified as smaller (S) or larger (L) than the next; the leftmost S of each run starts a substring, the
substrings are sorted by inducing once from any order and named; while names repeat, the reduced text of the names is
sorted in the same way; inducing from that order gives the whole array. Each level is at most half as long as the one
above it, so the whole is linear. The bytes' level has few characters and induces a bucket's entries at once, in numpy;
the levels below have about as many names as entries and induce one entry at a time, in arrays of 32-bit integers.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable

import numpy as np


def _induce_buckets(t: np.ndarray, smaller: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """All suffixes from the order of those at ``starts`` (leftmost smaller ones)."""
    n = len(t)
    count = np.bincount(t, minlength=size)
    end = np.cumsum(count)
    begin = end - count
    sa = np.full(n, -1, np.int64)

    def put(j: np.ndarray, at: np.ndarray, step: int) -> None:
        """Appends j to its characters' buckets, in order, upwards or downwards."""
        c = t[j]
        order = np.argsort(c, kind="stable")
        c, j = c[order], j[order]
        first = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
        runs = np.diff(np.r_[first, len(c)])
        nth = np.arange(len(c)) - np.repeat(first, runs)
        sa[at[c] + step * nth] = j
        at[c[first]] += step * runs

    # Larger suffixes, upwards, from the leftmost smaller ones at the ends of their buckets.
    by_char = np.argsort(t[starts], kind="stable")
    seeds, seed_at = starts[by_char], np.r_[0, np.cumsum(np.bincount(t[starts], minlength=size))]
    low = begin.copy()
    for c in np.flatnonzero(count).tolist():
        done = begin[c]
        while done < low[c]:
            j = sa[done : low[c]] - 1
            done = low[c]
            j = j[j >= 0]
            if len(j := j[~smaller[j]]):
                put(j, low, 1)
        j = seeds[seed_at[c] : seed_at[c + 1]] - 1
        if len(j := j[(j >= 0) & ~smaller[np.maximum(j, 0)]]):
            put(j, low, 1)
    # Smaller suffixes, downwards, from the larger ones.
    high = end - 1
    last = starts[t[starts] == 0]
    if len(last):  # the end mark, which no other suffix induces
        sa[high[0]] = last[0]
        high[0] -= 1
    for c in np.flatnonzero(count)[::-1].tolist():
        done = end[c] - 1
        while done > high[c]:
            j = sa[high[c] + 1 : done + 1][::-1] - 1
            done = high[c]
            j = j[j >= 0]
            if len(j := j[smaller[j]]):
                put(j, high, -1)
        j = sa[begin[c] : low[c]][::-1] - 1
        j = j[j >= 0]
        if len(j := j[smaller[j]]):
            put(j, high, -1)
    return sa


def _induce_entries(t: np.ndarray, smaller: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """The same for a text of many characters."""
    end = np.cumsum(np.bincount(t, minlength=size))
    chars, small = array("i", t.astype(np.int32).tobytes()), smaller.tobytes()
    sa = np.full(len(t), -1, np.int32)
    c = t[starts]
    by_char = np.argsort(c, kind="stable")
    upto = np.cumsum(np.bincount(c, minlength=size))
    sa[np.arange(len(starts)) + (end - upto)[c[by_char]]] = starts[by_char]
    sa = array("i", sa.tobytes())
    at = array("i", np.r_[0, end[:-1]].astype(np.int32).tobytes())
    for j in sa:  # grows ahead of the loop
        j -= 1
        if j >= 0 and not small[j]:
            c = chars[j]
            sa[at[c]] = j
            at[c] += 1
    # Every place of a smaller suffix but the end mark's is written again before it is read.
    at = array("i", end.astype(np.int32).tobytes())
    for j in reversed(sa):
        j -= 1
        if j >= 0 and small[j]:
            c = chars[j]
            at[c] -= 1
            sa[at[c]] = j
    return np.frombuffer(sa, np.int32).astype(np.int64)


def _sorted(t: np.ndarray, size: int, induce: Callable[[np.ndarray, np.ndarray, np.ndarray, int], np.ndarray]) -> np.ndarray:
    """Of a text of characters below ``size`` whose last one, 0, stands nowhere else."""
    n = len(t)
    step = np.sign(np.diff(t))  # 1: smaller than the next character; the end mark is smaller than all
    known = np.where(step != 0, np.arange(n - 1), n - 1)
    at = np.minimum.accumulate(known[::-1])[::-1]
    smaller = np.r_[step[np.minimum(at, n - 2)] > 0, True]
    starts = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    sa = induce(t, smaller, starts, size)
    if len(starts) == 1:
        return sa
    is_start = np.zeros(n, bool)
    is_start[starts] = True
    order = sa[is_start[sa]]
    length = np.zeros(n, np.int64)
    length[starts] = np.diff(np.r_[starts, n - 1]) + 1
    a, b = order[:-1], order[1:]
    same = length[a] == length[b]
    k, live = 0, np.flatnonzero(same)
    while len(live):
        differ = t[a[live] + k] != t[b[live] + k]
        same[live[differ]] = False
        k += 1
        live = live[~differ]
        live = live[length[a[live]] > k]
    name = np.empty(n, np.int64)
    name[order] = np.r_[0, np.cumsum(~same)]
    names = name[starts]
    most = int(names.max())
    reduced = np.argsort(names) if most == len(starts) - 1 else _sorted(names, most + 1, _induce_entries)
    return induce(t, smaller, starts[reduced], size)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Of a byte text; shorter suffixes come before those that continue them."""
    n = len(text)
    if n < 2:
        return np.arange(n)
    t = np.zeros(n + 1, np.int64)
    t[:n] = text.astype(np.int64) + 1
    return _sorted(t, 257, _induce_buckets)[1:]


def permuted_lcp(text: np.ndarray, sa: np.ndarray, forced: np.ndarray, most: int) -> np.ndarray:
    """For each position the common prefix with the suffix before it in the array.

    Where the preceding characters agree a value is one less than its left neighbour's; only the others, and the
    ``forced`` positions, are compared, up to ``most`` characters.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    i = np.arange(n)
    carried = (i > 0) & (before > 0)
    carried[carried] = text[i[carried] - 1] == text[before[carried] - 1]
    carried[forced] = False
    first = np.flatnonzero(~carried)
    value = np.zeros(n, np.int64)
    live, k = first[before[first] >= 0], 0
    while len(live) and k < most:
        live = live[(live + k < n) & (before[live] + k < n)]
        live = live[text[live + k] == text[before[live] + k]]
        k += 1
        value[live] = k
    anchor = np.maximum.accumulate(np.where(carried, 0, i))
    return np.maximum(value[anchor] - (i - anchor), 0)
