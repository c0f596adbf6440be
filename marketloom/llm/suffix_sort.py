"""Sorting of fixed-length substrings by hash-compared suffixes.

Two substrings are compared by their longest common extension, found by binary search over prefix polynomial hashes:
logarithmically many look-ups for any length.  A bottom-up mergesort works on all groups of substrings at once, one
array step a level; equal neighbours are verified byte by byte, so a collision of hashes can't pass for a match.
Substrings whose hash no other of their group has are equal to none, and are left out of the sort.
"""

from __future__ import annotations

from copy import copy

import numpy as np

from .rolling import between, mix, prefix_hashes


class Comparer:
    """Order of substrings of ``data``, given by where they start; those that are compared are equally long."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
        self.data, self.starts, self.lengths = data, starts, lengths
        self.prefix = prefix_hashes(data)
        self.hashes = between(self.prefix, starts, starts + lengths)

    def take(self, at: np.ndarray) -> Comparer:
        """The comparer of some of the substrings."""
        out = copy(self)
        out.starts, out.lengths, out.hashes = self.starts[at], self.lengths[at], self.hashes[at]
        return out

    def extension(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Length of the longest common extension from each pair of places, up to ``most``."""
        low, high = np.zeros(len(a), np.int64), most.copy()
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                return low
            x, y, middle = a[open_], b[open_], (low[open_] + high[open_] + 1) // 2
            same = between(self.prefix, x, x + middle) == between(self.prefix, y, y + middle)
            low[open_[same]] = middle[same]
            high[open_[~same]] = middle[~same] - 1

    def less(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(i < j, i == j) for each pair of substrings, given by number."""
        equal = self.hashes[i] == self.hashes[j]
        out = np.zeros(len(i), bool)
        rest = np.flatnonzero(~equal)
        x, y = self.starts[i[rest]], self.starts[j[rest]]
        at = self.extension(x, y, self.lengths[i[rest]] - 1)
        out[rest] = self.data[x + at] < self.data[y + at]
        return out, equal

    def same_bytes(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether the substrings of each pair are equal, byte by byte."""
        out = np.ones(len(i), bool)
        for s in range(0, len(i), 50_000):
            n = self.lengths[i[s : s + 50_000]]
            begin = np.cumsum(n) - n
            steps = np.arange(n.sum())
            x, y = np.repeat(self.starts[i[s : s + 50_000]] - begin, n), np.repeat(self.starts[j[s : s + 50_000]] - begin, n)
            out[s : s + 50_000] = np.logical_and.reduceat(self.data[x + steps] == self.data[y + steps], begin)
        return out


def sort_groups(compare: Comparer, group: np.ndarray) -> np.ndarray:
    """Order of the comparer's substrings by group, then by content; ties keep their order.

    ``group`` must ascend, and the substrings of a group be equally long.
    """
    n = len(group)
    order = np.arange(n)
    first = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if n else np.zeros(0, np.int64)
    size = np.diff(np.append(first, n))
    begin, within = np.repeat(first, size), np.arange(n) - np.repeat(first, size)
    end = np.repeat(first + size, size)
    largest, width = int(size.max()) if n else 0, 1
    while width < largest:
        run = within // width
        other = begin + (run ^ 1) * width  # the sibling run
        has = other < end
        at = np.flatnonzero(has)
        from_left = run[at] % 2 == 0
        low = other[at].copy()
        high = np.minimum(low + width, end[at])
        base = low.copy()
        mine = order[at]
        # Binary search of each element's rank in its sibling run; on ties the left run comes first.
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                break
            middle = (low[open_] + high[open_]) // 2
            less, equal = compare.less(order[middle], mine[open_])
            before = less | (equal & ~from_left[open_])
            low[open_[before]] = middle[before] + 1
            high[open_[~before]] = middle[~before]
        place = np.arange(n)
        left_begin = begin[at] + (run[at] // 2) * 2 * width
        place[at] = left_begin + within[at] % width + (low - base)
        merged = np.empty(n, np.int64)
        merged[place] = order
        order = merged
        width *= 2
    return order


def may_repeat(hashes: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Numbers of the substrings whose hash another of their group may have; the others are equal to none."""
    keys = mix(hashes + mix(group.astype(np.uint64)))
    size = 1 << max(int(4 * len(keys) - 1).bit_length(), 1)
    slot = (keys & np.uint64(size - 1)).astype(np.int64)
    some = np.flatnonzero(np.bincount(slot, minlength=size)[slot] > 1)
    _, place, times = np.unique(keys[some], return_inverse=True, return_counts=True)
    return some[times[place] > 1]


def equal_runs(compare: Comparer, group: np.ndarray) -> np.ndarray:
    """A number for each substring, less than how many there are, equal where group and content are equal.

    Only substrings that may have an equal are sorted.
    """
    out = np.arange(len(group))
    some = may_repeat(compare.hashes, group)
    if not len(some):
        return out
    compare, group = compare.take(some), group[some]
    order = sort_groups(compare, group)
    a, b = order[:-1], order[1:]
    equal = (compare.hashes[a] == compare.hashes[b]) & (group[a] == group[b])
    check = np.flatnonzero(equal)
    equal[check] = compare.same_bytes(a[check], b[check])
    first = np.flatnonzero(np.append(True, ~equal))
    out[some[order]] = some[order[np.repeat(first, np.diff(np.append(first, len(order))))]]
    return out
