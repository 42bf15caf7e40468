"""Suffix arrays by induced sorting, and permuted common prefixes, in array operations.

Suffixes are classified as smaller (S) or larger (L) than their right neighbour; leftmost S suffixes (LMS) split the
text. Their substrings are sorted by inducing, named, and the string of names is sorted recursively, unless all names
differ. From the order of the LMS suffixes that of all L and then of all S suffixes is induced. An inducing pass
takes the buckets in order and a bucket in waves: all entries of a wave hand their left neighbours on at once, so
the number of array operations follows the alphabet and the longest run, not the text.
"""

from __future__ import annotations

import numpy as np

#: Below this mean bucket size a recursion's waves are too short to pay; its string is then sorted by doubling.
MEAN_BUCKET = 512


def _next_true(mask: np.ndarray) -> np.ndarray:
    """For each place the first true place at or after it; the length where there is none."""
    at = np.where(mask, np.arange(len(mask)), len(mask))
    return np.minimum.accumulate(at[::-1])[::-1]


def _types(s: np.ndarray) -> np.ndarray:
    """True for S suffixes; the last one, a unique smallest symbol, is one."""
    rises = np.diff(s)
    settled = np.append(rises != 0, True)
    where = _next_true(settled)
    return np.append(rises > 0, True)[where]


def _place(target: np.ndarray, items: np.ndarray, keys: np.ndarray, edge: np.ndarray, step: int) -> None:
    """Put items into the buckets of their keys in order, from the edges inwards, and move the edges."""
    order = np.argsort(keys, kind="stable")
    sorted_keys = keys[order]
    first = np.flatnonzero(np.append(True, sorted_keys[1:] != sorted_keys[:-1]))
    counts = np.diff(np.append(first, len(keys)))
    rank = np.arange(len(keys)) - np.repeat(first, counts)
    target[edge[sorted_keys] + step * rank] = items[order]
    edge[sorted_keys[first]] += step * counts


def _induce(s: np.ndarray, small: np.ndarray, starts: np.ndarray, ends: np.ndarray, used: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """The suffix array from LMS suffixes in the order given."""
    sa = np.full(len(s), -1, dtype=np.int64)
    tail = ends - 1
    _place(sa, lms[::-1], s[lms[::-1]], tail, -1)
    head = starts.copy()
    for c in used.tolist():  # L suffixes, from small to large
        done = starts[c]
        while True:
            wave, same = sa[done : head[c]], True
            if not len(wave):
                wave, same = sa[tail[c] + 1 : ends[c]], False  # the LMS suffixes of the bucket come last
            done += len(wave) * same
            left = wave[wave > 0] - 1
            left = left[~small[left]]
            if len(left):
                _place(sa, left, s[left], head, 1)
            if not same:
                break
    tail = ends - 1
    for c in used[::-1].tolist():  # S suffixes, from large to small
        done, l_end = ends[c], head[c]
        while True:
            wave, same = sa[tail[c] + 1 : done][::-1], True
            if not len(wave):
                wave, same = sa[starts[c] : l_end][::-1], False
            done -= len(wave) * same
            left = wave[wave > 0] - 1
            left = left[small[left]]
            if len(left):
                _place(sa, left, s[left], tail, -1)
            if not same:
                break
    if len(s):
        sa[0] = len(s) - 1
    return sa


def _doubled(s: np.ndarray) -> np.ndarray:
    """The suffix array by prefix doubling."""
    rank, width = np.unique(s, return_inverse=True)[1].astype(np.int64), 1
    while True:
        key = rank * (len(s) + 1) + np.append(rank[width:] + 1, np.zeros(min(width, len(s)), dtype=np.int64))
        sa = np.argsort(key, kind="stable")
        fresh = np.append(False, np.diff(key[sa]) != 0)
        rank[sa] = np.cumsum(fresh)
        if rank[sa[-1]] == len(s) - 1:
            return sa
        width *= 2


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of s in order. s: non-negative integers; the last one is 0 and occurs once."""
    s = s.astype(np.int64)
    n = len(s)
    if n < 3:
        return np.argsort(s, kind="stable")
    small = _types(s)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    counts = np.bincount(s)
    ends = np.cumsum(counts)
    starts, used = ends - counts, np.flatnonzero(counts)
    if len(lms) > 1:
        rough = _induce(s, small, starts, ends, used, lms)
        is_lms = np.zeros(n, dtype=bool)
        is_lms[lms] = True
        order = rough[is_lms[rough]]
        names = _names(s, small, lms, order)
        by_place = names[np.argsort(order, kind="stable")]  # names in the order of the text
        if names[-1] + 1 == len(lms):
            lms = order
        elif len(lms) >= MEAN_BUCKET * (names[-1] + 1):
            lms = lms[suffix_array(by_place)]
        else:
            lms = lms[_doubled(by_place)]
    return _induce(s, small, starts, ends, used, lms)


def _names(s: np.ndarray, small: np.ndarray, lms: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Ranks of the sorted LMS substrings: equal ones share a rank."""
    length = np.zeros(len(s), dtype=np.int64)
    length[lms] = np.append(np.diff(lms), 0)
    a, b = order[:-1], order[1:]
    differ = (length[a] != length[b]) | (length[a] == 0)
    going, k = np.flatnonzero(~differ), 0
    while len(going):
        x, y = a[going] + k, b[going] + k
        apart = (s[x] != s[y]) | (small[x] != small[y])
        differ[going[apart]] = True
        going = going[~apart]
        going = going[length[a[going]] > k]
        k += 1
    return np.append(0, np.cumsum(differ))


def permuted_common_prefixes(s: np.ndarray, sa: np.ndarray, limit: int) -> np.ndarray:
    """For each suffix of s, in the order of the text, its common prefix with the one before it in sa; at most `limit`.

    s: symbols below 2**16, the last one 0 and unique. Where a suffix and the one before it in sa have the same left
    neighbour, the common prefix is that of the place to the left, less one, and is carried from there. The others are
    compared, four symbols at a time and all at once; their prefixes sum to n log n at most, in any text.
    """
    n = len(s)
    before = np.full(n, -1, dtype=np.int64)
    before[sa[1:]] = sa[:-1]
    places = np.arange(n)
    left, other = s[np.maximum(places - 1, 0)], s[np.maximum(before - 1, 0)]
    compared = (places == 0) | (before <= 0) | (left != other)
    padded = np.concatenate([s.astype("<u2"), np.zeros(8, dtype="<u2")])
    words = np.ascontiguousarray(np.ndarray((n + 4,), dtype="<u8", buffer=padded.data, strides=(2,)))
    found, going, k = np.zeros(n, dtype=np.int64), np.flatnonzero(compared & (before >= 0)), 0
    while len(going):
        apart = words[going + k] ^ words[before[going] + k]
        odd = apart != 0
        low = apart[odd] & (~apart[odd] + np.uint64(1))
        found[going[odd]] = k + (np.log2(low.astype(np.float64)).astype(np.int64) >> 4)
        going, k = going[~odd], k + 4
    origin = np.maximum.accumulate(np.where(compared, places, 0))
    return np.minimum(found[origin] - (places - origin), limit)
