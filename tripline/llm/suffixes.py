"""Suffix arrays by induced sorting (SA-IS) and permuted common prefixes, in numpy.

Suffixes are classified as smaller (S) or larger (L) than their right neighbour; leftmost S suffixes (LMS) are sorted by their substrings,
recursively where names repeat; all others are induced from them in linear time.  The scans of the induction run over
blocks of the suffix array: a block ends where one of its own insertions would land, so every entry is final when it is read.
"""

from __future__ import annotations

import numpy as np


def _ranks(c: np.ndarray) -> np.ndarray:
    """For each entry how many equal ones precede it."""
    order = np.argsort(c.astype(np.uint16) if len(c) and c.max() < 1 << 16 else c, kind="stable")  # 16 bits sort by radix
    s = c[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    here = np.arange(len(s))
    rank = np.empty(len(s), np.int64)
    rank[order] = here - np.maximum.accumulate(np.where(new, here, 0))
    return rank


def _induce_larger(text: np.ndarray, larger: np.ndarray, sa: np.ndarray, head: np.ndarray) -> None:
    """Left to right: each suffix puts its left neighbour, if of type L, at the head of that one's bucket."""
    n, i, m = len(sa), 0, 4096
    while i < n:
        hi = min(i + m, n)
        source = np.flatnonzero(sa[i:hi] > 0)
        j = sa[i:hi][source] - 1
        keep = larger[j]
        source, j = source[keep], j[keep]
        c = text[j]
        to = head[c] + _ranks(c)
        cut = hi
        if len(to):
            cut = min(hi, int(to.min()))
            if cut < hi:
                k = int(np.searchsorted(source, cut - i))
                j, to, c = j[:k], to[:k], c[:k]
            sa[to] = j
            head[c] = to + 1  # of equal ones the last counts
        m = min(max(2 * (cut - i), 256), 1 << 17)
        i = cut


def _induce_smaller(text: np.ndarray, larger: np.ndarray, sa: np.ndarray, tail: np.ndarray) -> None:
    """Right to left: each suffix puts its left neighbour, if of type S, at the tail of that one's bucket."""
    i, m = len(sa), 4096
    while i > 0:
        lo = max(i - m, 0)
        block = sa[lo:i][::-1]
        source = np.flatnonzero(block > 0)
        j = block[source] - 1
        keep = ~larger[j]
        source, j = source[keep], j[keep]
        c = text[j]
        to = tail[c] - 1 - _ranks(c)
        cut = lo
        if len(to):
            cut = max(lo, int(to.max()) + 1)
            if cut > lo:
                k = int(np.searchsorted(source, i - cut))
                j, to, c = j[:k], to[:k], c[:k]
            sa[to] = j
            tail[c] = to
        m = min(max(2 * (i - cut), 256), 1 << 17)
        i = cut


def _sort_substrings(text: np.ndarray, larger: np.ndarray, lms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """LMS positions in the order of their substrings (each up to the next LMS position), and names, equal for equal ones.

    Several symbols with their types (L before S) make one sort key; only groups that still agree are sorted by the next ones.
    """
    n, count = len(text), len(lms)
    length = np.append(lms[1:], n - 1) - lms + 1
    bits = int(2 * int(text.max()) + 1).bit_length()
    per = 63 // bits
    order = np.arange(count)
    same = np.zeros(count, bool)  # as the one before
    same[1:] = True
    slots = np.arange(count)
    done = 0
    while len(slots):
        who = order[slots]
        key = np.zeros(len(slots), np.int64)
        for k in range(done, done + per):
            at = np.minimum(lms[who] + k, n - 1)
            key = key << bits | np.where(k < length[who], 2 * text[at].astype(np.int64) + ~larger[at], 0)
        group = np.cumsum(~same[slots])
        by = np.lexsort((key, group)) if done else np.argsort(key, kind="stable")
        order[slots] = who = who[by]
        key, group = key[by], group[by]
        new = np.ones(len(slots), bool)
        new[1:] = (key[1:] != key[:-1]) | (group[1:] != group[:-1])
        same[slots] = ~new
        done += per
        # groups of several whose substrings go on
        open_ = length[who] > done
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(slots)))
        slots = slots[np.repeat((size > 1) & open_[first], size)]
    return lms[order], (np.cumsum(~same) - 1).astype(text.dtype)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array of non-negative integers; the last one must be 0 and the only 0."""
    n = len(text)
    kind = np.int32 if n < 1 << 31 else np.int64
    text = text.astype(kind, copy=False)
    if n == 1:
        return np.zeros(1, np.int64)
    # types: compare with the next different value
    sign = np.empty(n, np.int8)
    sign[:-1] = np.sign(text[:-1] - text[1:])
    sign[-1] = -1
    at = np.where(sign != 0, np.arange(n, dtype=kind), kind(n - 1))
    at = np.minimum.accumulate(at[::-1])[::-1]
    larger = sign[at] > 0
    lms = np.flatnonzero(~larger[1:] & larger[:-1]) + 1
    count = np.bincount(text)
    end = np.cumsum(count)
    begin = end - count

    def induced(order: np.ndarray) -> np.ndarray:
        sa = np.full(n, -1, kind)
        c = text[order]
        rank = _ranks(c[::-1])
        sa[end[c] - 1 - rank[::-1]] = order
        _induce_larger(text, larger, sa, begin.copy())
        placed = np.flatnonzero(sa >= 0)
        sa[placed[~larger[sa[placed]]]] = -1
        sa[0] = n - 1  # the sentinel; nothing induces it
        tail = end.copy()
        tail[0] = 0
        _induce_smaller(text, larger, sa, tail)
        return sa

    order, name = _sort_substrings(text, larger, lms)
    if name[-1] + 1 < len(lms):
        names = np.zeros(n, kind)
        names[order] = name
        order = lms[suffix_array(names[lms])]
    return induced(order)


def common_prefixes(text: np.ndarray, sa: np.ndarray, start: np.ndarray, length: np.ndarray, most: int) -> np.ndarray:
    """Permuted common prefixes, at most ``most``: how far the suffix at each position agrees with the one before it in the suffix array.

    A position's prefix is at most one shorter than the last position's; pieces (``start``, ``length``) advance side by side.
    Positions outside the pieces stay 0.
    """
    n = len(text)
    before = np.full(n, -1, sa.dtype)
    before[sa[1:]] = sa[:-1]
    out = np.zeros(n, np.int16 if most < 1 << 15 else np.int64)
    order = np.argsort(-length, kind="stable")
    start, length = start[order], length[order]
    have = np.zeros(len(start), np.int64)
    for t in range(int(length[0]) if len(length) else 0):
        k = int(np.searchsorted(-length, -t, side="left"))
        at = start[:k] + t
        have = np.maximum(have[:k] - 1, 0)
        other = before[at]
        alive = np.flatnonzero(other >= 0)
        have[other < 0] = 0
        while len(alive):
            alive = alive[(have[alive] < most) & (np.maximum(at[alive], other[alive]) + have[alive] < n)]
            alive = alive[text[at[alive] + have[alive]] == text[other[alive] + have[alive]]]
            have[alive] += 1
        out[at] = have
    return out
