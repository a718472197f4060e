"""Suffix arrays by induced sorting, and permuted common prefixes, over whole numpy arrays.

Induction over bytes goes through the buckets of the bytes in order. All suffixes that wait in a bucket are taken at once;
those that they induce are dealt to their buckets by a stable sort of bytes. A suffix induced into the same bucket waits
for the next round, so a bucket takes as many rounds as its longest run of one byte, and all of it is linear in the text.
The names of leftmost-smaller substrings are a shorter text, sorted by recursion; its buckets are many and short, so they
are induced entry by entry.
"""

from __future__ import annotations

import numpy as np

#: Alphabets of fewer letters are induced by whole buckets, others entry by entry; both give the same.
FEW = 256


def _types(s: np.ndarray) -> np.ndarray:
    """True for suffixes that are smaller than the next one, by run: a run has the type of its last member. The end of the text is smaller than all."""
    n = len(s)
    ends = np.flatnonzero(np.concatenate([s[1:] != s[:-1], [True]]))
    kind = np.empty(len(ends), bool)
    kind[:-1] = s[ends[:-1]] < s[ends[:-1] + 1]
    kind[-1] = False
    return np.repeat(kind, np.diff(np.concatenate([[-1], ends]))) if n else np.zeros(0, bool)


def _deal(sa: np.ndarray, place: np.ndarray, items: np.ndarray, byte: np.ndarray, step: int) -> None:
    """Put items, in their order, at the ends of their buckets; place: the next free entry of each bucket, moving by step."""
    order = np.argsort(byte, kind="stable")
    byte, items = byte[order], items[order]
    count = np.bincount(byte, minlength=len(place))
    within = np.arange(len(byte)) - np.repeat(np.cumsum(count) - count, count)
    sa[place[byte] + step * within] = items
    place += step * count


def _by_bucket(s: np.ndarray, small: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """Induction over an alphabet of few letters: whole buckets at once."""
    n, count = len(s), np.bincount(s, minlength=FEW)
    end = np.cumsum(count)
    start = end - count
    sa = np.full(n, -1, np.int32)
    tail = end - 1
    _deal(sa, tail, lms[::-1], s[lms[::-1]], -1)
    head = start.copy()
    first_small = tail + 1
    _deal(sa, head, np.array([n - 1], np.int32), s[n - 1 :], 1)  # what the end induces
    buckets = np.flatnonzero(count)
    for c in buckets:
        at = start[c]
        while at < head[c]:
            wait = sa[at : head[c]]
            at = head[c]
            before = wait[wait > 0] - 1
            before = before[~small[before]]
            if len(before):
                _deal(sa, head, before, s[before], 1)
        wait = sa[first_small[c] : end[c]]
        before = wait[wait > 0] - 1
        before = before[~small[before]]
        if len(before):
            _deal(sa, head, before, s[before], 1)
    tail = end - 1
    for c in buckets[::-1]:
        at = end[c]
        while at > tail[c] + 1:
            wait = sa[tail[c] + 1 : at][::-1]
            at = tail[c] + 1
            before = wait[wait > 0] - 1
            before = before[small[before]]
            if len(before):
                _deal(sa, tail, before, s[before], -1)
        wait = sa[start[c] : head[c]][::-1]
        before = wait[wait > 0] - 1
        before = before[small[before]]
        if len(before):
            _deal(sa, tail, before, s[before], -1)
    return sa


def _by_entry(s: np.ndarray, small: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """Induction over an alphabet of many letters, whose buckets are short: entry by entry."""
    n, end = len(s), np.cumsum(np.bincount(s))
    head, tail = np.concatenate([[0], end[:-1]]).tolist(), end.tolist()
    text, kind, sa = s.tolist(), small.tolist(), [-1] * n
    for i in reversed(lms.tolist()):
        tail[text[i]] -= 1
        sa[tail[text[i]]] = i
    sa[head[text[-1]]] = n - 1  # what the end induces
    head[text[-1]] += 1
    for i in sa:  # sees what it writes ahead of itself
        if i > 0 and not kind[i - 1]:
            c = text[i - 1]
            sa[head[c]] = i - 1
            head[c] += 1
    tail = end.tolist()
    for at in range(n - 1, -1, -1):
        i = sa[at]
        if i > 0 and kind[i - 1]:
            c = text[i - 1]
            tail[c] -= 1
            sa[tail[c]] = i - 1
    return np.array(sa, np.int32)


def induced(s: np.ndarray, small: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """The suffix array from leftmost-smaller suffixes in order; from such in any order, one sorted by leftmost-smaller substrings."""
    return (_by_bucket if s.max() < FEW else _by_entry)(s, small, lms)


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Of a text of whole numbers from 0; a suffix that is a prefix of another comes first."""
    n = len(s)
    if n < 2:
        return np.arange(n, dtype=np.int32)
    small = _types(s)
    lms = (np.flatnonzero(small[1:] & ~small[:-1]) + 1).astype(np.int32)
    if len(lms) > 1:
        by_substring = induced(s, small, lms)
        is_lms = np.zeros(n, bool)
        is_lms[lms] = True
        order = by_substring[is_lms[by_substring]]
        size = np.empty(n, np.int32)
        size[lms] = np.concatenate([np.diff(lms) + 1, [0]])  # the last one reaches the end: like no other
        a, b = order[:-1], order[1:]
        same = size[a] == size[b]
        a, b, m = a[same], b[same], size[a[same]]
        if len(a):
            step = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
            differ = s[np.repeat(a, m) + step] != s[np.repeat(b, m) + step]
            same[np.flatnonzero(same)] = np.add.reduceat(differ, np.cumsum(m) - m) == 0
        name = np.empty(n, np.int32)
        name[order] = np.concatenate([[0], np.cumsum(~same)])
        names = name[lms]
        if names.max() + 1 < len(lms):
            lms = lms[suffix_array(names.astype(np.uint8 if names.max() < FEW else np.int32))]
        else:
            lms = order
    return induced(s, small, lms)


def common_prefixes(s: np.ndarray, sa: np.ndarray, separator: int = 0) -> np.ndarray:
    """For each entry of the suffix array, its common prefix with the entry before; a separator matches nothing.

    In text order, a value is one less than the last one unless the bytes before the two suffixes differ; only such
    irreducible values are compared byte by byte, and the rest follow.
    """
    n = len(s)
    if n == 0:
        return np.zeros(0, np.int64)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    i = np.arange(n)
    reducible = (i > 0) & (before > 0)
    at = np.flatnonzero(reducible)
    reducible[at] = (s[at - 1] == s[before[at] - 1]) & (s[at - 1] != separator)
    live = np.flatnonzero(~reducible & (before >= 0))
    value = np.zeros(n, np.int64)
    while len(live):
        a, b = live + value[live], before[live] + value[live]
        inside = (a < n) & (b < n)
        live, a, b = live[inside], a[inside], b[inside]
        live = live[(s[a] == s[b]) & (s[a] != separator)]
        value[live] += 1
    last = np.maximum.accumulate(np.where(reducible, 0, i))
    permuted = np.maximum(value[last] - (i - last), 0)
    return permuted[sa]
