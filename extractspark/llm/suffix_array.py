"""Suffix arrays by induced sorting, in vector steps, and permuted common prefixes.

A suffix is S-type if it is less than the next one, else L-type; leftmost S-types (LMS) start the substrings that are
sorted by inducing, named, and sorted recursively by their names if names repeat; a second inducing orders all suffixes.

Inducing walks the buckets of equal first letters in order. A step takes as many buckets as have no suffix that induces
one inside the step, so the order is that of the sequential walk; a bucket that induces into itself (a run of one letter)
is taken alone, in rounds. Each suffix is induced once, so the work is linear.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of text (non-negative integers) in their order; a suffix precedes those it begins."""
    if len(text) < 2:
        return np.arange(len(text))
    ended = np.zeros(len(text) + 1, np.uint16 if int(text.max()) < 65535 else np.int64)
    ended[:-1] = text
    ended[:-1] += 1
    return _sorted(ended, int(text.max()) + 2)[1:]


def _sorted(text: np.ndarray, letters: int) -> np.ndarray:
    """For a text whose last letter, 0, is nowhere else."""
    n = len(text)
    small = np.uint8 if letters <= 256 else np.uint16 if letters <= 65536 else np.int32
    text = text.astype(small)
    # The type of a run of equal letters is that of its last: find the next place with another letter.
    differs = np.flatnonzero(text[1:] != text[:-1])
    is_s = np.zeros(n, bool)
    is_s[-1] = True
    up = text[differs] < text[differs + 1]
    is_s[:-1] = np.repeat(np.append(up, False), np.diff(np.concatenate([[-1], differs, [n - 2]])))[: n - 1] if len(differs) else False
    is_lms = is_s.copy()
    is_lms[0] = False
    is_lms[1:] &= ~is_s[:-1]
    lms = np.flatnonzero(is_lms)
    ends = np.cumsum(np.bincount(text, minlength=letters))
    order = _induced(text, is_s, ends, lms, letters)
    if len(lms) > 1:
        by_name = order[is_lms[order]]
        names, distinct = _named(text, lms, by_name)
        if distinct < len(lms):
            lms = lms[_sorted(names, distinct)]
        else:
            lms = by_name
        order = _induced(text, is_s, ends, lms, letters)
    return order


def _named(text: np.ndarray, lms: np.ndarray, by_order: np.ndarray) -> tuple[np.ndarray, int]:
    """Names of the LMS substrings, in text order, equal for equal substrings and ordered like them."""
    n = len(text)
    place = np.empty(n, np.int64)
    place[lms] = np.arange(len(lms))
    stop = np.append(lms[1:], n - 1)  # each substring ends with the next one's first letter
    length = (stop - lms + 1)[place[by_order]]
    same = length[1:] == length[:-1]
    a, b = by_order[:-1], by_order[1:]
    live = np.flatnonzero(same)
    k = 0
    while len(live):
        equal = text[a[live] + k] == text[b[live] + k]
        same[live[~equal]] = False
        k += 1
        live = live[equal]
        live = live[length[live] > k]
    name = np.concatenate([[0], np.cumsum(~same)])
    names = np.empty(len(lms), np.int64)
    names[place[by_order]] = name
    return names, int(name[-1]) + 1


def _put(array: np.ndarray, free: np.ndarray, what: np.ndarray, letters: np.ndarray, step: int) -> None:
    """Place what, in order, at the free ends of its letters' buckets."""
    if not len(what):
        return
    order = np.argsort(letters, kind="stable")
    ordered = letters[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    counts = np.diff(np.append(first, len(ordered)))
    heads = ordered[first]
    within = np.arange(len(ordered)) - np.repeat(first, counts)
    array[np.repeat(free[heads], counts) + step * within] = what[order]
    free[heads] += step * counts


def _induced(text: np.ndarray, is_s: np.ndarray, ends: np.ndarray, lms: np.ndarray, letters: int) -> np.ndarray:
    """All suffixes in the order that the given order of the LMS suffixes induces."""
    n = len(text)
    starts = np.concatenate([[0], ends[:-1]])
    out = np.full(n, -1, np.int64 if n > 1 << 31 else np.int32)
    seeds = ends - 1
    _put(out, seeds, lms[::-1], text[lms[::-1]], -1)
    # L-types, from the least bucket up.
    free = starts.copy()
    c, width = 0, 1
    while c < letters:
        stop = min(c + width, letters)
        part = out[starts[c] : ends[stop - 1]]
        before = part[part >= 0] - 1
        before = before[before >= 0]
        before = before[~is_s[before]]
        ch = text[before]
        inside = ch < stop
        if inside.any():
            t = int(ch[inside].min())
            if t > c:
                fit = text[before + 1] < t
                _put(out, free, before[fit], ch[fit], 1)
                c, width = t, max(1, (t - c) // 2)
                continue
            # The bucket c induces into itself: its L-types in rounds, then its seeds.
            done = int(starts[c])
            while done < free[c]:
                wave = out[done : free[c]]
                done = int(free[c])
                before = wave - 1
                before = before[before >= 0]
                before = before[~is_s[before]]
                _put(out, free, before, text[before], 1)
            wave = out[done : ends[c]]
            before = wave[wave >= 0] - 1
            before = before[before >= 0]
            before = before[~is_s[before]]
            _put(out, free, before, text[before], 1)
            c, width = c + 1, 1
            continue
        _put(out, free, before, ch, 1)
        width = (stop - c) * 2
        c = stop
    # S-types, from the greatest bucket down; the seeds go.
    for_s = ends - 1
    gaps = np.ones(n, bool)
    where = free - starts
    gaps[np.repeat(starts, where) + np.arange(int(where.sum())) - np.repeat(np.cumsum(where) - where, where)] = False
    out[gaps] = -1
    out[0] = n - 1  # the sentinel
    for_s[0] = -1
    c, width = letters, 1
    while c > 0:
        low = max(0, c - width)
        part = out[starts[low] : ends[c - 1]][::-1]
        before = part[part >= 0] - 1
        before = before[before >= 0]
        before = before[is_s[before]]
        ch = text[before]
        inside = ch >= low
        if inside.any():
            t = int(ch[inside].max())
            if t < c - 1:
                fit = text[before + 1] > t
                _put(out, for_s, before[fit], ch[fit], -1)
                c, width = t + 1, max(1, (c - t - 1) // 2)
                continue
            b = c - 1
            done = int(ends[b]) - 1
            while done > for_s[b]:
                wave = out[for_s[b] + 1 : done + 1][::-1]
                done = int(for_s[b])
                before = wave - 1
                before = before[before >= 0]
                before = before[is_s[before]]
                _put(out, for_s, before, text[before], -1)
            wave = out[starts[b] : done + 1][::-1]
            before = wave[wave >= 0] - 1
            before = before[before >= 0]
            before = before[is_s[before]]
            _put(out, for_s, before, text[before], -1)
            c, width = b, 1
            continue
        _put(out, for_s, before, ch, -1)
        width = (c - low) * 2
        c = low
    return out


def common_prefixes(text: np.ndarray, order: np.ndarray, firsts: np.ndarray, limit: int) -> np.ndarray:
    """Permuted common prefixes: for each place of the text, how much its suffix shares with the one before it in order.

    At most limit. The text is cut into parts that start at firsts; a part's places are walked from left to right, each
    starting from what the place before had, less one; all parts are walked at the same time.
    """
    n = len(text)
    before = np.full(n, -1, np.int64 if n > 1 << 31 else np.int32)
    before[order[1:]] = order[:-1]
    out = np.zeros(n, np.int16 if limit < 1 << 15 else np.int32)
    at, stops = firsts.astype(np.int64), np.append(firsts[1:], n).astype(np.int64)
    shared = np.zeros(len(at), np.int64)
    while len(at):
        other = before[at]
        shared[other < 0] = 0
        live = np.flatnonzero(other >= 0)
        while len(live):
            a, b, h = at[live], other[live], shared[live]
            fits = (h < limit) & (a + h < n) & (b + h < n)
            live, a, b, h = live[fits], a[fits], b[fits], h[fits]
            live = live[text[a + h] == text[b + h]]
            shared[live] += 1
        out[at] = shared
        at = at + 1
        more = at < stops
        at, stops, shared = at[more], stops[more], np.maximum(shared[more] - 1, 0)
    return out
