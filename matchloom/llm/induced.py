"""Suffix arrays by induced sorting, and permuted common prefixes."""

from __future__ import annotations

import numpy as np

#: Alphabets up to this size are induced bucket by bucket with array operations, larger ones (of names) entry by entry.
SMALL_ALPHABET = 400


def classify(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each suffix is smaller than the next (S-type), and the starts of leftmost-smaller (LMS) suffixes.

    text ends with its only 0.
    """
    n = len(text)
    step = np.sign(np.diff(text.astype(np.int64)))
    # Equal neighbours take the type of the next place that differs.
    at = np.where(step != 0, np.arange(n - 1), n)
    following = np.minimum.accumulate(at[::-1])[::-1] if n > 1 else at
    smaller = np.ones(n, bool)
    smaller[:-1] = step[np.minimum(following, n - 2)] > 0 if n > 1 else True
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    return smaller, lms


def _grouped(ch: np.ndarray, alphabet: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A stable order by character, each entry's place among its equals in that order, and counts."""
    order = np.argsort(ch, kind="stable")
    counts = np.bincount(ch, minlength=alphabet)
    first = np.cumsum(counts) - counts
    return order, np.arange(len(ch)) - first[ch[order]], counts


def _induce_buckets(text: np.ndarray, smaller: np.ndarray, sizes: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """The order of all suffixes from ordered LMS suffixes, one bucket after another.

    A bucket's own larger (L-type) suffixes come in waves, each from the one before, as in a left to
    right scan; what a finished bucket leads to is dealt to the later buckets in one stable step.
    """
    alphabet = len(sizes)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    out = np.empty(len(text), np.int32)
    kinds = text[seeds]
    cut = np.searchsorted(kinds, np.arange(alphabet + 1))  # seeds are in bucket order
    used = np.flatnonzero(sizes)

    head = starts.copy()
    for c in used:
        low = starts[c]
        while low < head[c]:
            before = out[low : head[c]] - 1
            low = head[c]
            before = before[before >= 0]
            same = before[(text[before] == c) & ~smaller[before]]
            out[head[c] : head[c] + len(same)] = same
            head[c] += len(same)
        before = np.concatenate([out[starts[c] : head[c]], seeds[cut[c] : cut[c + 1]]]) - 1
        before = before[before >= 0]
        ch = text[before]
        keep = ch > c
        before, ch = before[keep], ch[keep]
        if len(before):
            order, place, counts = _grouped(ch, alphabet)
            out[head[ch[order]] + place] = before[order]
            head += counts

    tail = ends.copy()
    out[0] = len(text) - 1
    tail[0] = starts[0]
    for c in used[::-1]:
        high = ends[c]
        while c and tail[c] < high:
            before = out[tail[c] : high][::-1] - 1
            high = tail[c]
            before = before[before >= 0]
            same = before[(text[before] == c) & smaller[before]]
            out[tail[c] - len(same) : tail[c]] = same[::-1]
            tail[c] -= len(same)
        before = np.concatenate([out[tail[c] : ends[c]][::-1], out[starts[c] : head[c]][::-1]]) - 1
        before = before[before >= 0]
        ch = text[before]
        keep = (ch < c) & smaller[before]
        before, ch = before[keep], ch[keep]
        if len(before):
            order, place, counts = _grouped(ch, alphabet)
            out[tail[ch[order]] - 1 - place] = before[order]
            tail -= counts
    return out


def _induce_entries(text: np.ndarray, smaller: np.ndarray, sizes: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """The same entry by entry: for alphabets whose buckets are too small for array operations."""
    n, t, s = len(text), text.tolist(), smaller.tolist()
    ends = np.cumsum(sizes)
    head, tail = (ends - sizes).tolist(), ends.tolist()
    out = [-1] * n
    for j in reversed(seeds.tolist()):
        c = t[j]
        tail[c] -= 1
        out[tail[c]] = j
    for i in range(n):
        j = out[i] - 1
        if j >= 0 and not s[j]:
            c = t[j]
            out[head[c]] = j
            head[c] += 1
    tail = ends.tolist()
    for i in range(n - 1, -1, -1):
        j = out[i] - 1
        if j >= 0 and s[j]:
            c = t[j]
            tail[c] -= 1
            out[tail[c]] = j
    out[0] = n - 1
    return np.array(out, np.int32)


def _names(text: np.ndarray, lms: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Numbers of the sorted LMS substrings, equal ones alike, in text order of ``lms``."""
    n = len(text)
    following = np.append(lms[1:], n - 1)
    length = np.zeros(n, np.int64)
    length[lms] = following - lms + 1
    a, b = ordered[:-1], ordered[1:]
    alike = length[a] == length[b]
    open_ = np.flatnonzero(alike)
    k = 0
    while len(open_):
        open_ = open_[length[a[open_]] > k]
        differ = text[a[open_] + k] != text[b[open_] + k]
        alike[open_[differ]] = False
        open_ = open_[~differ]
        k += 1
    number = np.empty(n, np.int64)
    number[ordered] = np.concatenate([[0], np.cumsum(~alike)])
    return number[lms]


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of all suffixes in order; text holds whole numbers from 0 and ends with its only 0."""
    n, alphabet = len(text), int(text.max()) + 1
    if n == 1:
        return np.zeros(1, np.int32)
    induce = _induce_buckets if alphabet <= SMALL_ALPHABET else _induce_entries
    smaller, lms = classify(text)
    sizes = np.bincount(text, minlength=alphabet)
    # Sort the LMS substrings by inducing from LMS starts in order of their first characters alone.
    found = induce(text, smaller, sizes, lms[np.argsort(text[lms], kind="stable")].astype(np.int32))
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    ordered = found[is_lms[found]]
    names = _names(text, lms, ordered)
    if names.max() + 1 == len(lms):
        seeds = ordered
    else:
        seeds = lms[suffix_array(names.astype(np.int32))].astype(np.int32)
    return induce(text, smaller, sizes, seeds)


def common_prefixes(text: np.ndarray, order: np.ndarray, stop: int) -> np.ndarray:
    """Permuted common prefixes: for each suffix, what it shares with the one before it in order, up to a character ``stop`` or less.

    Where both suffixes are preceded by one character, the value is that of the place before less
    one; only the others are compared.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    at = np.arange(n)
    reducible = np.zeros(n, bool)
    inner = (at > 0) & (before > 0)
    inner[inner] &= before[np.flatnonzero(inner) - 1] >= 0
    where = np.flatnonzero(inner)
    reducible[where] = (text[where - 1] == text[before[where] - 1]) & (text[where - 1] > stop) & (before[where - 1] == before[where] - 1)
    shared = np.zeros(n, np.int64)
    open_ = np.flatnonzero(~reducible & (before >= 0))
    k = 0
    while len(open_):
        mine = text[np.minimum(open_ + k, n - 1)]
        go = (mine == text[np.minimum(before[open_] + k, n - 1)]) & (mine > stop)
        shared[open_[~go]] = k
        open_ = open_[go]
        k += 1
    last = np.maximum.accumulate(np.where(reducible, -1, at))
    return shared[last] - (at - last)
