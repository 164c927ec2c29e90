"""Word shingle sets of whole texts, many texts at once, in numpy.

A text's set: distinct shingles of ``width`` words; with fewer words its whole sequence as
one; without words nothing.  Words are runs of other bytes than blanks (space, tab to
carriage return) after A-Z are lowered.  A shingle is a 64-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

from matchloom.llm.common import LOWER, utf8_buffer

BLOCK = 1 << 20
_R = 0x9E3779B97F4A7C15
_R_INVERSE = pow(_R, -1, 1 << 64)
IS_BLANK = np.zeros(256, bool)
IS_BLANK[[9, 10, 11, 12, 13, 32]] = True


@cache
def _powers(size: int, base: int) -> np.ndarray:
    out = np.full(size, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(n: int, base: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    return _powers(max(BLOCK * 2, 1 << int(n).bit_length()), base)[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word, and each text's first word (with one entry more)."""
    blank = IS_BLANK[data]
    inside = ~blank
    begin = inside.copy()
    begin[1:] &= blank[:-1]
    heads = offsets[:-1][offsets[1:] > offsets[:-1]]
    begin[heads] = inside[heads]
    end = inside.copy()
    end[:-1] &= blank[1:]
    tails = offsets[1:][offsets[1:] > offsets[:-1]] - 1
    end[tails] = inside[tails]
    starts, stops = np.flatnonzero(begin), np.flatnonzero(end) + 1
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data), _R), out=total[1:])
    h = (total[stops] - total[starts]) * powers(len(data) + 1, _R_INVERSE)[starts]
    return mix(h + (stops - starts).astype(np.uint64)), np.searchsorted(starts, offsets)


def shingle_sets(column: pa.Array, width: int = 5) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of rows: first row, their sets one after another (sorted hashes), offsets of the sets."""
    data, offsets = utf8_buffer(column)
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + BLOCK, "right")) - 1)
        own = offsets[first : last + 1] - offsets[first]
        words, bounds = word_hashes(LOWER[data[offsets[first] : offsets[last]]], own)
        count = np.diff(bounds)
        per_text = np.maximum(count - width + 1, (count > 0).astype(np.int64))
        at = np.concatenate([[0], np.cumsum(per_text)])
        place = np.repeat(bounds[:-1] - at[:-1], per_text) + np.arange(at[-1])
        short = np.repeat(np.where(count < width, count, width), per_text)
        h = np.zeros(at[-1], np.uint64)
        padded = np.concatenate([words, np.zeros(width, np.uint64)])
        for k in range(width):
            h = h * np.uint64(0xD6E8FEB86659FD93) + np.where(short > k, padded[place + k], np.uint64(0))
        h = mix(h + short.astype(np.uint64))
        owner = np.repeat(np.arange(last - first), per_text)
        order = np.lexsort((h, owner))
        h, owner = h[order], owner[order]
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
        h, owner = h[fresh], owner[fresh]
        yield first, h, np.searchsorted(owner, np.arange(last - first + 1))
        first = last
