"""Byte kernels of the repeated-passage search (numpy, inside tasks)."""

from __future__ import annotations

import numpy as np

from .common import BASE, mix, prefix_hash, span_hash

GRAM = 16
BASE2 = 0xD6E8FEB86659FD93   # second odd multiplier, a fixed value
_POS = np.uint64(28)         # bits for a position in a slice
_LAST = np.uint64((1 << 28) - 1)


def samples(data: np.ndarray, off: np.ndarray, span: int, reach: int):
    """Sampled suffixes of concatenated texts.

    Every window of ``span`` bytes has exactly one sample: the least of the
    ``reach`` 16-byte grams that start it, the last one on ties.  Equal windows
    have their sample at the same distance, whatever surrounds them.  Returns
    the sample's position and the first and last window start it serves.
    ``reach`` is a power of two.
    """
    none = np.empty(0, np.int64)
    room = np.diff(off) - span + 1
    first, room = off[:-1][room > 0], room[room > 0]
    if not len(room):
        return none, none, none
    at = np.arange(len(data) - GRAM + 1)
    key = (mix(span_hash(prefix_hash(data), at, at + GRAM)) >> _POS) << _POS
    key |= _LAST - at.astype(np.uint64)
    width = 1
    while width < reach:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    s = np.repeat(first - np.cumsum(room) + room, room) + np.arange(room.sum())
    pos = (_LAST - (key[s] & _LAST)).astype(np.int64)
    new = np.ones(len(s), bool)
    new[1:] = (pos[1:] != pos[:-1]) | (s[1:] != s[:-1] + 1)
    begin = np.flatnonzero(new)
    return pos[begin], s[begin], s[np.append(begin[1:], len(s)) - 1]


def cores(data: np.ndarray, a: np.ndarray, span: int, reach: int) -> np.ndarray:
    """Core names of whole samples: hash of the bytes that every window of such a sample holds."""
    return mix(span_hash(prefix_hash(data), a, a + span - reach + 1))


def cells(data: np.ndarray, a: np.ndarray, lo: np.ndarray, hi: np.ndarray, span: int, step: int):
    """Cut the windows ``lo..hi`` of each sample into cells of ``step`` distances, and name them.

    Returns the row each cell comes from, its first and last window start, the
    ``core`` name (hash of the bytes every window of such a cell holds) and the
    ``full`` name (two longs: all bytes its windows hold, and their place).  Two
    equal windows lie in cells of one core name; cells of one full name hold
    the same windows.
    """
    near, far = (a - hi) // step, (a - lo) // step
    n = far - near + 1
    row = np.repeat(np.arange(len(a)), n)
    j = np.repeat(near - np.cumsum(n) + n, n) + np.arange(n.sum())
    first = np.maximum(lo[row], a[row] - step * j - step + 1)
    last = np.minimum(hi[row], a[row] - step * j)
    c1, c2 = prefix_hash(data), prefix_hash(data, BASE2)
    begin = a[row] - step * j
    core = mix(span_hash(c1, begin, begin + span - step + 1) + j.astype(np.uint64))
    place = ((a[row] - first) * 1024 + (last - first)).astype(np.uint64)
    full = np.stack([mix(span_hash(c1, first, last + span) + place),
                     mix(span_hash(c2, first, last + span, BASE2) ^ place)], 1)
    return row, first, last, core, full


def covered(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of byte ranges (touching ranges merge)."""
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    new = np.ones(len(s), bool)
    new[1:] = s[1:] > e[:-1]
    b = np.flatnonzero(new)
    return s[b], e[np.append(b[1:], len(s)) - 1]
