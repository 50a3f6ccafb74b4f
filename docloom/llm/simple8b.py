"""Simple-8b coding of unsigned integers in 64-bit words, vectorised, with an escape for large values.

The top four bits of a word select how many values of how many bits its lower 60 bits hold. Selector 15 is
the escape: the next word is one raw 64-bit value. Packing is greedy: each word takes as many values as fit.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
#: Values and bits by selector 0..13; fixed by the coding.
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
ESCAPE = 15


def bit_widths(values: np.ndarray) -> np.ndarray:
    """Bits that each value needs, one at least."""
    v = values.astype(np.uint64)
    out = np.ones(len(v), np.uint8)
    for b in range(1, 64):
        high = v >> U(b)
        if not high.any():
            break
        out += high != 0
    return out


def encode(values: np.ndarray) -> np.ndarray:
    """uint64 words for the values."""
    v = values.astype(np.uint64)
    n = len(v)
    if not n:
        return np.zeros(0, np.uint64)
    width = bit_widths(v)
    choice = np.where(width > 60, ESCAPE, 13).astype(np.uint8)
    reach, most = 1, width
    for s in range(12, -1, -1):  # from few wide values to many narrow ones
        c, b = int(COUNTS[s]), int(BITS[s])
        if c > n:
            break
        while reach < c:  # sliding maximum of the widths over c values
            step = min(reach, c - reach)
            longer = most[: n - reach - step + 1].copy()
            np.maximum(longer, most[step : step + len(longer)], out=longer)
            most, reach = longer, reach + step
        fits = np.flatnonzero(most[: n - c + 1] <= b)
        if not len(fits):
            break
        choice[fits] = s
    jump = np.ones(16, np.int64)
    jump[:14] = COUNTS
    steps = jump[choice].tolist()
    at, i = [], 0
    while i < n:
        at.append(i)
        i += steps[i]
    pos = np.array(at)
    sel = choice[pos]
    escaped = sel == ESCAPE
    slot = np.arange(len(pos)) + np.concatenate(([0], np.cumsum(escaped)[:-1]))
    out = np.zeros(len(pos) + int(escaped.sum()), np.uint64)
    out[slot] = sel.astype(np.uint64) << U(60)
    for s in np.unique(sel):
        own = np.flatnonzero(sel == s)
        if s == ESCAPE:
            out[slot[own] + 1] = v[pos[own]]
            continue
        word = np.zeros(len(own), np.uint64)
        for j in range(int(COUNTS[s])):
            word |= v[pos[own] + j] << U(j * int(BITS[s]))
        out[slot[own]] |= word
    return out


def decode(words: np.ndarray, n: int) -> np.ndarray:
    """The n values that the words hold, as uint64."""
    sel = (words >> U(60)).astype(np.int64)
    if (sel == ESCAPE).any() or (sel == 14).any():
        raw = np.zeros(len(words), bool)
        i, marks = 0, np.flatnonzero(sel == ESCAPE)
        last = -1
        for i in marks.tolist():  # a raw word may look like an escape
            if i > last:
                raw[i + 1] = True
                last = i + 1
        kept = ~raw
        take = np.where(sel == ESCAPE, 1, COUNTS[np.minimum(sel, 13)]) * kept
    else:
        raw = np.zeros(len(words), bool)
        take = COUNTS[sel]
    start = np.concatenate(([0], np.cumsum(take)[:-1])) if len(words) else np.zeros(0, np.int64)
    out = np.zeros(int(take.sum()) if len(words) else 0, np.uint64)
    for s in np.unique(sel[~raw]) if len(words) else ():
        own = np.flatnonzero((sel == s) & ~raw)
        if s == ESCAPE:
            out[start[own]] = words[own + 1]
            continue
        mask = U((1 << int(BITS[s])) - 1)
        for j in range(int(COUNTS[s])):
            out[start[own] + j] = (words[own] >> U(j * int(BITS[s]))) & mask
    if len(out) < n:
        raise ValueError("truncated block")
    return out[:n]
