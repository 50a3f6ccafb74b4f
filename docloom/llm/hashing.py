"""Vectorised 64-bit hashing of words, shingles and byte windows with NumPy."""

from __future__ import annotations

import numpy as np

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
#: A random 64-bit value for every byte, so that the rolling sum does not depend on small byte values.
BYTE = np.random.default_rng(20240229).integers(0, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
BYTE_2 = np.random.default_rng(20240301).integers(0, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
#: Bytes that are hashed at once, which bounds the memory that a long text takes.
STRETCH = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True

_pow: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (shifts and odd multipliers)."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the base and of its inverse modulo 2**64."""
    size = 1 << max(16, (n + 1).bit_length())
    if size not in _pow:
        _pow.clear()
        up, down = np.full(size, U(_BASE)), np.full(size, U(_INV))
        up[0] = down[0] = 1
        _pow[size] = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    return _pow[size]


def prefix(data: np.ndarray, table: np.ndarray = BYTE) -> np.ndarray:
    """Prefix sums from which the hash of any span follows; data: uint8. Another table: an independent hash."""
    up, _ = powers(len(data))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * up[: len(data)], out=out[1:])
    return out


def spans(pre: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the spans [start, end); spans of equal bytes hash alike wherever they lie."""
    _, down = powers(len(pre))
    return mix((pre[end] - pre[start]) * down[start] + (end - start).astype(np.uint64))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, table: np.ndarray = BYTE) -> np.ndarray:
    """As `spans`, of spans in order that do not overlap, a bounded stretch of the data at a time."""
    out = np.empty(len(start), np.uint64)
    a = 0
    while a < len(start):
        b = max(a + 1, int(np.searchsorted(end, start[a] + STRETCH, "right")))
        low = start[a]
        out[a:b] = spans(prefix(data[low : end[b - 1]], table), start[a:b] - low, end[a:b] - low)
        a = b
    return out


def words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of anything but ASCII white space."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~SPACE[data]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word of all texts, and the index of its text."""
    data = np.frombuffer(b"\n".join(texts), np.uint8)
    start, end = words(data)
    begins = np.zeros(len(texts), np.int64)
    if len(texts) > 1:
        np.cumsum([len(t) + 1 for t in texts[:-1]], out=begins[1:])
    return span_hashes(data, start, end), np.searchsorted(begins, start, "right") - 1


def runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1])))


def shingle_sets(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles of each text (fewer words: the whole sequence as one), hashed.

    Returns the hashes, ascending within each text, and how many each text has.
    """
    h, doc = word_hashes(texts)
    n = np.bincount(doc, minlength=len(texts)).astype(np.int64)
    first = np.concatenate(([0], np.cumsum(n)))[:-1]
    made, of = [], []
    if len(h) >= k:
        at = np.flatnonzero(doc[: len(h) - k + 1] == doc[k - 1 :])
        x = np.full(len(at), U(k))
        for j in range(k):
            x = mix(x + h[at + j] * U(2 * j + 3))
        made.append(x)
        of.append(doc[at])
    for d in np.flatnonzero((n > 0) & (n < k)):
        x = np.array([n[d] + 1000], np.uint64)
        for j in range(n[d]):
            x = mix(x + h[first[d] + j : first[d] + j + 1] * U(2 * j + 3))
        made.append(x)
        of.append(np.array([d]))
    if not made:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    x, d = np.concatenate(made), np.concatenate(of)
    order = np.lexsort((x, d))
    x, d = x[order], d[order]
    keep = np.concatenate(([True], (x[1:] != x[:-1]) | (d[1:] != d[:-1])))
    x, d = x[keep], d[keep]
    return x, np.bincount(d, minlength=len(texts)).astype(np.int64)
