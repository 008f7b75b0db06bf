"""Texts as numpy arrays over Arrow buffers: slices, rolling hashes, words and shingles.

Everything here is vectorised over the bytes of many texts at once. Callers walk a batch in pieces
of bounded size (``spans``), so that memory follows the longest text, not the batch.
"""

from __future__ import annotations

import ctypes
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 256_000
U = np.uint64
_ODD = U(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U(30))
    x = x * _MIX1
    x = x ^ (x >> U(27))
    x = x * _MIX2
    return x ^ (x >> U(31))


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
BASE = U(0xD6E8FEB86659FD93)
_INVERSE = U(pow(int(BASE), -1, 1 << 64))
_powers = {int(BASE): np.ones(1, np.uint64), int(_INVERSE): np.ones(1, np.uint64)}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls."""
    have = _powers[int(base)]
    while len(have) < n:
        step = U(pow(int(base), len(have), 1 << 64))
        have = np.concatenate([have, have * step])
    _powers[int(base)] = have
    return have[:n]


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """P with P[j]-P[i] the polynomial hash of values[i:j], times BASE**i."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(BASE, len(values)), out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Position-free hash of the ranges [start, end)."""
    inverse = powers(_INVERSE, len(prefix))
    return mix((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(np.uint64) * _ODD)


@lru_cache(maxsize=1)
def lean() -> None:
    """Make this worker hand memory back: one heap, large arrays mapped on their own, and Arrow on that heap too.

    Workers outlive their tasks, and what their allocators keep counts against the executor.
    """
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        libc = ctypes.CDLL(None)
        for option, value in ((-8, 1), (-3, 4 << 20), (-1, 8 << 20)):  # arenas, size mapped apart, top kept
            libc.mallopt(option, value)
    except (OSError, AttributeError):  # another C library
        pass


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    lean()
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def spans(offs: np.ndarray, limit: int = CHUNK):
    """Row ranges (i, j) of at most ``limit`` bytes, one row at least."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1)
        yield i, j
        i = j


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of some texts and, for each text, where its words begin.

    A word is a run of bytes other than space, tab, LF, VT, FF and CR; A-Z are lower-cased.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offs), np.int64)
    black = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    left = np.empty(n, bool)
    left[0] = True
    left[1:] = ~black[:-1]
    start = np.flatnonzero(black & (left | edge[:n]))
    right = np.empty(n, bool)
    right[-1] = True
    right[:-1] = ~black[1:]
    end = np.flatnonzero(black & (right | edge[1:])) + 1
    prefix = prefix_hash(BYTE_VALUES[_LOWER[data]])
    return range_hash(prefix, start, end), np.searchsorted(start, offs)


def shingles(hashes: np.ndarray, first: np.ndarray, k: int):
    """For each text the sorted distinct hashes of its k-word shingles.

    A text of fewer words, one at least, has its whole sequence as its only shingle; a text
    without words has none.
    """
    n = len(hashes)
    grams = np.zeros(0, np.uint64)
    if n >= k:
        grams = hashes[: n - k + 1].copy()
        for j in range(1, k):
            grams = grams * BASE + hashes[j : n - k + 1 + j]
        grams = mix(grams)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= k:
            yield np.unique(grams[a : b - k + 1])
        elif b > a:
            x = U(b - a)
            with np.errstate(over="ignore"):
                for h in hashes[a:b]:
                    x = x * BASE + h
            yield mix(np.array([x], np.uint64))
        else:
            yield grams[:0]
