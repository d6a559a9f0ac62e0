"""Vectorised views over Arrow string columns, shared by the Python-side operators.

A batch of texts is one run of UTF-8 bytes plus document offsets.  Everything
here is numpy over those two arrays: word bounds, line bounds and prefix-sum
hashes, so that no operator walks over characters in Python.  Memory follows
``chunks``: whole documents up to ``limit`` bytes at a time, and a longer
document alone.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: The white space of the word and line contracts.
SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

U64 = np.uint64
_MULT = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_INV = pow(_MULT, -1, 1 << 64)

IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACE_BYTES)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit mixer: every input bit moves every output bit."""
    x = x.astype(U64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> U64(30)
        x *= U64(0xBF58476D1CE4E5B9)
        x ^= x >> U64(27)
        x *= U64(0x94D049BB133111EB)
        x ^= x >> U64(31)
    return x


_BYTE_CODE = mix64(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95)) | U64(1)
_POW = {1: np.ones(1, U64), -1: np.ones(1, U64)}


def _powers(n: int, sign: int) -> np.ndarray:
    """Base**i modulo 2**64 for i < n (sign -1: of its inverse), grown by doubling."""
    have = _POW[sign]
    base = _MULT if sign == 1 else _INV
    while len(have) < n:
        step = U64(pow(base, len(have), 1 << 64))
        with np.errstate(over="ignore"):
            have = np.concatenate([have, have * step])
    if len(have) <= 1 << 23:  # a giant document's table isn't kept
        _POW[sign] = have
    return have[:n]


class Rolling:
    """Hashes of any byte ranges of one chunk from a single prefix sum."""

    def __init__(self, data: np.ndarray, fold: bool = False):
        table = _BYTE_CODE[LOWER] if fold else _BYTE_CODE
        n = len(data)
        self.prefix = np.zeros(n + 1, U64)
        with np.errstate(over="ignore"):
            np.cumsum(table[data] * _powers(n, 1), out=self.prefix[1:])
        self.inverse = _powers(n + 1, -1)

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            raw = (self.prefix[end] - self.prefix[start]) * self.inverse[start]
            return mix64(raw + (end - start).astype(U64) * U64(0x9FB21C651E98DF25))

    def every(self, width: int) -> np.ndarray:
        """Hash of the ``width`` bytes from each position on."""
        n = len(self.prefix) - 1 - width + 1
        if n <= 0:
            return np.zeros(0, U64)
        with np.errstate(over="ignore"):
            return mix64((self.prefix[width:] - self.prefix[:-width]) * self.inverse[:n])


@functools.cache
def _trim():
    """glibc's malloc_trim, or nothing where the C library has none."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):
        return lambda pad: 0


def release() -> None:
    """Gives freed memory back: worker processes live on between tasks, and what they
    keep counts against the executor."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and document offsets of a string column; null is empty."""
    release()  # what the batch before left
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    n = len(column)
    at = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


def chunks(offsets: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of whole documents of at most ``limit`` bytes, or one longer document."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first word of each document + total) of the maximal runs without white space."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~IS_SPACE[data]
    edge = np.zeros(n + 1, bool)  # a document begins (or the chunk ends) here
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0] = True
    before[1:] = ~solid[:-1]
    after = np.empty(n, bool)
    after[-1] = True
    after[:-1] = ~solid[1:]
    start = np.flatnonzero(solid & (before | edge[:n]))
    end = np.flatnonzero(solid & (after | edge[1:])) + 1
    return start, end, np.searchsorted(start, offsets)


def line_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first line of each document + total); every document has a line more than line feeds."""
    cut = np.flatnonzero(data == 10)
    owner = np.searchsorted(offsets, cut, "right") - 1
    docs = len(offsets) - 1
    feeds = np.bincount(owner, minlength=docs)[:docs] if docs else np.zeros(0, np.int64)
    first = np.concatenate([[0], np.cumsum(feeds + 1)]).astype(np.int64)
    start = np.empty(first[-1], np.int64)
    end = np.empty(first[-1], np.int64)
    at = np.arange(len(cut)) + owner  # the line that each feed ends
    end[at], start[at + 1] = cut, cut + 1
    start[first[:-1]], end[first[1:] - 1] = offsets[:-1], offsets[1:]
    return start, end, first


def strip_bounds(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ranges without white space at both ends; all white space: empty."""
    solid = np.flatnonzero(~IS_SPACE[data])
    if not len(solid):
        return start, start
    a = np.searchsorted(solid, start)
    b = np.searchsorted(solid, end)
    some = b > a
    lo = np.where(some, solid[np.minimum(a, len(solid) - 1)], start)
    hi = np.where(some, solid[np.maximum(b - 1, 0)] + 1, start)
    return lo, hi


def code_points(data: np.ndarray) -> np.ndarray:
    """Number of code points before each byte position, one longer than data."""
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every ``width`` consecutive hashes, order counting."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    prefix = np.zeros(len(hashes) + 1, U64)
    with np.errstate(over="ignore"):
        np.cumsum(hashes * _powers(len(hashes), 1), out=prefix[1:])
        return mix64((prefix[width:] - prefix[:-width]) * _powers(n, -1))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` consecutive values, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def covered(length: int, start: np.ndarray, width) -> np.ndarray:
    """Mask of the positions that some range [start, start + width) covers."""
    delta = np.zeros(length + 1, np.int64)
    np.add.at(delta, start, 1)
    np.add.at(delta, np.minimum(start + width, length), -1)
    return np.cumsum(delta[:-1]) > 0
