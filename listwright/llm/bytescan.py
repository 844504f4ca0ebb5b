"""Whole texts as flat byte arrays: words, word hashes and windows without a loop over words.

A batch of texts is one byte array with the place where each text starts. White space is
ASCII, and no byte of a longer UTF-8 sequence is, so words can be cut on bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_BYTE = np.random.Generator(np.random.PCG64(20240229)).integers(0, 2**64, 256, dtype=np.uint64)
_powers: list[np.ndarray] = []


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def texts(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Pieces of a string column: first row, bytes, and offsets of the rows in them.

    A null counts as empty. A piece holds about ``limit`` bytes; a longer text is a piece.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if n == 0:
        return
    buffers = column.buffers()
    off = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield lo, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK + 1)
        found = []
        for base in (_BASE, pow(_BASE, -1, 2**64)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            found.append(np.cumprod(p, dtype=np.uint64))
        _powers[:] = found
    return _powers


class Words:
    """Words of a piece: first byte, end, and for each text the number of words before it."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        self.data, self.off = data, off
        inside = ~SPACE[data]
        first, last = inside.copy(), inside.copy()
        if len(data):
            first[1:] &= ~inside[:-1]
            last[:-1] &= ~inside[1:]
            full = off[1:] > off[:-1]
            begins, ends = off[:-1][full], off[1:][full] - 1
            first[begins] = inside[begins]
            last[ends] = inside[ends]
        self.start = np.flatnonzero(first)
        self.stop = np.flatnonzero(last) + 1
        self.bound = np.searchsorted(self.start, off)
        self._sums: np.ndarray | None = None

    def hashes(self, start: np.ndarray | None = None, stop: np.ndarray | None = None) -> np.ndarray:
        """64-bit hashes of byte ranges, by default of the words."""
        power, inverse = powers(len(self.data) + 1)
        if self._sums is None:
            self._sums = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum(_BYTE[self.data] * power[: len(self.data)], out=self._sums[1:])
        start = self.start if start is None else start
        stop = self.stop if stop is None else stop
        value = (self._sums[stop] - self._sums[start]) * inverse[start]
        return mixed(value + (stop - start).astype(np.uint64))


def shingle_sets(data: np.ndarray, off: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its windows of ``width`` lower-cased words.

    With fewer words the whole sequence is one window; without words the set is empty.
    """
    w = Words(LOWER[data], off)
    h, bound = w.hashes(), w.bound
    odd = np.uint64(_BASE)
    whole = max(0, len(h) - width + 1)
    grams = np.zeros(whole, np.uint64)
    for j in range(width):
        grams = grams * odd + h[j : j + whole]
    grams = mixed(grams)
    for i in range(len(off) - 1):
        lo, hi = bound[i], bound[i + 1]
        if hi - lo >= width:
            yield np.unique(grams[lo : hi - width + 1])
        elif hi > lo:
            value = np.uint64(0)
            with np.errstate(over="ignore"):
                for x in h[lo:hi]:
                    value = value * odd + x
                value = value + np.uint64(hi - lo) * np.uint64(0xD6E8FEB86659FD93)
            yield mixed(np.array([value], np.uint64))
        else:
            yield np.zeros(0, np.uint64)


def binaries(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())


def list_array(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Lists cut out of one flat array."""
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values, kind))
