"""Words of many texts at once: boundaries and 64-bit hashes over the bytes of an Arrow string column.

Texts are handled as UTF-8 with the letters A-Z lower-cased and nothing else
changed. Every function works on slices of bounded bytes, so memory does not
grow with the number of rows in a batch; a single text larger than a slice is
handled alone, and its words are hashed piece by piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes hashed at once; about 50 bytes of arrays for each of them.
SLICE_BYTES = 1 << 19
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MUL = np.uint64(0x9E3779B97F4A7C15)
_MUL2 = np.uint64(0xBF58476D1CE4E5B9)
_BASE = 0x5851F42D4C957F2D


def _flags(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    for lo, hi in ranges:
        out[lo : hi + 1] = True
    return out


#: Bytes that end a word: white space alone, or all of ASCII but digits and letters.
WHITE = _flags((0x20, 0x20), (0x09, 0x0D))
NOT_ALNUM = _flags((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all others."""
    h = (h ^ (h >> np.uint64(30))) * _MUL2
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _MUL)


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, lower-cased bytes, offsets of rows in them) over a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + most, side="right")) - 1)
        yield lo, hi, _LOWER[data[offs[lo] : offs[hi]]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def words(data: np.ndarray, offs: np.ndarray, ends_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every word; a word never crosses from one row to the next."""
    inside = ~ends_word[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = offs[(offs > 0) & (offs < len(data))]
    first[edges] = inside[edges]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[edges - 1] = inside[edges - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offs, start, side="right") - 1


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, prefixes: tuple[int, ...] = ()) -> list[np.ndarray]:
    """64-bit hashes of all words, then of their first k bytes for each k of ``prefixes``."""
    out = [np.empty(len(start), dtype=np.uint64) for _ in (0, *prefixes)]
    lo = 0
    while lo < len(start):
        hi = max(lo + 1, int(np.searchsorted(end, start[lo] + SLICE_BYTES, side="right")))
        length = end[lo:hi] - start[lo:hi]
        at = np.cumsum(length) - length
        pos = np.arange(int(length.sum())) - np.repeat(at, length)
        power = np.cumprod(np.full(int(length.max()), _BASE, dtype=np.uint64))
        value = _BYTE[data[pos + np.repeat(start[lo:hi], length)]] * power[pos]
        out[0][lo:hi] = mix(np.add.reduceat(value, at) + length.astype(np.uint64) * _MUL)
        for k, put in zip(prefixes, out[1:]):
            cut = np.minimum(length, k).astype(np.uint64)
            put[lo:hi] = mix(np.add.reduceat(np.where(pos < k, value, np.uint64(0)), at) + cut * _MUL)
        lo = hi
    return out
