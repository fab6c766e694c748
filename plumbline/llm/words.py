"""Words and word hashes of whole texts, computed on Arrow string columns with numpy.

A word is a maximal run of bytes that are none of space and \\t \\n \\v \\f \\r, after lower-casing A-Z, unless another
kind of bytes is asked for. All functions
take a slice of rows at a time, so memory follows ``SLICE_BYTES`` or the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20

_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15 | 1)
_BACK = _U(pow(int(_STEP), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _byte_values() -> np.ndarray:
    folded = np.arange(256, dtype=np.uint64)
    folded[ord("A"):ord("Z") + 1] += _U(32)
    return mix(folded + _U(0x5851F42D4C957F2D))


_VALUES = _byte_values()
#: Which bytes are part of words: all but white space, or only letters, digits and bytes beyond ASCII.
SOLID = np.ones(256, dtype=bool)
SOLID[[9, 10, 11, 12, 13, 32]] = False
LETTERS = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])


class _Powers:
    """Powers of the multiplier and of its inverse, grown on demand."""

    up = np.ones(1, dtype=np.uint64)
    down = np.ones(1, dtype=np.uint64)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) <= n:
            size = max(n + 1, 2 * len(cls.up))
            for name, base in (("up", _STEP), ("down", _BACK)):
                factors = np.full(size, base, dtype=np.uint64)
                factors[0] = 1
                setattr(cls, name, np.cumprod(factors, dtype=np.uint64))
        return cls.up, cls.down


@dataclass
class Words:
    """Word hashes of some rows: those of row i are ``hashes[bounds[i]:bounds[i + 1]]``.

    ``starts`` and ``ends`` are byte positions in ``data``; the bytes of row i begin at ``offsets[i]``.
    """

    hashes: np.ndarray
    bounds: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    data: np.ndarray
    offsets: np.ndarray


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8) if body is not None else np.zeros(0, dtype=np.uint8)
    return data, offsets


def hash_words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray = SOLID) -> Words:
    """Hashes of all words (runs of bytes of this kind) of the rows that ``offsets`` mark in ``data``."""
    data, offsets = data[offsets[0]:offsets[-1]], offsets - offsets[0]
    n = len(data)
    solid = kind[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    left = np.zeros(n + 1, dtype=bool)
    left[1:] = solid
    right = np.zeros(n + 1, dtype=bool)
    right[:n] = solid
    starts = np.flatnonzero(right & (~left | edge))
    ends = np.flatnonzero(left & (~right | edge))
    up, down = _Powers.to(n)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_VALUES[data] * up[:n], dtype=np.uint64, out=total[1:])
    hashes = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _STEP)
    return Words(hashes, np.searchsorted(starts, offsets), starts, ends, data, offsets)


def slices(column: pa.Array, kind: np.ndarray = SOLID) -> Iterator[tuple[int, int, Words]]:
    """(first row, end row, words) of consecutive slices of a column."""
    data, offsets = raw(column)
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + SLICE_BYTES, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last, hash_words(data, offsets[first:last + 1], kind)
        first = last


def grams(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of every run of ``size`` words; run i starts at word i. Runs may cross rows: see ``inside``."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        out = out * _STEP + hashes[k:k + n]
    return mix(out)


def inside(bounds: np.ndarray, size: int) -> np.ndarray:
    """Which runs of ``size`` words lie within one row."""
    n = int(bounds[-1]) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=bool)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    return row[:n] == row[size - 1:]
