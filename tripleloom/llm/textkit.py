"""Vectorised text kernels over Arrow string buffers: words, hashes, shingle sets.

Words are maximal runs of bytes outside space and 0x09-0x0D, with A-Z lower-cased; other
characters stay as they are."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_STEP = 1 << 20
#: Rows of a slice at most, for what is dense per row.
_ROWS = 2048

_rng = np.random.Generator(np.random.PCG64(20240501))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit over the output."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
        x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
        return x ^ (x >> U(32))


def slices(column: pa.Array, step: int = _STEP) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string column into runs of rows of about ``step`` bytes and ``_ROWS`` rows at most.

    Yields ``(first row, end row, bytes, offsets)``; offsets are relative to the bytes; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()) if len(column) else column
    if not len(column):
        return
    if column.null_count:
        column = column.fill_null("")
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + step, side="right")) - 1)
        end = min(end, at + _ROWS, len(column))
        yield at, end, raw[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(start, end, hash, row)`` of every word; words end at row borders."""
    if not len(raw):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, U), z
    inside = ~SPACE[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    border = offsets[1:-1]
    border = border[border < len(raw)]
    begins[border] = inside[border]
    start = np.flatnonzero(begins)
    if not len(start):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, U), z
    which = np.cumsum(begins, dtype=np.int32) - 1
    which[: start[0]] = 0
    place = np.arange(len(raw), dtype=np.int64) - start[which]
    place[: start[0]] = 0
    length = np.add.reduceat(inside, start, dtype=np.int64)
    with np.errstate(over="ignore"):
        power = np.ones(int(length.max()) + 1, U)
        power[1:] = np.cumprod(np.full(len(power) - 1, _BASE, U), dtype=U)
        value = _BYTE[_LOWER[raw]]
        np.minimum(place, len(power) - 1, out=place)
        value *= power[place]
        value[~inside] = 0
        h = mix(np.add.reduceat(value, start) + length.astype(U))
    row = np.searchsorted(offsets, start, side="right") - 1
    return start, start + length, h, row


def sequences(h: np.ndarray, row: np.ndarray, rows: int, k: int) -> list[np.ndarray]:
    """Per row the sorted distinct hashes of its ``k``-word shingles.

    A row of fewer words has its whole sequence as one; a row without words none."""
    count = np.bincount(row, minlength=rows)
    first = np.concatenate([[0], np.cumsum(count)])
    out: list[np.ndarray] = []
    n = len(h)
    with np.errstate(over="ignore"):
        if n >= k:
            acc = np.full(n - k + 1, k, U)
            for j in range(k):
                acc = mix(acc * _BASE + h[j : n - k + 1 + j])
        for r in range(rows):
            a, b = first[r], first[r + 1]
            if b - a >= k:
                out.append(np.unique(acc[a : b - k + 1]))
            elif b > a:
                s = np.full(1, b - a, U)
                for j in range(a, b):
                    s = mix(s * _BASE + h[j : j + 1])
                out.append(s)
            else:
                out.append(np.zeros(0, U))
    return out


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The shingle set of every text of a column, in order."""
    for at, end, raw, offsets in slices(column):
        _, _, h, row = words(raw, offsets)
        yield from sequences(h, row, end - at, k)
