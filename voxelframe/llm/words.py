"""Vectorised word hashing over whole Arrow text columns.

Texts are handled as UTF-8 bytes in slices of bounded size, so memory follows
the slice and the longest single text, not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
SLICE_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _byte_table() -> np.ndarray:
    table = mix(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95))
    table[ord("A") : ord("Z") + 1] = table[ord("a") : ord("z") + 1]
    return table


BYTE_VALUE = _byte_table()
#: Word bytes: everything but the blanks 0x20 and 0x09-0x0D.
BLANK_SPLIT = np.ones(256, bool)
BLANK_SPLIT[[0x20, *range(0x09, 0x0E)]] = False
#: Word bytes: digits, letters, and every byte of a character beyond ASCII.
ALNUM_SPLIT = np.zeros(256, bool)
ALNUM_SPLIT[0x30:0x3A] = ALNUM_SPLIT[0x41:0x5B] = ALNUM_SPLIT[0x61:0x7B] = True
ALNUM_SPLIT[0x80:] = True

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(20, (n + 1).bit_length())
    if size not in _powers:
        if size > 1 << 22:  # a very long text: made for it alone
            return _make_powers(size)
        _powers[size] = _make_powers(size)
    return _powers[size]


def _make_powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, _BASE_INVERSE):
        p = np.full(size, base, U64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (rows + 1) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    if column.null_count:
        keep = np.asarray(column.is_valid())
        sizes = np.where(keep, np.diff(offsets), 0)
        if (sizes != np.diff(offsets)).any():  # bytes under a null: leave them out
            raw = np.concatenate([raw[a:b] for a, b, k in zip(offsets[:-1], offsets[1:], keep, strict=True) if k] or [raw[:0]])
            offsets = np.concatenate([[0], np.cumsum(sizes)])
    return raw, offsets


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most limit bytes, or of one row that is longer."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_hashes(raw: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, first word of each text (rows + 1), starts, ends) of the words of adjacent texts.

    A hash depends on the word's bytes alone, with A-Z folded to a-z.
    """
    base = int(offsets[0])
    data = raw[base : int(offsets[-1])]
    at = offsets - base
    n = len(data)
    if n == 0:
        empty = np.zeros(0, np.int64)
        return np.zeros(0, U64), np.zeros(len(offsets), np.int64), empty, empty
    inside = is_word[data]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    power, inverse = _power_tables(n)
    total = np.zeros(n + 1, U64)
    np.cumsum(BYTE_VALUE[data] * power[:n], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(U64))
    return hashes, np.searchsorted(starts, at), starts + base, ends + base
