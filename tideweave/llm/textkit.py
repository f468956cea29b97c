"""Vectorised word handling over the buffers of Arrow string columns.

Words are `[^\\x20\\x09-\\x0D]+` of the UTF-8 bytes. Everything works on pieces of a few MB, so memory stays
bounded however large an Arrow batch is; only a single text longer than a piece makes a larger one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
_U = np.uint64
_P = _U(0x9E3779B97F4A7C15)
#: Inverse of _P modulo 2**64.
_PINV = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_rng = np.random.default_rng(20240229)
BYTES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
FOLDED = BYTES.copy()
FOLDED[65:91] = BYTES[97:123]
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the whole word."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x = x ^ (x >> _U(29))
    x = x * _U(0xA0761D6478BD642F)
    return x ^ (x >> _U(32))


def powers(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, PIECE + (1 << 16))
        for i, base in enumerate((_P, _PINV)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[i] = np.multiply.accumulate(p)
    return _powers


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (first 0) and bytes of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    off = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
    return off - off[0], data


def pieces(column: pa.Array, limit: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, offsets, bytes) for runs of rows of about `limit` bytes."""
    off, data = buffers(column)
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        yield lo, hi, off[lo : hi + 1] - off[lo], data[off[lo] : off[hi]]
        lo = hi


@dataclass
class Words:
    """Words of a piece: byte spans, hashes, and for each row the index of its first word (one more at the end)."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    row: np.ndarray
    first: np.ndarray


def words(off: np.ndarray, data: np.ndarray, fold: bool = True) -> Words:
    """Words of a piece; with `fold` A-Z hash as a-z."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return Words(z, z, z.astype(np.uint64), z, np.zeros(len(off), np.int64))
    inside = ~SPACE[data]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    before[off[:-1][off[:-1] < n]] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[off[1:][off[1:] > 0] - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    power, inverse = powers(n)
    total = np.cumsum((FOLDED if fold else BYTES)[data] * power[:n])
    low = np.where(start > 0, total[start - 1], _U(0))
    hashed = mix((total[end - 1] - low) * inverse[start] + (end - start).astype(np.uint64))
    first = np.searchsorted(start, off)
    return Words(start, end, hashed, np.repeat(np.arange(len(off) - 1), np.diff(first)), first)


def grams(hashed: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on (positions that run over the end wrap and must be ignored)."""
    out = hashed * _P
    for i in range(1, k):
        out = (out + np.roll(hashed, -i)) * _P
    return mix(out + _U(k))


def span_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of `values` between consecutive `first`; zero for empty spans."""
    total = np.concatenate([np.zeros(1, np.int64), np.cumsum(values, dtype=np.int64)])
    return total[first[1:]] - total[first[:-1]]


def crc_of_id(ids) -> np.ndarray:
    """crc32 of the id's decimal text; a null id counts as the empty text."""
    import zlib

    return np.array([zlib.crc32(b"" if x is None else str(x).encode()) for x in ids], np.int64)
