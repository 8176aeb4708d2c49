"""Vectorised text helpers: words, word hashes and word shingles of a whole Arrow column at once.

Words are runs of bytes outside 0x20 and 0x09-0x0D; none of these occurs inside a multi-byte UTF-8 sequence, so the
work is done on bytes. A-Z are folded. All hashes are 64-bit and depend on nothing but the content.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BYTE[65:91] = _BYTE[97:123]
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BYTE[_SEPARATOR] = 0
_PLACE = _rng.integers(1, 2**63, 64, dtype=np.uint64) * U64(2) + U64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_powers: dict[int, np.ndarray] = {}

#: Text hashed at a time.
SLICE = 1 << 20


def _power(base: int, n: int) -> np.ndarray:
    """base**i modulo 2**64 for i < n."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.ones(1, np.uint64)
        while len(have) < n:
            have = np.concatenate([have, have * U64(pow(base, len(have), 2**64))])
        if n <= 4 * SLICE:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, kind, n + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Runs [a, b) of rows with about ``most`` bytes each, a longer row alone."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, in order; a word never goes on from a row to the next."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~_SEPARATOR[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    first[cut] = inside[cut]
    last[cut - 1] = inside[cut - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row, byte start and byte end of each word."""
    starts, ends = word_bounds(data, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), starts, ends
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _power(_BASE, len(data)), out=total[1:])
    hashes = mix((total[ends] - total[starts]) * _power(_INVERSE, len(data))[starts])
    return hashes, np.searchsorted(offsets, starts, "right") - 1, starts, ends


def shingles(hashes: np.ndarray, rows: np.ndarray, n_rows: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each shingle of ``width`` words, repeats included, in order. A row with fewer words has its
    whole sequence as its one shingle, a row without words none."""
    count = np.bincount(rows, minlength=n_rows)
    begin = np.concatenate([[0], np.cumsum(count)])
    m = len(hashes)
    whole = np.zeros(m, np.uint64)
    for k in range(min(width, m)):
        whole[: m - k] += hashes[k:] * _PLACE[k]
    at = np.arange(m) - begin[rows]
    whole = whole[at <= count[rows] - width]
    whole_rows = rows[at <= count[rows] - width]
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        part = np.zeros(len(short), np.uint64)
        for k in range(width - 1):
            has = count[short] > k
            part[has] += hashes[begin[short[has]] + k] * _PLACE[k]
        part += count[short].astype(np.uint64) * _PLACE[63]
        whole, whole_rows = np.concatenate([whole, part]), np.concatenate([whole_rows, short])
        order = np.argsort(whole_rows, kind="stable")
        whole, whole_rows = whole[order], whole_rows[order]
    return mix(whole), whole_rows


def shingle_sets(column, width: int = 5) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For runs [a, b) of rows: their distinct shingles, sorted within each row, and the rows' bounds in them."""
    data, offsets = buffers(column)
    for a, b in slices(offsets):
        part = data[offsets[a] : offsets[b]]
        hashes, rows, _, _ = word_hashes(part, offsets[a : b + 1] - offsets[a])
        values, rows = shingles(hashes, rows, b - a, width)
        bounds = np.searchsorted(rows, np.arange(b - a + 1))
        for i in range(b - a):
            values[bounds[i] : bounds[i + 1]].sort()
        keep = np.ones(len(values), bool)
        keep[1:] = (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])
        values, rows = values[keep], rows[keep]
        yield a, b, values, np.searchsorted(rows, np.arange(b - a + 1))


def narrow(numbers: np.ndarray) -> bytes:
    """Numbers from 0 on as planes of as many bytes as the largest needs."""
    x = np.ascontiguousarray(numbers).astype("<u8")
    width = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def wide(packed: bytes, *counts: int) -> list[np.ndarray]:
    """The columns, of so many numbers each, that ``narrow`` has packed one after the other."""
    out, at = [], 0
    for n in counts:
        width = packed[at]
        x = np.zeros((n, 8), np.uint8)
        x[:, :width] = np.frombuffer(packed, np.uint8, n * width, at + 1).reshape(width, n).T
        out.append(x.view("<i8").ravel())
        at += 1 + n * width
    return out
