"""Vectorised text primitives: words, fingerprints, sliding minima and packed slices over Arrow string columns.

A block of texts is one byte buffer plus row offsets; words never cross rows. Fingerprints are polynomials modulo 2**64 with odd bases,
taken from prefix sums, so a span of up to ``PIECE`` values costs two look-ups. Long polynomials of that kind agree on some regular sequences of two
values, so a longer span is hashed by pieces, and the scrambled hashes of its pieces again.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
PIECE = 64
_POWERS: dict[int, np.ndarray] = {}

#: Byte classes. ``SPACE_WORD``: anything but space and tab..CR. ``ALNUM_WORD``: ASCII letters and digits, and every byte above 0x7F.
SPACE_WORD = np.ones(256, bool)
SPACE_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
ALNUM_WORD = np.zeros(256, bool)
for _lo, _hi in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    ALNUM_WORD[_lo : _hi + 1] = True
#: A-Z to a-z, all other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def blocks(batches: Iterable[pa.RecordBatch], column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``limit`` bytes of ``column`` each, one row at least. Rows are never cut."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(size, dtype=np.int64) // limit
        cuts = np.flatnonzero(np.diff(part)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
            yield batch.slice(a, b - a)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows and row offsets (one more than rows); null is empty."""
    kind = pa.binary() if column.type in (pa.string(), pa.binary()) else pa.large_binary()
    values = pc.fill_null(column.cast(kind), b"")
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    width = np.int32 if kind == pa.binary() else np.int64
    off = np.frombuffer(values.buffers()[1], width)[values.offset : values.offset + len(values) + 1].astype(np.int64)
    data = values.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, off - off[0]


def spans(buf: np.ndarray, off: np.ndarray, table: np.ndarray = SPACE_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words, and for each row (and one beyond) the index of its first word."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    inside = table[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[off] = True
    before = np.concatenate(([False], inside[:-1]))
    after = np.concatenate((inside[1:], [False]))
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, off)


def powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, U64)
        have[0] = 1
        _POWERS[base] = have = np.multiply.accumulate(have)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scramble of 64-bit values (in place)."""
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def prefix(values: np.ndarray, base: int = BASES[0]) -> np.ndarray:
    """Prefix sums of ``(value + 1) * base**i``."""
    out = np.empty(len(values) + 1, U64)
    out[0], body = 0, out[1:]
    body[:] = values
    body += U64(1)
    body *= powers(base, len(values))
    np.cumsum(body, out=body)
    return out


def flat_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = BASES[0]) -> np.ndarray:
    """Polynomial of each [start, end), the same wherever the span stands."""
    inverse = pow(base, -1, 1 << 64)
    return mix((sums[ends] - sums[starts]) * powers(inverse, len(sums))[starts])


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = BASES[0]) -> np.ndarray:
    """Fingerprint of each [start, end), the same wherever the span stands; by pieces if it is long."""
    out = flat_hash(sums, starts, ends, base)
    long = np.flatnonzero(ends - starts > PIECE)
    if len(long):
        parts = -(-(ends[long] - starts[long]) // PIECE)
        off = np.concatenate(([0], np.cumsum(parts)))
        begin = np.repeat(starts[long], parts) + PIECE * (np.arange(off[-1]) - np.repeat(off[:-1], parts))
        pieces = flat_hash(sums, begin, np.minimum(begin + PIECE, np.repeat(ends[long], parts)), base)
        out[long] = span_hash(prefix(pieces, base), off[:-1], off[1:], base)
    return out


def window_hash(h: np.ndarray, k: int, base: int = BASES[1]) -> np.ndarray:
    """Fingerprints of all k consecutive values."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    at = np.arange(n)
    return span_hash(prefix(h, base), at, at + k, base)


def row_of(first: np.ndarray) -> np.ndarray:
    """Row of each word, from the index of each row's first word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def whole(row: np.ndarray, k: int) -> np.ndarray:
    """Whether the k words from each start on stand in one row."""
    n = len(row) - k + 1
    return row[:n] == row[k - 1 :] if n > 0 else np.zeros(0, bool)


def sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values, by doubling."""
    n, span = len(a) - w + 1, 1
    if n <= 0:
        return a[:0]
    while span * 2 <= w:
        a = np.minimum(a[:-span], a[span:])
        span *= 2
    return np.minimum(a[:n], a[w - span : w - span + n]) if span < w else a[:n]


def gather(buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slices one after another, and their offsets."""
    off = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(lengths, out=off[1:])
    at = np.repeat(starts - off[:-1], lengths)
    at += np.arange(off[-1])
    return buf[at], off


def binary(data: np.ndarray, off: np.ndarray, kind: pa.DataType = pa.binary()) -> pa.Array:
    off = off.astype(np.int32 if kind in (pa.binary(), pa.string()) else np.int64)
    return pa.Array.from_buffers(kind, len(off) - 1, [None, pa.py_buffer(np.ascontiguousarray(off)), pa.py_buffer(np.ascontiguousarray(data))])


def joined(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words with one space behind each, and the offset of each."""
    out, off = gather(buf, starts, ends - starts + 1) if not len(starts) or ends[-1] < len(buf) else gather(np.append(buf, np.uint8(32)), starts, ends - starts + 1)
    out[off[1:] - 1] = 32
    return out, off
