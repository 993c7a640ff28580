"""NumPy helpers used inside tasks: text buffers, word spans and 64-bit hashes, without per-word Python objects.

Spark partitions and shuffles; these functions see one Arrow batch, cut into byte-balanced slices, at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U64 = np.uint64
_MUL = U64(0x9E3779B97F4A7C15)
#: Spans longer than this many bytes are hashed one by one.
LONG_SPAN = 64


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the row offsets (rows + 1); null counts as empty."""
    col = pc.fill_null(col.cast(pa.large_string()), "")
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    data = col.buffers()[2] if len(col) else None
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_slices(offsets: np.ndarray, most_bytes: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows holding at most ``most_bytes`` bytes each, or one longer row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most_bytes, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def balanced(batch: pa.RecordBatch, most_bytes: int, column: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Byte-balanced slices of a batch with the buffer and the offsets of their texts."""
    buf, offsets = text_buffer(batch.column(batch.schema.get_field_index(column)))
    for i, j in row_slices(offsets, most_bytes):
        yield batch.slice(i, j - i), buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]


def byte_table(pattern_bytes: bytes, member: bool) -> np.ndarray:
    """A 256-entry lookup: ``member`` for the given bytes, its negation for the rest."""
    t = np.full(256, not member)
    t[list(pattern_bytes)] = member
    return t


#: Bytes of words that white space (space, \t \n \v \f \r) separates.
NOT_SPACE = byte_table(b" \t\n\x0b\x0c\r", False)


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    """The bytes with A-Z lower-cased and nothing else changed."""
    return buf + ((buf >= 65) & (buf <= 90)).astype(np.uint8) * np.uint8(32)


def spans(buf: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each maximal run of table bytes; runs never cross rows."""
    n = len(buf)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = table[buf]
    firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    before[firsts] = False
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    after[firsts[1:] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes: one multiply-add a byte, over all spans at once."""
    lengths = ends - starts
    out = np.zeros(len(starts), U64)
    order = np.argsort(-lengths, kind="stable")
    sorted_lengths = lengths[order]
    n_long = int(np.searchsorted(-sorted_lengths, -LONG_SPAN, "left"))
    for k in order[:n_long]:
        out[k] = xxhash.xxh64_intdigest(buf[starts[k] : ends[k]])
    order, sorted_lengths = order[n_long:], sorted_lengths[n_long:]
    at, h = starts[order], sorted_lengths.astype(U64)
    alive = len(order)
    for k in range(int(sorted_lengths[0]) if alive else 0):
        alive = int(np.searchsorted(-sorted_lengths, -k, "left"))
        h[:alive] = h[:alive] * _MUL + buf[at[:alive] + k].astype(U64)
    out[order] = mix(h)
    return out


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """An order-sensitive hash of two 64-bit values."""
    return mix(a * U64(0xD6E8FEB86659FD93) + b)


def windows_hash(h: np.ndarray, rows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``width`` consecutive values inside one row, and each window's first index."""
    if len(h) < width:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    out = h[: len(h) - width + 1].copy()
    for k in range(1, width):
        out = pair_hash(out, h[k : len(h) - width + 1 + k])
    first = np.flatnonzero(rows[: len(out)] == rows[width - 1 :])
    return out[first], first


def lookup(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of ``wanted`` in the sorted ``keys`` and whether each is there."""
    at = np.searchsorted(keys, wanted)
    if not len(keys):
        return at, np.zeros(len(wanted), bool)
    at = np.minimum(at, len(keys) - 1)
    return at, keys[at] == wanted
