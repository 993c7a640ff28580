"""Frames as format-B records, for sinks that keep captures."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .captures import B_BINS, B_TAGS, CLOSES, MAGIC

_WIDTHS = {bins: code for code, bins in B_BINS.items()}


def record(group: int, index: int, last: bool, tick: int, rssi: int, mac: bytes, re, im) -> bytes:
    """One chain of a frame; samples in order of frequency are stored in bin order, as 14 bits each."""
    values = [("version", 13, 1), ("time", tick, 8), ("rssi", rssi & 0xFF, 1), ("width", _WIDTHS[len(re)], 1), ("tpi", index, 1), ("rpi", 0, 1), ("sequence", (group & 0xFFFF) << 16 | last * CLOSES | index, 4)]
    items = [(B_TAGS[n], v.to_bytes(size, "little")) for n, v, size in values] + [(B_TAGS["mac"], mac)]
    items += [(B_TAGS[n], (np.fft.ifftshift(np.asarray(x, np.int64)) & 0x3FFF).astype("<u2").tobytes()) for n, x in (("real", re), ("imag", im))]
    body = b"".join(struct.pack("<BH", tag, len(v)) + v for tag, v in items)
    return struct.pack("<BH", MAGIC, len(body)) + body


def _heads(one: bytes) -> dict[int, int]:
    """Where the value of each item of a record begins."""
    at, p = {}, 3
    while p < len(one):
        at[one[p]] = p + 3
        p += 3 + int.from_bytes(one[p + 1 : p + 3], "little")
    return at


def _lists(column: pa.Array, n: int) -> np.ndarray | None:
    """A list column of lists of ``n`` whole numbers as rows, None if it has others."""
    if column.null_count or not (np.diff(column.offsets.to_numpy()) == n).all():
        return None
    flat = column.flatten()
    return None if flat.null_count else flat.to_numpy().reshape(-1, n)


def alike(batch: pa.RecordBatch) -> pa.Array | None:
    """The records of `encode` for a batch whose frames are of one width, set into copies of one record; None for others."""
    get = lambda c: batch.column(batch.schema.get_field_index(c))
    n, macs = batch.num_rows, get("mac").dictionary_encode()
    if not n or any(get(c).null_count for c in ("seq", "tick", "rssi", "mac", "re0")):
        return None
    bins = len(get("re0")[0])
    planes = {c: _lists(get(c), bins) for c in ("re0", "im0", "re1", "im1")}
    addresses = [bytes.fromhex(m.replace(":", "")) for m in macs.dictionary.to_pylist()]
    tick, seq, rssi = (get(c).to_numpy().astype(np.int64) for c in ("tick", "seq", "rssi"))
    if bins not in _WIDTHS or any(p is None for p in planes.values()) or {len(a) for a in addresses} != {6} or (tick < 0).any():
        return None
    one = record(0, 0, False, 0, 0, addresses[0], np.zeros(bins), np.zeros(bins))
    out, at = np.empty((n, 2, len(one)), np.uint8), _heads(one)
    out[:] = np.frombuffer(one, np.uint8)

    def put(k: int, name: str, values: np.ndarray) -> None:
        raw = np.ascontiguousarray(values).view(np.uint8).reshape(n, -1)
        out[:, k, at[B_TAGS[name]] :][:, : raw.shape[1]] = raw

    for k in range(2):
        put(k, "time", tick.astype("<i8"))
        put(k, "rssi", (rssi & 0xFF).astype(np.uint8))
        put(k, "tpi", np.full(n, k, np.uint8))
        put(k, "sequence", ((seq & 0xFFFF) << 16 | (k == 1) * CLOSES | k).astype("<u4"))
        put(k, "mac", np.frombuffer(b"".join(addresses), np.uint8).reshape(-1, 6)[macs.indices.to_numpy()])
        for name, c in (("real", f"re{k}"), ("imag", f"im{k}")):
            put(k, name, (np.fft.ifftshift(planes[c], 1).astype(np.int64) & 0x3FFF).astype("<u2"))
    offsets = np.arange(n + 1, dtype=np.int64) * (2 * len(one))
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(out)]).cast(pa.binary())


def encode(frames: DataFrame) -> DataFrame:
    """source, seq, record of (source, seq, tick ms, rssi, mac, re0, im0, re1, im1): both chains of a frame in one piece, so that no sink cuts between them.

    Arrays have 64, 128 or 256 whole numbers of 14 bits; ``seq`` numbers the frames of a source. Rows keep their order
    and their partitions.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = alike(batch)
            if made is None:
                out = []
                for x in batch.to_pylist():
                    mac = bytes.fromhex(x["mac"].replace(":", ""))
                    out.append(b"".join(record(x["seq"], k, k == 1, x["tick"], x["rssi"], mac, x[f"re{k}"], x[f"im{k}"]) for k in range(2)))
                made = pa.array(out, pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), made], names=["source", "seq", "record"])

    return frames.select("source", "seq", "tick", "rssi", "mac", "re0", "im0", "re1", "im1").mapInArrow(run, "source string, seq bigint, record binary")
