"""Binary captures as Spark data sources: frames of two record formats, found by content and not by suffix.

``wavemill.capture`` plans one partition a file (or, for files of constant record size, one a byte range) and yields
Arrow batches with one row a frame: clock fields, geometry and the interleaved samples of up to two chains.

Format A: 272-byte header, then int16 I/Q samples ordered (rx, tx, subcarrier). Format B: records ``0xAC | length u16``
of tag-length-value items; a frame is a run of records of one group that its last record closes.
"""

from __future__ import annotations

import mmap
import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "capture string, frame bigint, tick bigint, coarse bigint, rssi int, source string, num_rx int, num_tx int, num_sc int, re0 array<float>, im0 array<float>, re1 array<float>, im1 array<float>"
_ARROW = pa.schema(
    [("capture", pa.string()), ("frame", pa.int64()), ("tick", pa.int64()), ("coarse", pa.int64()), ("rssi", pa.int32()), ("source", pa.string()), ("num_rx", pa.int32()), ("num_tx", pa.int32()), ("num_sc", pa.int32())]
    + [(c, pa.list_(pa.float32())) for c in ("re0", "im0", "re1", "im1")]
)
HEADER = 272
# Byte offsets in the header of format A.
A_FIELDS = {"length": (0, "<I"), "ftm": (8, "<I"), "num_rx": (46, "<B"), "num_tx": (47, "<B"), "num_sc": (52, "<I"), "rssi": (60, "<I"), "mac": (68, "6s"), "mu": (88, "<I"), "rate": (92, "<I")}
# Tags and bandwidth codes of format B.
B_TAGS = {"version": 0, "time": 2, "rssi": 3, "width": 5, "mac": 7, "real": 8, "imag": 9, "tpi": 15, "rpi": 16, "sequence": 18}
B_BINS = {0: 64, 1: 128, 2: 256}
MAGIC, CLOSES = 0xAC, 1 << 15
ROWS = 256


def mac_text(b: bytes) -> str:
    return ":".join(f"{x:02x}" for x in b)


def is_format_b(head: bytes) -> bool:
    """A first record of the right magic, a body that can hold an item, and the version tag in front."""
    return len(head) >= 4 and head[0] == MAGIC and int.from_bytes(head[1:3], "little") >= 3 and head[3] == B_TAGS["version"]


def walk_a(data: bytes, base: int = 0) -> Iterator[dict]:
    """Frames of format A; a partial one at the end is withheld."""
    at, k = 0, base
    while at + HEADER <= len(data):
        h = {n: struct.unpack_from(f, data, at + o)[0] for n, (o, f) in A_FIELDS.items()}
        end = at + HEADER + h["length"]
        if end > len(data) or not h["length"]:
            return
        iq = np.frombuffer(data, "<i2", h["length"] // 2, at + HEADER).astype(np.float32)
        n = h["num_rx"] * h["num_tx"] * h["num_sc"] * 2
        planes: list[np.ndarray | None] = [None, None]
        if n and len(iq) >= n:
            z = iq[:n].reshape(h["num_rx"], h["num_tx"], h["num_sc"], 2)
            planes = [z[r, 0] if r < h["num_rx"] else None for r in range(2)]
        yield {"frame": k, "tick": h["ftm"], "coarse": h["mu"], "rssi": -h["rssi"] if h["rssi"] < 256 else 0, "source": mac_text(h["mac"]), "num_rx": h["num_rx"], "num_tx": h["num_tx"], "num_sc": h["num_sc"], "planes": planes}
        at, k = end, k + 1


def records_b(data: bytes) -> Iterator[tuple[int, dict[int, bytes]]]:
    """End offset and items of each whole record; the walk ends at the first that is broken."""
    at = 0
    while at + 3 <= len(data) and data[at] == MAGIC:
        end = at + 3 + int.from_bytes(data[at + 1 : at + 3], "little")
        if end > len(data):
            return
        items, p = {}, at + 3
        while p + 3 <= end:
            size = int.from_bytes(data[p + 1 : p + 3], "little")
            items[data[p]] = data[p + 3 : p + 3 + size]
            p += 3 + size
        yield end, items
        at = end


def signed(values: np.ndarray, bits: int) -> np.ndarray:
    """Two's complement of the low ``bits`` bits."""
    v = values.astype(np.int32) & ((1 << bits) - 1)
    return np.where(v >> (bits - 1), v - (1 << bits), v)


def frames_b(data: bytes, plane: int = 0) -> Iterator[dict]:
    """Frames of format B: closed groups only, the chosen receive plane, transmit chains in ascending order, two at most."""
    number = lambda r, tag: int.from_bytes(r.get(tag, b""), "little")
    group, held, k = None, [], 0
    for _, r in records_b(data):
        seq = number(r, B_TAGS["sequence"])
        if seq >> 16 != group:
            group, held = seq >> 16, []
        held.append(r)
        if not seq & CLOSES:
            continue
        mine = sorted((x for x in held if number(x, B_TAGS["rpi"]) == plane), key=lambda x: number(x, B_TAGS["tpi"]))[:2] or held[:1]
        first = mine[0]
        bins = B_BINS.get(number(first, B_TAGS["width"]), 0)
        planes: list[np.ndarray | None] = []
        for x in mine:
            parts = [x.get(B_TAGS[c], b"") for c in ("real", "imag")]
            good = bins and all(len(p) == 2 * bins for p in parts)
            planes.append(np.stack([np.fft.fftshift(signed(np.frombuffer(p, "<u2"), 14)) for p in parts], 1).astype(np.float32) if good else None)
        planes = [p for p in planes if p is not None]
        planes += [None] * (2 - len(planes))
        rssi = int(signed(np.array([number(first, B_TAGS["rssi"])]), 8)[0])
        time = number(first, B_TAGS["time"])
        yield {"frame": k, "tick": time, "coarse": time * 1000, "rssi": rssi, "source": mac_text(first.get(B_TAGS["mac"], b"")), "num_rx": sum(p is not None for p in planes), "num_tx": 1, "num_sc": bins, "planes": planes}
        group, held, k = None, [], k + 1


def _batches(capture: str, frames: Iterator[dict]) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for f in frames:
        (p0, p1) = f.pop("planes")
        column = lambda p, c: None if p is None else p[:, c]
        held.append(f | {"capture": capture, "re0": column(p0, 0), "im0": column(p0, 1), "re1": column(p1, 0), "im1": column(p1, 1)})
        if len(held) == ROWS:
            yield pa.RecordBatch.from_pylist(held, _ARROW)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, _ARROW)


class _Range(InputPartition):
    def __init__(self, path: str, start: int, stop: int, base: int, stride: int = 0):
        self.path, self.start, self.stop, self.base, self.stride = path, start, stop, base, stride


class CaptureReader(DataSourceReader):
    def __init__(self, options):
        self.root = os.path.abspath(options["path"])
        self.plane = int(options.get("plane", "0"))
        self.split = int(options.get("splitBytes", str(64 << 20)))

    def partitions(self):
        """A partition for each file; files of format A with one record size are cut at record boundaries."""
        files = [self.root] if os.path.isfile(self.root) else [os.path.join(d, f) for d, _, names in os.walk(self.root, followlinks=False) for f in names if f.endswith((".dat", ".bin"))]
        out = []
        for path in sorted(files):
            size = os.path.getsize(path)
            with open(path, "rb") as f:
                head = f.read(HEADER)
            stride = HEADER + int.from_bytes(head[:4], "little") if len(head) == HEADER and not is_format_b(head) else 0
            step = max(1, self.split // stride) * stride if stride > HEADER and self.split else 0
            if step and size % stride == 0 and size > self.split and self._same_stride(path, size, stride, step):
                out += [_Range(path, a, min(a + step, size), a // stride, stride) for a in range(0, size, step)]
            else:
                out.append(_Range(path, 0, size, 0))
        return out or [_Range("", 0, 0, 0)]

    @staticmethod
    def _same_stride(path: str, size: int, stride: int, step: int) -> bool:
        """Whether a record of the first one's size begins at each cut; the tasks look at the records between."""
        with open(path, "rb") as f:
            for at in [*range(0, size, step), size - stride]:
                f.seek(at)
                if int.from_bytes(f.read(4), "little") + HEADER != stride:
                    return False
        return True

    def read(self, partition):
        """Frames of one range. Files are mapped, so a task holds the pages that it reads and no whole file."""
        if not partition.path or partition.stop <= partition.start:
            return
        with open(partition.path, "rb") as f:
            data = memoryview(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))[partition.start : partition.stop]
        frames = frames_b(data, self.plane) if is_format_b(data[:4]) else walk_a(data, partition.base)
        if partition.stride:
            frames = self._counted(frames, partition)
        inside = os.path.relpath(partition.path, self.root) if os.path.isdir(self.root) else os.path.basename(partition.path)
        yield from _batches(os.path.splitext(inside)[0], frames)

    @staticmethod
    def _counted(frames, partition):
        """The frames of a part of a file, with an error where its records differ in size after all."""
        n = 0
        for n, frame in enumerate(frames, 1):
            yield frame
        if n * partition.stride != partition.stop - partition.start:
            raise ValueError(f"{partition.path} has records of several sizes: read it with splitBytes=0")


class CaptureSource(DataSource):
    """``spark.read.format("wavemill.capture").load(folder)``; register once with ``spark.dataSource.register``."""

    @classmethod
    def name(cls):
        return "wavemill.capture"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return CaptureReader(self.options)


def write_a(path: str, frames: list[dict]) -> None:
    """A format-A file of test frames: tick, coarse, rssi, mac and samples (rx, tx, subcarrier, 2)."""
    with open(path, "wb") as f:
        for x in frames:
            iq = np.asarray(x["iq"], "<i2")
            head = bytearray(HEADER)
            values = {"length": iq.nbytes, "ftm": x["tick"], "num_rx": iq.shape[0], "num_tx": iq.shape[1], "num_sc": iq.shape[2], "rssi": x["rssi"], "mac": x["mac"], "mu": x["coarse"], "rate": x.get("rate", 0)}
            for n, (o, fmt) in A_FIELDS.items():
                struct.pack_into(fmt, head, o, values[n])
            f.write(bytes(head) + iq.tobytes())


def write_b(path: str, records: list[dict]) -> None:
    """A format-B file of test records: group, last, index, time, rssi, width, mac, tpi, rpi, real and imag in bin order."""
    with open(path, "wb") as f:
        for r in records:
            values = [("version", 13, 1), ("time", r["time"], 8), ("rssi", r["rssi"] & 0xFF, 1), ("width", r["width"], 1), ("tpi", r["tpi"], 1), ("rpi", r["rpi"], 1), ("sequence", r["group"] << 16 | r["last"] << 15 | r["index"], 4)]
            body = b"".join(struct.pack("<BH", B_TAGS[n], size) + v.to_bytes(size, "little") for n, v, size in values)
            body += struct.pack("<BH", B_TAGS["mac"], 6) + r["mac"]
            for n in ("real", "imag"):
                raw = (np.asarray(r[n], np.int64) & 0x3FFF).astype("<u2").tobytes()
                body += struct.pack("<BH", B_TAGS[n], len(raw)) + raw
            f.write(struct.pack("<BH", MAGIC, len(body)) + body)
