"""Captures cut anywhere: the frames of byte ranges against those of a walk over the whole file."""

import struct

import numpy as np
import pytest

from wavemill.sources import captures, ranges

MAC, OTHER = bytes([8, 191, 184, 149, 128, 4]), bytes([1, 2, 3, 4, 5, 0xAC])


def format_b(path, seed, groups=40, extra=b"", never=()):
    """Records of groups of one to four chains, with 0xAC among the samples, mixed widths, two planes and some groups that never close."""
    rng, rows = np.random.default_rng(seed), []
    for g in range(groups):
        width, chains = int(rng.choice([0, 0, 1])), int(rng.integers(1, 5))
        for k in range(chains):
            n = captures.B_BINS[width]
            z = np.where(rng.random((2, n)) < 0.2, 0xAC, rng.integers(-8000, 8000, (2, n)))
            rows.append({"group": g, "last": int(k == chains - 1 and g not in never), "index": k, "time": 1000 + 20 * g, "rssi": int(-rng.integers(30, 90)), "width": width, "mac": MAC if g % 3 else OTHER, "tpi": int(rng.integers(0, 2)), "rpi": int(rng.integers(0, 2)), "real": z[0], "imag": z[1]})
    captures.write_b(str(path), rows)
    with open(path, "ab") as f:
        f.write(extra)


def format_a(path, seed, frames=60, mixed=False, extra=b""):
    rng = np.random.default_rng(seed)
    captures.write_a(str(path), [{"tick": 100 * k, "coarse": 1000 * k, "rssi": 50 + k, "mac": MAC, "iq": rng.integers(-900, 900, (2 if mixed and k % 3 else 1, 2, 16, 2))} for k in range(frames)])
    with open(path, "ab") as f:
        f.write(extra)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("ranges")
    (d / "day 1").mkdir()
    (d / "day%2").mkdir()
    format_b(d / "day 1" / "plain.bin", 1)
    format_b(d / "day 1" / "open.bin", 2, never=(0, 1, 7, 8, 9, 39), extra=struct.pack("<BH", 0xAC, 500) + b"\0\1")
    whole = (d / "day 1" / "plain.bin").read_bytes()
    (d / "day%2" / "broken.bin").write_bytes(whole[:9000] + b"\0\0\0" + whole)
    (d / "day%2" / "torn.bin").write_bytes(whole[:-5])
    (d / "day%2" / "not.bin").write_bytes(b"\7" + whole)
    format_a(d / "same.dat", 3, extra=b"\x10\0\0\0 torn")
    format_a(d / "mixed.dat", 4, mixed=True)
    format_b(d / "one.bin", 5, groups=1)
    (d / "empty.bin").write_bytes(b"")
    (d / "note.txt").write_bytes(whole)
    return d


def key(rows):
    plain = lambda x: None if x is None else tuple(x) if isinstance(x, (list, np.ndarray)) else x
    return sorted(tuple(plain(x) for x in r) for r in rows)


@pytest.mark.parametrize("size", [700, 5000, 20_000, 1 << 26])
def test_any_cut_gives_the_same_frames(spark, folder, size):
    spark.dataSource.register(captures.CaptureSource)
    want = key(spark.read.format("wavemill.capture").option("splitBytes", 0).load(str(folder)).collect())
    assert len(want) > 200
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    try:
        for name, value in zip(names, (str(size), "1", "1")):
            spark.conf.set(name, value)
        assert key(ranges.read_captures(spark, str(folder)).collect()) == want
        if size == 5000:
            one = key(spark.read.format("wavemill.capture").option("splitBytes", 0).option("plane", 1).load(str(folder)).collect())
            assert key(ranges.read_captures(spark, str(folder), plane=1).collect()) == one != want
    finally:
        for name in names:
            spark.conf.unset(name)


def test_other_file_systems(spark, folder):
    """A path that only Spark can open."""
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.caps.link./in", f"file://{folder}")
    mounted = key(ranges.read_captures(spark, "viewfs://caps/in").collect())
    assert mounted == key(ranges.read_captures(spark, f"file://{folder}").collect()) and {r[0] for r in mounted} >= {"day 1/plain", "same"}
    assert {r["capture"] for r in ranges.read_captures(spark, f"{folder}/one.bin").collect()} == {"one"}


def test_one_range_at_a_time():
    """Pieces of every size, put in line without Spark."""
    rng = np.random.default_rng(8)
    body = lambda g, last: b"".join(struct.pack("<BH", t, len(v)) + v for t, v in ((0, b"\x0d"), (18, struct.pack("<I", g << 16 | last << 15)), (8, rng.bytes(20))))
    record = lambda g, last: struct.pack("<BH", 0xAC, len(body(g, last))) + body(g, last)
    data = b"".join(record(g, last) for g in range(30) for last in (0, 1))
    whole = ranges.Line("B", len(data)).feed(data)
    assert len(whole) == 30
    for step in (1, 7, 33, 100):
        line = ranges.Line("B", len(data))
        assert [f for k in range(0, len(data), step) for f in line.feed(data[k : k + step])] == whole and line.clean()
