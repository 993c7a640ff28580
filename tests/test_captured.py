"""Captures at size: batches encoded and decoded at once, small files read once and whole, each against the plain way."""

import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wavemill.plans import capture_queries
from wavemill.sources import captures, decode, ranges, records

SAMPLES = ("re0", "im0", "re1", "im1")
MACS = ("08:bf:b8:95:80:04", "01:02:03:04:05:ac")


def frames(n, widths, seed=1):
    rng = np.random.default_rng(seed)
    return [{"source": str(k % 3), "seq": 65_000 + k, "tick": int(rng.integers(0, 1 << 45)), "rssi": int(-rng.integers(1, 120)), "mac": MACS[k % 2], **{c: rng.integers(-8192, 8192, w).tolist() for c in SAMPLES}} for k in range(n) for w in [int(rng.choice(widths))]]


def batch(rows):
    return pa.RecordBatch.from_pylist(rows, pa.schema([("source", pa.string()), ("seq", pa.int64()), ("tick", pa.int64()), ("rssi", pa.int32()), ("mac", pa.string())] + [(c, pa.list_(pa.int64())) for c in SAMPLES]))


def plain(x):
    return b"".join(records.record(x["seq"], k, k == 1, x["tick"], x["rssi"], bytes.fromhex(x["mac"].replace(":", "")), x[f"re{k}"], x[f"im{k}"]) for k in range(2))


@pytest.mark.parametrize("width", [64, 128, 256])
def test_batches_encode_as_records(width):
    rows = frames(50, [width])
    assert records.alike(batch(rows)).to_pylist() == [plain(x) for x in rows]
    assert records.alike(batch(rows).slice(7, 9)).to_pylist() == [plain(x) for x in rows[7:16]]


def test_other_batches_go_record_by_record(spark):
    rows = frames(40, [64, 128])
    assert records.alike(batch(rows)) is None
    df = spark.createDataFrame(rows, "source string, seq bigint, tick bigint, rssi int, mac string, re0 array<bigint>, im0 array<bigint>, re1 array<bigint>, im1 array<bigint>")
    assert {r["seq"]: bytes(r["record"]) for r in records.encode(df).collect()} == {x["seq"]: plain(x) for x in rows}


def test_walk_and_decoding_against_the_plain_walk():
    for widths in ([64], [64, 128, 256]):
        data = b"".join(plain(x) for x in frames(3000, widths))
        walk = ranges.Walk(data, 0, "B")
        assert walk.ends == [end for end, _ in captures.records_b(data)] and walk.closes == [False, True] * 3000 and not walk.broken
        assert walk.groups == [(65_000 + k) & 0xFFFF for k in range(3000) for _ in range(2)]
        got = [r for b in ranges.decode_b(data, 0) for r in b.to_pylist()]
        assert [{k: v for k, v in r.items() if k != "capture"} for r in got] == [{k: v for k, v in r.items() if k != "capture"} for b in captures._batches("", captures.frames_b(data)) for r in b.to_pylist()]


def test_decoding_is_not_frame_by_frame():
    data = b"".join(plain(x) for x in frames(4000, [64]))

    def took(f):
        began = time.perf_counter()
        assert sum(b.num_rows for b in f()) == 4000
        return time.perf_counter() - began

    plain_s = took(lambda: captures._batches("", captures.frames_b(data)))
    assert min(took(lambda: ranges.decode_b(data, 0)) for _ in range(3)) < plain_s / 4


def test_small_files_are_read_once(spark, tmp_path):
    """No ranges, no lines and no join for files that Spark would not cut; larger ones beside them are cut."""
    rows = frames(60, [64])
    for name, some in (("a/seg%20 1.bin", rows[:5]), ("a/two.bin", rows[5:7]), ("b/long.dat", rows[7:])):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"".join(plain(x) for x in some) + b"\xac\xff")
    want = sorted((c, k, x["tick"], tuple(x["im1"])) for c, some in (("a/seg%20 1", rows[:5]), ("a/two", rows[5:7]), ("b/long", rows[7:])) for k, x in enumerate(some))
    key = lambda df: sorted((r["capture"], r["frame"], r["tick"], tuple(map(int, r["im1"]))) for r in df.collect())
    df = ranges.read_captures(spark, str(tmp_path))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert key(df) == want and "Join" not in plan and plan.count("MapInArrow") == 1
    name = "spark.sql.files.maxPartitionBytes"
    try:
        spark.conf.set(name, "8k")
        df = ranges.read_captures(spark, str(tmp_path))
        assert "Join" in df._jdf.queryExecution().executedPlan().toString() and key(df) == want
    finally:
        spark.conf.unset(name)


def test_records_are_made_after_they_are_in_order(spark, sf, monkeypatch):
    """Frames are put in order before samples are made: what encodes them runs once, and no shuffle carries records."""
    seen, encode = [], records.encode

    def spy(rows):
        made = encode(rows)
        seen.append(made)
        return made

    monkeypatch.setattr(records, "encode", spy)
    capture_queries.captured(spark, sf)
    plan = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("RepartitionByExpression")  # the lower operator comes later


def test_ratio_cells(spark):
    rows = [(1, [3.0, 0.0, 1.0], [4.0, 0.0, 0.0], [1.0, 2.0, 0.0], [0.0, 2.0, 0.0]), (2, [1.0], [2.0], None, None), (3, None, None, None, None), (4, [5.0], [-7.0], [-2.0], [0.0])]
    df = spark.createDataFrame(rows, "id int, re0 array<float>, im0 array<float>, re1 array<float>, im1 array<float>")
    want = decode.planes(df).select("id", F.posexplode("ratio_amp").alias("sc", "ratio_amp")).where("ratio_amp IS NOT NULL").collect()
    assert sorted(decode.ratio_cells(df, "id").collect()) == sorted(want) and len(want) == 2
