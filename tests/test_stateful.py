"""The segment sink and the stateful streams: any batching and order gives the same, failures leave nothing, state ends."""

import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavemill.sources import ranges, segments
from wavemill.streaming import live, stateful

STORE = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture(autouse=True)
def rocks(spark):
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.dataSource.register(segments.SegmentSink)
    yield
    spark.conf.unset(STORE)


def records(seed, n):
    """Records whose bodies may hold the magic byte."""
    rng = np.random.default_rng(seed)
    items = lambda k: ((0, b"\x0d"), (18, struct.pack("<I", k << 16 | 1 << 15)), (8, bytes(rng.choice([0xAC, 1, 2], int(rng.integers(0, 300))).astype(np.uint8))))
    out = []
    for k in range(n):
        body = b"".join(struct.pack("<BH", t, len(v)) + v for t, v in items(k))
        out.append(struct.pack("<BH", 0xAC, len(body)) + body)
    return out


def test_segments_are_cut_between_records(spark, tmp_path):
    root, rows = str(tmp_path / "out"), {s: records(k, 60) for k, s in enumerate(("a/b", "c"))}
    df = spark.createDataFrame([(s, k, r) for s, v in rows.items() for k, r in enumerate(v)], "source string, seq bigint, record binary")
    write = lambda df, mode: df.repartitionByRange(3, "source", "seq").sortWithinPartitions("source", "seq").write.format("wavemill.segments").option("segmentBytes", 1000).mode(mode).save(root)
    write(df, "append")
    found = segments.segments(root)
    assert {os.path.basename(os.path.dirname(f)) for f in found} == {"a%2Fb", "c"} and len(found) > 8
    for s, name in (("a/b", "a%2Fb"), ("c", "c")):
        parts = [open(f, "rb").read() for f in found if f"/{name}/" in f]
        assert b"".join(parts) == b"".join(rows[s])
        assert all(not (w := ranges.Walk(p, 0, "B")).broken and w.at == len(p) for p in parts) and all(len(p) < 1000 + 400 for p in parts)
    assert not [d for d in os.listdir(root) if d.startswith("_hidden")]
    write(df.where("source = 'c'"), "overwrite")
    again = segments.segments(root)
    assert b"".join(open(f, "rb").read() for f in again) == b"".join(rows["c"])
    with pytest.raises(Exception, match="broken on purpose"):
        write(df.withColumn("record", F.when(F.col("seq") == 40, F.raise_error(F.lit("broken on purpose")).cast("binary")).otherwise(F.col("record"))), "append")
    assert segments.segments(root) == again


def run(stream, tmp_path, name, sink="memory", **options):
    writer = stream.writeStream.format(sink).option("checkpointLocation", str(tmp_path / f"ck-{name}")).trigger(availableNow=True)
    for k, v in options.items():
        writer = writer.option(k, v)
    q = (writer.queryName(name) if sink == "memory" else writer).start()
    assert q.awaitTermination(240)
    return q


def chunked(data, rng):
    cuts = np.sort(rng.integers(0, len(data), 25)).tolist()
    return [data[a:b] for a, b in zip([0, *cuts], [*cuts, len(data)])]


CHUNKS = "source string, x double, seq bigint, chunk binary"


def put(spark, folder, rows):
    df = spark.createDataFrame(rows, CHUNKS).select("source", F.timestamp_micros((F.col("x") * 1e6).cast("bigint")).alias("ts"), "seq", "chunk")
    df.coalesce(1).write.parquet(folder, mode="append")


def test_chunks_to_segments_with_a_restart(spark, tmp_path):
    """Chunks cut anywhere, out of order and repeated, over several batches and a restarted query, come back as the same records."""
    rng, want = np.random.default_rng(4), {s: records(k + 10, 80) for k, s in enumerate("xy")}
    rows = [(s, 1e9 + k / 100, k, c) for s, v in want.items() for k, c in enumerate(chunked(b"".join(v), rng))]
    order = rng.permutation(len(rows)).tolist()
    folder, root = str(tmp_path / "in"), str(tmp_path / "out")
    for part in (order[:15], order[15:30]):
        put(spark, folder, [rows[k] for k in part])
    whole = lambda: stateful.whole_records(live.follow(spark, folder, "source string, ts timestamp, seq bigint, chunk binary", 1))
    run(whole(), tmp_path, "seg", "wavemill.segments", path=root, segmentBytes="2000")
    put(spark, folder, [rows[k] for k in order[30:] + order[:5]])
    run(whole(), tmp_path, "seg", "wavemill.segments", path=root, segmentBytes="2000")
    for s, v in want.items():
        assert b"".join(open(f, "rb").read() for f in segments.segments(root) if f"/{s}/" in f) == b"".join(v)


def test_missing_chunks_and_silence(spark, tmp_path):
    """A chunk that never comes is given up after the wait; a source that falls silent has no state left."""
    want, rng = records(30, 120), np.random.default_rng(6)
    chunks = chunked(b"".join(want), rng)
    folder = str(tmp_path / "in")
    put(spark, folder, [("x", 1e9 + k, k, c) for k, c in enumerate(chunks) if k != 9])
    put(spark, folder, [("z", 1e9 + 200, 0, b"")])  # the clock goes on: the wait is over, then the silence
    put(spark, folder, [("z", 1e9 + 9000, 1, b"")])
    put(spark, folder, [("z", 1e9 + 9100, 2, b"")])
    stream = stateful.whole_records(live.follow(spark, folder, "source string, ts timestamp, seq bigint, chunk binary", 1))
    q = run(stream, tmp_path, "gap")
    got = [bytes(r.record) for r in spark.table("gap").where("source = 'x'").orderBy("seq").collect()]
    lost = len(b"".join(chunks[:9])), len(b"".join(chunks[:10]))
    ends = np.cumsum([len(r) for r in want])
    kept = [r for r, e in zip(want, ends) if e <= lost[0] or e - len(r) >= lost[1]]
    assert got[: sum(e <= lost[0] for e in ends)] == kept[: sum(e <= lost[0] for e in ends)]
    assert got[-20:] == want[-20:] and set(got) <= set(want) and len(got) >= len(kept) - 2
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 3  # of "z" alone: its state and its timer


def test_repeated_batch_replaces_its_files(tmp_path):
    writer = segments.StreamWriter({"path": str(tmp_path)})
    for text in (b"first", b"again"):
        os.makedirs(writer.hidden, exist_ok=True)
        with open(f"{writer.hidden}/f", "wb") as f:
            f.write(text)
        message = segments.Written([(f"{writer.hidden}/f", "s/seg-{write}-00000-00000.bin")])
        writer.commit([message, None], 7)
        writer.commit([message, None], 7)
        (only,) = segments.segments(str(tmp_path))
        assert open(only, "rb").read() == text
    open(f"{writer.hidden}/g", "wb").close()
    writer.abort([segments.Written([(f"{writer.hidden}/g", "s/seg-{write}-0-1.bin")]), None], 8)
    assert len(segments.segments(str(tmp_path))) == 1 and not os.path.exists(f"{writer.hidden}/g")


def signal(seed, n=400, width=6):
    rng = np.random.default_rng(seed)
    t = 1_700_000_000 + np.round(np.cumsum(rng.uniform(0.018, 0.028, n)), 6)
    t[n // 2 :] += 8
    r = 1 + 0.5j + 0.01 * (rng.normal(size=(n, width)) + 1j * rng.normal(size=(n, width))) + np.where((t % 7 < 3)[:, None], np.sin(5 * t)[:, None], 0)
    r[rng.random(r.shape) < 0.02] = np.nan
    return t, r


def loop_ratio(t, r, at):
    """The ratio of one window, pair by pair."""
    inside = [k for k in range(len(t)) if at - live.WINDOW < t[k] <= at]
    if len(inside) < 3:
        return float("nan")
    dt = float(np.median([t[b] - t[a] for a, b in zip(inside, inside[1:])]))
    need, lag = max(2, int(0.5 * live.WINDOW / dt)), max(1, round(live.LAG / dt))

    def steps(back, most):
        out = []
        for k in inside:
            if k >= back and t[k] - t[k - back] <= most:
                v = [abs(a - b) / (abs(a) + abs(b)) for a, b in zip(r[k], r[k - back]) if np.isfinite(a) and np.isfinite(b)]
                out += [float(np.median(v))] if v else []
        return out

    one, far = steps(1, 2.5 * dt), steps(lag, 1.5 * live.LAG + dt)
    return float(np.median(far) / np.median(one)) if min(len(one), len(far)) >= need else float("nan")


def test_vector_ratio_against_a_loop():
    t, r = signal(3)
    hops = live.advance(t, r, None, lambda t, v, at: at)[0]
    got = [stateful.vector_ratio_at(t, r, h) for h, _ in hops]
    want = [loop_ratio(t, r, h) for h, _ in hops]
    assert np.allclose(got, want, equal_nan=True) and np.isfinite(got).sum() > 20


@pytest.mark.parametrize("parts", [2, 6])
def test_vector_stream_equals_batch_and_ends(spark, tmp_path, parts):
    keyed = {"a": signal(1), "b": signal(2, 250, 4)}
    rows = [(s, float(x), [float(y.real) for y in v], [float(y.imag) for y in v]) for s, (t, r) in keyed.items() for x, v in zip(t, r)]
    rng = np.random.default_rng(parts)
    rows.sort(key=lambda x: x[1] + rng.uniform(0, 0.5))  # late by half a second at most
    for k in range(parts):
        some = rows[k * len(rows) // parts : (k + 1) * len(rows) // parts]
        df = spark.createDataFrame(some, "source string, x double, re array<double>, im array<double>").select("source", F.timestamp_micros(F.round(F.col("x") * 1e6).cast("bigint")).alias("ts"), "re", "im")
        df.coalesce(1).write.parquet(str(tmp_path / "in"), mode="append")
    end = spark.createDataFrame([("end", 1_700_001_000.0, [0.0], [0.0])], "source string, x double, re array<double>, im array<double>").select("source", F.timestamp_seconds("x").alias("ts"), "re", "im")
    end.coalesce(1).write.parquet(str(tmp_path / "in"), mode="append")
    stream = stateful.vector_self_ratio(live.follow(spark, str(tmp_path / "in"), "source string, ts timestamp, re array<double>, im array<double>", 1))
    q = run(stream, tmp_path, f"vr{parts}")
    got = {s: [(x.t, x.ratio) for x in spark.table(f"vr{parts}").where(F.col("source") == s).orderBy("t").collect()] for s in keyed}
    for s, (t, r) in keyed.items():
        want = live.advance(t, r, None, stateful.vector_ratio_at, 2 * live.WINDOW + 1.5 * live.LAG)[0]
        assert np.allclose(np.array(got[s], float), np.array(want), equal_nan=True)
    left = q.lastProgress["stateOperators"][0]
    assert left["numRowsTotal"] <= 3  # of "end" alone: its state and its timer
