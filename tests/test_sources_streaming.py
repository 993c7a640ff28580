import numpy as np
import pytest
from pyspark.sql import functions as F

from wavemill.sources import captures, decode
from wavemill.streaming import live

MAC = bytes([8, 191, 184, 149, 128, 4])


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    rng, d = np.random.default_rng(1), tmp_path_factory.mktemp("cap")
    iq = rng.integers(-900, 900, (7, 2, 1, 16, 2))
    captures.write_a(str(d / "a.dat"), [{"tick": 100 * k, "coarse": 1000 * k, "rssi": 50, "mac": MAC, "iq": iq[k]} for k in range(7)])
    with open(d / "a.dat", "ab") as f:
        f.write(b"\x10\0\0\0 torn")
    z = rng.integers(-8000, 8000, (5, 2, 2, 64))
    rows = [{"group": g, "last": int(s == 1), "index": s, "time": 1000 + 20 * g, "rssi": -56, "width": 0, "mac": MAC, "tpi": s, "rpi": 0, "real": z[g, s, 0], "imag": z[g, s, 1]} for g in range(5) for s in range(2)]
    captures.write_b(str(d / "b.bin"), rows[:-1])  # the last group never closes
    return str(d), iq, z


def test_both_formats(spark, folder):
    spark.dataSource.register(captures.CaptureSource)
    path, iq, z = folder
    got = {(r.capture, r.frame): r for r in spark.read.format("wavemill.capture").load(path).collect()}
    assert len(got) == 7 + 4
    for k in range(7):
        r = got["a", k]
        assert (r.tick, r.coarse, r.num_rx, r.num_tx, r.num_sc, r.source) == (100 * k, 1000 * k, 2, 1, 16, "08:bf:b8:95:80:04")
        assert np.array_equal(r.re1, iq[k, 1, 0, :, 0]) and np.array_equal(r.im0, iq[k, 0, 0, :, 1])
    for g in range(4):
        r = got["b", g]
        assert (r.tick, r.rssi, r.num_sc) == (1000 + 20 * g, -56, 64)
        assert np.array_equal(r.re0, np.fft.fftshift(z[g, 0, 0])) and np.array_equal(r.im1, np.fft.fftshift(z[g, 1, 1]))


def test_split_reads_the_same(spark, folder, tmp_path):
    spark.dataSource.register(captures.CaptureSource)
    rng = np.random.default_rng(3)
    captures.write_a(str(tmp_path / "u.dat"), [{"tick": k, "coarse": k, "rssi": 1, "mac": MAC, "iq": rng.integers(-9, 9, (1, 1, 8, 2))} for k in range(50)])
    read = lambda n: [tuple(r) for r in spark.read.format("wavemill.capture").option("splitBytes", n).load(str(tmp_path)).orderBy("frame").collect()]
    assert read(1000) == read(1 << 20) and len(read(1000)) == 50


def test_equal_names_in_two_folders(spark, tmp_path):
    spark.dataSource.register(captures.CaptureSource)
    for day, n in (("d1", 2), ("d2", 3)):
        (tmp_path / day).mkdir()
        captures.write_a(str(tmp_path / day / "x.dat"), [{"tick": k, "coarse": k, "rssi": 1, "mac": MAC, "iq": np.ones((1, 1, 4, 2))} for k in range(n)])
    got = spark.read.format("wavemill.capture").load(str(tmp_path)).groupBy("capture").count().collect()
    assert {r["capture"]: r["count"] for r in got} == {"d1/x": 2, "d2/x": 3}


def test_planes(spark, folder):
    spark.dataSource.register(captures.CaptureSource)
    path, _, z = folder
    r = decode.planes(spark.read.format("wavemill.capture").load(path)).where("capture = 'b' AND frame = 2").first()
    a, b = (np.fft.fftshift(z[2, s, 0] + 1j * z[2, s, 1]) for s in range(2))
    assert np.allclose(r.ratio_amp, 20 * np.log10(np.abs(b / a))) and np.allclose(np.exp(1j * np.array(r.ratio_phase)), (b / a) / np.abs(b / a))
    words = spark.range(1).select(*decode.rate_words(F.lit(3 << 8 | 2 << 11)), *decode.rate_words(F.lit(7 << 8 | 7 << 11))).first()
    assert tuple(words) == ("VHT", "80", "unknown", "unknown")


def signal():
    rng = np.random.default_rng(5)
    t = np.cumsum(rng.uniform(0.018, 0.028, 900))
    t[500:] += 8
    v = rng.normal(0, 0.01, 900) + np.where((t > 6) & (t < 9), np.sin(5 * t), 0)
    return t, v


def test_chunks_do_not_matter():
    t, v = signal()
    whole = live.advance(t, v, None)[0]
    for size in (1, 7, 250):
        got, kt, kv, hop = [], np.zeros(0), np.zeros(0), None
        for k in range(0, len(t), size):
            out, kt, kv, hop = live.advance(np.concatenate([kt, t[k : k + size]]), np.concatenate([kv, v[k : k + size]]), hop)
            got += out
        assert np.allclose(np.array(got), np.array(whole), equal_nan=True)


def test_stream_equals_batch(spark, tmp_path):
    t, v = signal()
    for k in range(3):
        part = slice(300 * k, 300 * k + 300)
        spark.createDataFrame([("s", float(a), float(b)) for a, b in zip(t[part], v[part])], "source string, t double, value double").coalesce(1).write.parquet(str(tmp_path / "in"), mode="append")
    stream = live.follow(spark, str(tmp_path / "in"), "source string, t double, value double", 1)
    q = live.self_ratio(stream).writeStream.format("memory").queryName("ratios").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = [(r.t, r.ratio) for r in spark.table("ratios").orderBy("t").collect()]
    assert np.allclose(np.array(got, float), np.array(live.advance(t, v, None)[0]), equal_nan=True)
