"""Drifting directions, removal of fast ones and gated direct paths against NumPy over whole keys."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavemill.operators import drift as D
from wavemill.operators.frames import numbered


def channel(seed, n, width=6):
    rng, t = np.random.default_rng(seed), np.arange(n)
    a, b = (rng.normal(size=width) + 1j * rng.normal(size=width) for _ in range(2))
    return 2 + np.sin(t / 40)[:, None] * a + 0.7 * np.sin(t * 2.1)[:, None] * b + 0.05 * (rng.normal(size=(n, width)) + 1j * rng.normal(size=(n, width))) + (t / n)[:, None] * a


def frames_of(spark, keyed):
    rows = [(k, i, r.real.tolist(), r.imag.tolist()) for k, z in keyed.items() for i, r in enumerate(z)]
    df = spark.createDataFrame(rows, "key string, at bigint, re array<double>, im array<double>").repartition(4)
    return numbered(df, "key", ["at"], F.floor(F.col("at") / 100))


def test_drift_of_directions(spark):
    keyed = {"hot": channel(1, 500), "exact": channel(2, 120), "one": channel(3, 50), "none": channel(4, 40)}
    got = {r["key"]: r["drift"] for r in D.direction_drift(D.block_directions(frames_of(spark, keyed), "key", 40), "key").collect()}
    want = {}
    for key, z in keyed.items():
        vectors, a = [], np.c_[np.ones(40), np.arange(40)]
        for s in range(0, len(z) - 40, 40):
            x = z[s : s + 40] - a @ np.linalg.lstsq(a, z[s : s + 40], rcond=None)[0]
            vectors.append(np.linalg.svd(x)[2][0].conj())
        if len(vectors) > 1:
            want[key] = np.median([1 - abs(np.vdot(x, y)) for x, y in zip(vectors, vectors[1:])])
    assert got.keys() == want.keys() == {"hot", "exact"} and all(abs(got[k] - want[k]) < 1e-9 for k in want)


@pytest.mark.parametrize("block", [64, 4096])
def test_fast_directions_go(spark, block):
    keyed = {"hot": channel(5, 400), "small": channel(6, 30)}
    got: dict = {}
    for r in D.without_fast(frames_of(spark, keyed), "key", 7, count=2, block=block).collect():
        got.setdefault(r["key"], {})[r["i"]] = np.array(r["re"]) + 1j * np.array(r["im"])
    for key, z in keyed.items():
        mu = z.mean(0)
        x = z - mu
        high = x - np.stack([np.convolve(c, np.ones(7) / 7, "same") for c in x.T], 1)
        v = np.linalg.eigh(high.conj().T @ high)[1][:, -2:]
        want = x - (x @ v) @ v.conj().T + mu
        assert np.allclose([got[key][i] for i in range(len(z))], want, atol=1e-8)


def test_direct_path(spark):
    rng = np.random.default_rng(7)
    k = np.arange(32)
    z = np.stack([3 * np.exp(-2j * np.pi * k * 4 / 32) + 0.5 * np.exp(-2j * np.pi * k * 15 / 32) + 0.01 * rng.normal(size=32) for _ in range(20)])
    rows = [(i, [None if c == 5 else float(x) for c, x in enumerate(r.real)], [float(x) for x in r.imag], "same") for i, r in enumerate(z)] + [(99, None, None, "none")]
    df = spark.createDataFrame(rows, "i bigint, re array<double>, im array<double>, other string")
    got = {r["i"]: r for r in D.without_direct_path(df).collect()}
    for i, row in enumerate(z):
        row = np.where(k == 5, 0, row)
        h = np.fft.ifft(row, 128)
        peak = int(np.argmax(np.abs(h)))
        for j in range(128):
            if min((j - peak) % 128, (peak - j) % 128) < 6:
                h[j] = 0
        want = np.fft.fft(h)[:32]
        assert got[i]["re"][5] is None and got[i]["other"] == "same"
        assert np.allclose([x for c, x in enumerate(got[i]["re"]) if c != 5], np.delete(want.real, 5)) and np.allclose([x for c, x in enumerate(got[i]["im"]) if c != 5], np.delete(want.imag, 5))
    assert got[99]["re"] is None and D.without_direct_path(df.limit(0)).collect() == []


def delays(z, t, lag):
    step = np.median(np.diff(t))
    k = max(1, int(np.rint(lag / step))) if step > 0 else 1
    d = z[k:] - z[:-k]
    d = d[np.isfinite(d).all(1)]
    if len(d) < 4:
        return len(d), None
    top = np.abs(np.fft.fft(d - d.mean(1, keepdims=True), n=4 * d.shape[1], axis=1)).argmax(1).astype(float)
    top[top > 2 * d.shape[1]] -= 4 * d.shape[1]
    return len(d), top.std()


@pytest.mark.parametrize("block", [32, 4096])
def test_delay_spread(spark, block):
    """Several rates, a lag longer than a block, one longer than a key, repeated times and unknown samples."""
    times = {"hot": np.arange(500) * 0.1, "slow": np.arange(60) * 3.0, "short": np.arange(6) * 1.0, "few": np.arange(9) * 1.0, "still": np.zeros(12), "one": np.zeros(1)}
    keyed = {k: channel(11 + n, len(t)) for n, (k, t) in enumerate(times.items())}
    keyed["hot"][7, 2] = np.nan
    rows = [(k, float(times[k][i]), i, [None if np.isnan(x) else float(x) for x in r.real], [float(x) for x in r.imag]) for k, z in keyed.items() for i, r in enumerate(z)]
    df = spark.createDataFrame(rows, "key string, t double, at bigint, re array<double>, im array<double>").repartition(4)
    df = numbered(df, "key", ["t", "at"], F.floor(F.col("t") / 7))
    got = {r["key"]: (r["n"], r["spread"]) for r in D.delay_spread(df, "key", "t", 6.0, block=block).collect()}
    want = {k: delays(z, times[k], 6.0) for k, z in keyed.items() if len(z) > 1}
    assert got.keys() == want.keys() and want["short"] == (0, None)
    for k, (n, s) in want.items():
        assert got[k][0] == n and (got[k][1] is None if s is None else abs(got[k][1] - s) < 1e-9), k
    assert D.delay_spread(df.limit(0), "key", "t", 6.0).collect() == []


def test_long_lags_of_one_key(spark, monkeypatch):
    """A key whose lag is most of its frames beside one of a single frame's lag: no frame is dealt out as far as the longest lag."""
    rng = np.random.default_rng(11)
    x = {"dense": (700, 0.01), "sparse": (60, 4.0)}
    rows, want = [], {}
    for key, (n, step) in x.items():
        z = rng.normal(size=(n, 6)) + 1j * rng.normal(size=(n, 6))
        lag = max(1, round(4.0 / step))
        d = z[lag:] - z[:-lag]
        top = np.abs(np.fft.fft(d - d.mean(1, keepdims=True), n=24, axis=1)).argmax(1)
        want[key] = (n - lag, np.where(top > 12, top - 24, top).std())
        rows += [(key, i, n, i * step, v.real.tolist(), v.imag.tolist()) for i, v in enumerate(z)]
    df = spark.createDataFrame(rows, "key string, i bigint, n bigint, t double, re array<double>, im array<double>").repartition(5)
    monkeypatch.setattr(D, "in_blocks", None)
    got = {r["key"]: (r["n"], r["spread"]) for r in D.delay_spread(df, "key", "t", 4.0, block=64).collect()}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(abs(got[k][1] - want[k][1]) < 1e-9 for k in want)
