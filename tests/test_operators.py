"""Operators against plain Python on small, awkward tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavemill.functions import arrays as A
from wavemill.functions import filters
from wavemill.operators import frames, joins


def test_quantiles_are_exact(spark):
    rng = np.random.default_rng(1)
    rows = [("a", float(v)) for v in rng.normal(0, 30, 997)] + [("b", 5.0)] * 40 + [("c", 1.5)] + [("d", None)] + [("a", None)] + [("e", v) for v in (1.0, 2.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    for width in (0.5, 7.0, 1000.0):
        got = {r.k: (r.n, r.q0, r.q1, r.q2) for r in frames.quantiles(df, "k", "v", [0.01, 0.5, 0.95], width).collect()}
        for k in "abce":
            x = [v for kk, v in rows if kk == k and v is not None]
            assert got[k] == pytest.approx((len(x), *np.quantile(x, [0.01, 0.5, 0.95])))
        assert "d" not in got
    assert frames.quantiles(df.limit(0), "k", "v", [0.5], 1.0).collect() == []


def test_nearest_pool_with_ties(spark):
    rng = np.random.default_rng(2)
    rows = [(i, "ab"[i % 7 == 0], float(rng.integers(0, 40))) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, k string, t double")
    pool = df.where("id % 3 = 0")
    got = {(r.id, r["rank"]): (r.other, r.away) for r in joins.nearest_pool(df, pool, "k", "t", "id", 6.0, 3).collect()}
    want = {}
    for i, k, t in rows:
        near = sorted((abs(t - u), j) for j, kk, u in rows if j % 3 == 0 and kk == k and j != i and abs(t - u) <= 6)[:3]
        want |= {(i, n + 1): (j, d) for n, (d, j) in enumerate(near)}
    assert got == want


def test_sessions_and_running_over_blocks(spark):
    df = spark.range(400).selectExpr("'a' AS k", "CAST(id * 3 + IF(id >= 100, 50, 0) + IF(id >= 250, 500, 0) AS double) AS t", "id")
    for block in (10.0, 97.0, 1e6):
        got = [(r.session, r.start, r.stop, r.n) for r in frames.sessions(df, "k", "t", "id", 20.0, block).orderBy("session").collect()]
        assert got == [(0, 0.0, 297.0, 100), (1, 350.0, 797.0, 150), (2, 1300.0, 1747.0, 150)]


def test_states_are_carried_over_blocks(spark):
    changes = spark.createDataFrame([("a", 3.2, 1, "+"), ("a", 50.0, 2, "-"), ("b", 7.5, 3, "+")], "k string, t double, i int, s string")
    cells = spark.range(80).selectExpr("explode(array('a', 'b')) AS k", "id AS col")
    want = {(k, c): ("absent" if c + 0.5 < (3.2 if k == "a" else 7.5) else "-" if k == "a" and c + 0.5 >= 50 else "+") for k in "ab" for c in range(80)}
    for block in (4, 1000):
        assert {(r.k, r.col): r.state for r in joins.state_on_cells(changes, cells, "k", "t", "i", "s", 1.0, block).collect()} == want


def _by_hand(b, a, x):
    """Forwards and backwards, one sample at a time."""
    pad, x = 3 * max(len(a), len(b)), list(x)
    if len(x) <= pad:
        return x
    wide = [2 * x[0] - v for v in x[pad:0:-1]] + x + [2 * x[-1] - v for v in x[-2 : -pad - 2 : -1]]

    def run(w):
        past, out, k = [w[0]] * (len(a) - 1), [], len(a) - 1
        gain = sum(b) / sum(a)
        done = [gain * w[0]] * k  # what the filter gives after a long run of the first value
        for v in w:
            y = sum(c * u for c, u in zip(b, [v, *past])) - sum(c * u for c, u in zip(a[1:], done))
            past, done = [v, *past][:k], [y, *done][:k]
            out.append(y)
        return out

    return run(run(wide)[::-1])[::-1][pad:-pad]


@pytest.mark.parametrize("low,high", [(1.0, None), (0.5, 2.0), (None, 1.5)])
def test_zero_phase_filters(spark, low, high):
    b, a = filters.butterworth(2, low, high, 10.0)
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(2, 1, n).tolist() if n >= 0 else None) for i, n in enumerate((60, 45, 60, 5, 0, -1))]
    got = {r.i: r.y for r in spark.createDataFrame(rows, "i int, x array<double>").select("i", filters.zero_phase(F.col("x"), b, a).alias("y")).collect()}
    for i, x in rows:
        assert got[i] is None if x is None else got[i] == pytest.approx(_by_hand(b, a, x), abs=1e-9)
    w = np.exp(-2j * np.pi * np.array([low or 0.0, high or low]) / 10)
    edge = np.abs(np.polyval(b[::-1], w) / np.polyval(a[::-1], w))
    assert edge[-1] == pytest.approx(2**-0.5, abs=1e-6)


def test_unwrap(spark):
    x = np.cumsum(np.random.default_rng(5).normal(0, 2.9, 200))
    got = spark.createDataFrame([([float(v) for v in np.angle(np.exp(1j * x))],)], "x array<double>").select(A.unwrap(F.col("x")).alias("y")).first().y
    assert got == pytest.approx(np.unwrap(np.angle(np.exp(1j * x))).tolist())


def test_hampel_orders_a_neighbourhood_once(spark):
    """The neighbours and their median are bound, not computed again for each neighbour; against a loop."""
    x = np.random.default_rng(13).standard_cauchy((4, 30))
    df = spark.createDataFrame([(v.tolist(),) for v in x], "x array<double>").select("x", A.hampel(F.col("x"), 3, 3.0).alias("h"))
    for r in df.collect():
        v = np.array(r.x)
        near = v[np.clip(np.arange(30)[:, None] + np.arange(-3, 4), 0, 29)]
        mid = np.median(near, axis=1)
        spread = np.median(np.abs(near - mid[:, None]), axis=1)
        assert r.h == np.where(np.abs(v - mid) > 3.0 * 1.4826 * spread, mid, v).tolist()
    assert df._jdf.queryExecution().analyzed().toString().count("array_sort(") == 2
