"""Gain states against loops over frames and a singular value decomposition of all differences at once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavemill.operators import gains as G
from wavemill.operators.frames import numbered


def shapes(level):
    with np.errstate(all="ignore"):
        return level - np.nanmedian(level, axis=1, keepdims=True)


def loop(level, state, near=50):
    """Offsets, basis, floor and corrected frames of one key, frame by frame."""
    values, counts = np.unique(state, return_counts=True)
    main, s, deltas = values[np.argmax(counts)], shapes(level), {}
    true = np.flatnonzero(state == main)
    for k in np.flatnonzero(state != main):
        other = [j for j in true if abs(j - k) <= near]
        if len(other) >= 8:
            deltas[k] = s[k] - np.nanmedian(s[other], axis=0)
    offsets = {}
    for v in values:
        rows = [deltas[k] for k in deltas if state[k] == v]
        if len(rows) >= 20:
            o = np.nanmedian(np.array(rows), axis=0)
            offsets[v] = np.nan_to_num(o - np.nanmedian(o))
    basis, floor = None, 0.0
    d = np.array(list(deltas.values()))
    if len(d) >= 30 and np.isfinite(d).all(0).sum() >= 8:
        known = np.isfinite(d).all(0)
        _, _, vt = np.linalg.svd(d[:, known] - d[:, known].mean(0), full_matrices=False)
        span = np.array([v - v.mean() for v in vt[:3]])
        basis = np.zeros((3, level.shape[1]))
        basis[:, known] = np.linalg.qr(span.T)[0].T
        y = np.where(np.isfinite(s), s, 0) @ basis.T
        moves = {}
        for k in range(len(state)):
            other = [j for j in true if abs(j - k) <= near and j != k]
            if len(other) >= 8:
                moves[k] = y[k] - np.median(y[other], axis=0)
        floor = np.percentile([np.linalg.norm(moves[k]) for k in true if k in moves], 99)
    out = level.copy()
    for k in np.flatnonzero(state != main):
        if basis is not None and k in moves and np.linalg.norm(moves[k]) > floor:
            out[k] -= moves[k] @ basis
        elif state[k] in offsets:
            out[k] -= offsets[state[k]]
    return offsets, basis, floor, out


def capture(seed, n, width=14, holes=True):
    rng = np.random.default_rng(seed)
    shape = 3 * np.sin(np.arange(width) * 0.7) + np.cumsum(rng.normal(0, 0.05, (n, 1)), axis=0)
    state = rng.choice([40, 41, 43, 50], n, p=[0.7, 0.15, 0.12, 0.03])
    bends = {41: np.linspace(-2, 2, width), 43: np.cos(np.arange(width)), 50: np.sin(np.arange(width) * 2), 40: np.zeros(width)}
    level = shape + rng.normal(0, 0.2, (n, width)) + np.array([bends[x] * rng.uniform(0.2, 2) for x in state])
    if holes:
        level[:, 3] = np.nan
        level[rng.random((n, width)) < 0.0005] = np.nan
    return level, state


def frames_of(spark, keyed):
    rows = [(k, i, int(s), [None if np.isnan(x) else float(x) for x in v]) for k, (level, state) in keyed.items() for i, (v, s) in enumerate(zip(level, state))]
    return numbered(spark.createDataFrame(rows, "key string, at bigint, gain int, level array<double>").repartition(4), "key", ["at"], F.floor(F.col("at") / 100))


def matrix(rows):
    return np.array([[np.nan if x is None else x for x in r] for r in rows], float)


@pytest.mark.parametrize("consecutive", [True, False])
def test_against_loops(spark, consecutive):
    keyed = {"hot": capture(1, 900), "few": capture(2, 60), "whole": capture(3, 300, holes=False)}
    got: dict = {}
    for r in G.without_gain(frames_of(spark, keyed), "key", "gain", "level", consecutive, block=256).collect():
        got.setdefault(r["key"], {})[r["at"]] = r["corrected"]
    for key, (level, state) in keyed.items():
        offsets, basis, floor, want = loop(level, state)
        if not consecutive:
            main, want = np.bincount(state).argmax(), level.copy()
            for v, o in offsets.items():
                want[state == v] -= o if v != main else 0
        have = matrix([got[key][i] for i in range(len(state))])
        assert (np.isnan(have) == np.isnan(want)).all() and np.nanmax(np.abs(have - want)) < 1e-6
    assert basis is not None and floor > 0


def test_products_add_up(spark):
    """Sums of products over any partitioning equal those of all rows at once."""
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (500, 6))
    x[rng.random(x.shape) < 0.1] = np.nan
    df = spark.createDataFrame([("a" if i % 3 else "b", [None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)], "key string, v array<double>")
    for parts in (1, 7):
        found = {(r["key"], r["a"], r["b"]): r["total"] for r in G.products(df.repartition(parts), "key", "v").collect()}
        for key, rows in (("a", x[np.arange(500) % 3 > 0]), ("b", x[np.arange(500) % 3 == 0])):
            z = np.nan_to_num(rows)
            assert np.allclose([[found[key, i, j] for j in range(6)] for i in range(6)], z.T @ z)
            assert np.allclose([found[key, i, -1] for i in range(6)], z.sum(0)) and [found[key, i, -2] for i in range(6)] == np.isfinite(rows).sum(0).tolist()
    assert G.products(df.limit(0), "key", "v").collect() == []


def test_odd_frames(spark):
    """Null states and samples, one state only, an empty table."""
    rows = [("one", i, 1, [1.0, 2.0, float(i)]) for i in range(30)] + [("null", i, None if i % 2 else 3, None if i % 3 else [1.0, None, 2.0]) for i in range(40)]
    df = spark.createDataFrame(rows, "key string, at bigint, gain int, level array<double>")
    done = G.without_gain(numbered(df, "key", ["at"], F.lit(0)), "key", "gain", "level")
    got = {(r["key"], r["at"]): r["corrected"] for r in done.collect()}
    assert got == {(k, i): v for k, i, _, v in rows}
    assert G.without_gain(numbered(df.limit(0), "key", ["at"], F.lit(0)), "key", "gain", "level").collect() == []


def test_near_medians_are_taken_at_once(monkeypatch):
    """Windows of a block against a loop, in pieces of any size and without a median call for each frame."""
    rng = np.random.default_rng(5)
    rows = rng.normal(0, 1, (300, 4))
    rows[rng.random(rows.shape) < 0.2] = np.nan
    at = np.sort(rng.choice(900, 300, replace=False))
    places, asked = np.flatnonzero(rng.random(300) < 0.6), np.arange(40, 260)
    want = []
    for k in asked:
        other = [j for j in places if abs(at[j] - at[k]) <= 30 and j != k]
        want.append(shapes_median(rows[other]) if len(other) >= 8 else np.full(4, np.nan))
    monkeypatch.setattr(G.np, "nanmedian", None)
    monkeypatch.setattr(G.np, "median", None)
    for cells in (1, 700, 1 << 19):
        monkeypatch.setattr(G, "CELLS", cells)
        enough, got = G._near_medians(rows, places, at, asked, 30, 8)
        assert np.array_equal(got, np.array(want), equal_nan=True) and 0 < enough.sum() < len(asked)


def shapes_median(rows):
    ordered = [sorted(v for v in column if v == v) for column in rows.T]
    return [(c[(len(c) - 1) // 2] + c[len(c) // 2]) / 2 if c else np.nan for c in ordered]


def test_a_frame_is_ordered_once(spark):
    """Coefficients along many directions bind the frame's median: it is not sorted for each sample and direction."""
    df = spark.createDataFrame([([3.0, None, 1.0, float("nan"), 10.0], [[1.0, 1.0, 1.0, 1.0, 1.0], [0.0, 0.0, 0.0, 0.0, 2.0]]), ([None, None], [[1.0, 1.0]])], "level array<double>, basis array<array<double>>")
    done = df.select(G.along("level").alias("y"))
    assert [r.y for r in done.collect()] == [[5.0, 14.0], [0.0]]
    assert done._jdf.queryExecution().analyzed().toString().count("array_sort(") == 1
