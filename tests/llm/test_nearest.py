"""Nearest neighbours against brute force: recall, distances, order, and tables that are odd or tiny."""

import numpy as np
import pytest

from wavemill.llm import nearest as N
from wavemill.llm import queries


def brute(rows, queries, k):
    """query id -> [(distance, id)] of the k nearest, over all usable rows."""
    good = lambda v: v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
    rows = [(i, np.array(v, float)) for i, v in rows if i is not None and good(v)]
    out = {}
    for q, v in queries:
        if q is None or not good(v):
            continue
        best = {}
        for i, x in rows:
            if i != q and len(x) == len(v):
                best[i] = min(best.get(i, np.inf), float(np.sqrt(((x - np.array(v, float)) ** 2).sum())))
        for i, d in out.get(q, []):
            best[i] = min(best.get(i, np.inf), d)
        out[q] = list(best.items())
    return {q: sorted((d, i) for i, d in found)[:k] for q, found in out.items() if found}


def found(df):
    out: dict = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["score"], r["vec_id"], r["rank"]))
    assert all([x[2] for x in v] == list(range(1, len(v) + 1)) for v in out.values())
    return {q: [x[:2] for x in v] for q, v in out.items()}


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")


def same(got, want):
    assert got.keys() == want.keys()
    for q in want:
        assert [i for _, i in got[q]] == [i for _, i in want[q]]
        assert np.allclose([d for d, _ in got[q]], [d for d, _ in want[q]], rtol=1e-12, atol=0)


@pytest.mark.parametrize("shape", ["sphere", "clusters", "line"])
def test_recall(spark, shape):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((3000, 24))
    if shape == "sphere":
        x /= np.linalg.norm(x, axis=1)[:, None]
    elif shape == "clusters":
        x = x * 0.01 + rng.standard_normal((20, 24))[rng.integers(0, 20, 3000)] * 100
    else:
        x = x * 1e-6 + rng.exponential(1, 3000)[:, None]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    asked = rows[::60]
    got, want = found(N.nearest(frame(spark, rows), frame(spark, asked), block_rows=700, group_rows=20)), brute(rows, asked, 10)
    hits = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
    assert hits >= 0.95 * 10 * len(want)
    exact = {(q, i): d for q, v in brute(rows, asked, 3000).items() for d, i in v}
    assert all(abs(exact[q, i] - d) <= 1e-9 * d for q, v in got.items() for d, i in v)


def test_query_recall(spark, sf):
    """The registered query: every hundredth vector of the table, held against all of them."""
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = brute(rows, [r for r in rows if r[0] % 100 == 0], 10)
    got = found(queries.queries()["op12_nearest"](spark, sf))
    assert got.keys() == want.keys()
    assert sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want) >= 0.9 * sum(map(len, want.values()))


def test_odd_rows(spark):
    """Nulls, zeros, other lengths, repeated rows, an id of two vectors, ties, fewer candidates than k: exact on small tables."""
    rows = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0]), (3, [0.0, 1.0]), (4, [0.0, 1.0]), (5, None), (6, []), (7, [0.0, 0.0]), (8, [1.0, None]), (9, [float("nan"), 1.0]), (10, [float("inf"), 1.0]), (11, [1.0, 2.0, 3.0]), (12, [1.0, 2.0, 4.0]), (None, [1.0, 0.5]), (13, [5.0, 5.0]), (13, [1.0, 0.25]), (100, [1.0, 0.0])]
    asked = [(0, [1.0, 0.0]), (11, [1.0, 2.0, 3.0]), (50, [0.0, 0.9]), (13, [5.0, 5.0]), (13, [1.0, 0.25]), (5, None), (None, [1.0, 1.0]), (60, [1.0])]
    same(found(N.nearest(frame(spark, rows), frame(spark, asked), k=3)), brute(rows, asked, 3))
    same(found(N.nearest(frame(spark, rows), frame(spark, asked), k=99, block_rows=2, group_rows=1)), brute(rows, asked, 99))


def test_copies_and_empty(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(400)] + [(1000 + i, [float(i), 1.0, 0.0]) for i in range(50)]
    same(found(N.nearest(frame(spark, rows), frame(spark, [(7, [1.0, 2.0, 3.0])]), block_rows=100)), brute(rows, [(7, [1.0, 2.0, 3.0])], 10))
    assert N.nearest(frame(spark, []), frame(spark, rows[:1])).collect() == [] == N.nearest(frame(spark, rows), frame(spark, [])).collect()
    wide = frame(spark, rows).selectExpr("vec_id", "cast(embedding as array<float>) embedding", "1 as block", "2 as score", "3 as v")
    same(found(N.nearest(wide, wide.where("vec_id = 1003"))), brute(rows, [(1003, [3.0, 1.0, 0.0])], 10))


def test_threshold():
    """Vectors at the radius collide often enough with the wanted probability."""
    rng = np.random.default_rng(1)
    need = N.collision_threshold(64, 2.72, 0.98)
    hits = (np.abs(rng.standard_normal((20_000, 64))) <= 1.36).sum(1)
    assert 0.97 < np.mean(hits >= need) and np.mean(hits >= need + 1) < 0.985
