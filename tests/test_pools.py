"""Screened pools against a loop over anchors; ties, pools of one, profiles without common places."""

import itertools

import numpy as np
from pyspark.sql import functions as F

from wavemill.operators import pools as P


def dist(a, b):
    both = [abs(x - y) for x, y in zip(a, b) if x is not None and y is not None and np.isfinite(x) and np.isfinite(y)]
    return float(np.mean(both)) if both else None


def loop(pool, radius):
    best = []
    for i in range(len(pool)):
        group = [j for j in range(len(pool)) if i == j or (d := dist(pool[i], pool[j])) is not None and d <= radius]
        if len(group) > len(best):
            best = group
    pairs = [d for i, j in itertools.combinations(range(len(pool)), 2) if (d := dist(pool[i], pool[j])) is not None]
    return best, float(np.median(pairs)) if pairs else 0.0


def test_against_a_loop(spark):
    rng, cases = np.random.default_rng(3), []
    for _ in range(60):
        n = int(rng.integers(1, 8))
        pool = (rng.choice([0.0, 5.0, 9.0], n)[:, None] + rng.normal(0, 1, (n, 5))).tolist()
        cases.append([[None if rng.random() < 0.1 else x for x in p] for p in pool])
    cases += [[[1.0, None], [None, 1.0]], [[0.0], [2.0], [4.0]], [[0.0], [10.0]], [[float("nan")], [1.0], [1.0]]]
    df = spark.createDataFrame(list(enumerate(cases)), "id int, pool array<array<double>>")
    got = {r["id"]: r["s"] for r in df.select("id", P.screened(F.col("pool"), 2.0).alias("s")).collect()}
    for k, pool in enumerate(cases):
        kept, spread = loop(pool, 2.0)
        assert list(got[k]["kept"]) == kept and abs(got[k]["spread"] - spread) < 1e-12
    assert list(got[61]["kept"]) == [0, 1, 2]  # only the middle one reaches both
    assert list(got[62]["kept"]) == [0]  # an even split: the first anchor wins
    assert spark.createDataFrame([([],)], "pool array<array<double>>").select(P.screened(F.col("pool"), 2.0).alias("s")).first()["s"] is None


def test_pools_of_rows(spark):
    refs = [(10, "a", 0.0, [1.0, 1.0]), (11, "a", 5.0, [1.5, 1.0]), (12, "a", 9.0, [9.0, 9.0]), (13, "a", 100.0, [1.0, 1.0]), (14, "b", 0.0, [1.0, 1.0])]
    rows = [(1, "a", 8.0, None), (10, "a", 0.0, [1.0, 1.0]), (2, "b", 1.0, None), (3, "c", 0.0, None)]
    schema = "id bigint, key string, t double, profile array<double>"
    done = P.screen_pools(spark.createDataFrame(rows, schema), spark.createDataFrame(refs, schema), "key", "t", "id", "profile", 20.0, 4, 2.0)
    got = {r["id"]: (list(r["kept"]), r["n_pool"], r["reference"]) for r in done.collect()}
    assert got == {1: ([11, 10], 3, 11), 10: ([11], 2, None), 2: ([14], 1, None)}
