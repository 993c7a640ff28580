"""Every registered query with SQL gives DuckDB's rows."""

import duckdb
import pytest

from wavemill.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def norm(rows):
    cell = lambda x: None if x is None or x != x else round(float(x), 5) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)
    return sorted((tuple(map(cell, r)) for r in rows), key=lambda r: [str(x) for x in r])


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows(spark, sf, duck, name):
    df = catalog.queries()[name](spark, sf)
    names = sorted(df.columns)
    got = norm(tuple(r[c] for c in names) for r in df.collect())
    found = duck.execute(catalog.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == names
    order = [columns.index(c) for c in names]
    assert got == norm(tuple(r[i] for i in order) for r in found.fetchall())


def test_alarms_against_a_loop(spark, sf):
    from wavemill.plans.time_queries import DAY, events

    rows = events(spark, sf).where("value > 250").select("user_id", "t").orderBy("user_id", "t").collect()
    want, last = [], {}
    for r in rows:
        if r.user_id not in last or r.t - last[r.user_id] >= 2 * DAY:
            want.append((r.user_id, r.t))
            last[r.user_id] = r.t
    assert sorted((r.user_id, r["at"]) for r in catalog.queries()["refractory_alarms"](spark, sf).collect()) == want


def test_alarms_without_a_pause(spark, monkeypatch):
    """A key that never pauses: no row or window may hold more of it than a block."""
    from pyspark.sql import functions as F

    from wavemill.operators import joins

    monkeypatch.setattr(joins.F, "collect_list", None)
    df = spark.range(3000).select(F.lit("a").alias("k"), (F.col("id") * 7 + F.col("id") % 5).cast("double").alias("t"), "id")
    df = df.union(df.where("id % 50 = 0").selectExpr("'b'", "t * 3 + 0.5", "id")).union(df.where("id = 3").selectExpr("'c'", "t", "id"))
    df = df.union(df.where("id % 9 = 0"))
    want, last = [], {}
    for k, t in sorted((r.k, r.t) for r in df.collect()):
        if k not in last or t - last[k] >= 100:
            want.append((k, t))
            last[k] = t
    for block in (64.0, 250.0):
        assert sorted((r.k, r["at"]) for r in joins.alarms(df, "k", "t", "id", 100.0, block).collect()) == want
    assert joins.alarms(df.limit(0), "k", "t", "id", 100.0, 64.0).collect() == []


def test_trailing_floor_in_blocks(spark):
    """One user, ties and block edges; no row may gather more than the wanted rows."""
    from wavemill.plans import time_queries

    df = spark.range(1500).selectExpr("id AS event_id", "id % 3 div 2 AS user_id", "CAST(id * id % 7919 div 3 AS bigint) AS us", "CAST(id * 37 % 1009 AS double) AS value")
    rows = [tuple(r) for r in df.collect()]
    for reach, most in ((100, 5), (40, 20)):
        want = {}
        for e, u, t, _ in rows:
            seen = sorted(((x[2], x[0], x[3]) for x in rows if x[1] == u and t - reach <= x[2] < t), reverse=True)[:most]
            want[e] = min(x[2] for x in seen) if len(seen) >= 3 else None
        got = time_queries.trailing_least(df, reach, most, 3).collect()
        assert len(got) == len(rows) and {r.event_id: r.floor for r in got} == want


def test_impulse_response_of_whole_units(spark, tmp_path):
    """A last stretch of fewer vectors than a unit has no rows, as in the SQL."""
    spark.range(53).selectExpr("id AS vec_id", "0 AS label", "transform(sequence(1, 64), k -> CAST(sin(k * id + k) AS float)) AS embedding").write.parquet(f"{tmp_path}/embeddings.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    got = norm((r.vec_id, r.tap, r.level, r.below_peak_db) for r in catalog.queries()["impulse_response"](spark, str(tmp_path)).collect())
    assert got == norm(c.execute(catalog.oracle_sql()["impulse_response"]).fetchall()) and len(got) == 50 * 17
