"""Truth tables, training shares, lattices, decoding helpers and gain profiles bound to the driver's tables."""

from __future__ import annotations


from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import models
from ..operators import cells, truth
from ..operators.frames import medians
from ..session import table
from ..sources import decode
from .array_queries import _P, vectors
from .catalog import query
from .join_queries import _TEN, _UNIT, _inputs, _units
from .time_queries import _CELLS, day_levels, events

_OCCUPIED, _MACHINES = ["1-URGENT", "2-HIGH"], ["3-MEDIUM"]
_CAPTURES = """WITH c AS (SELECT o_orderkey, o_custkey % 3 AS env, o_orderkey % 100 AS span, CASE WHEN o_orderkey % 5 <> 0 THEN (o_custkey * 37 % 101) / 100.0 END AS share, CASE WHEN o_orderkey % 4 = 0 THEN o_orderpriority END AS listed FROM orders),
t AS (SELECT *, CASE WHEN share IS NULL THEN '' WHEN share >= 0.5 THEN 'occupied' ELSE 'empty' END AS seen, CASE WHEN share IS NULL THEN 'no camera sidecar' WHEN share > 0.05 AND share < 0.95 THEN 'camera partial' ELSE '' END AS why FROM c WHERE span BETWEEN 20 AND 70),
g AS (SELECT o_orderkey, env, CASE WHEN listed IN ('1-URGENT', '2-HIGH') THEN 'occupied' WHEN listed IS NOT NULL THEN 'empty' ELSE seen END AS label,
CASE WHEN listed IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN listed WHEN listed IS NOT NULL THEN 'none' WHEN seen = 'occupied' THEN 'unknown' WHEN seen = 'empty' THEN 'none' ELSE '' END AS activity,
coalesce(listed = '3-MEDIUM', false)::INT AS nonhuman, CASE WHEN listed IS NOT NULL THEN 'table' WHEN seen <> '' THEN 'camera' ELSE '' END AS origin, CASE WHEN listed IS NOT NULL THEN '' WHEN env = 2 THEN 'not in the operator table' ELSE why END AS reason FROM t),
u AS (SELECT *, (reason = '' AND label <> '')::INT AS use FROM g)"""


def _truth(spark, root):
    o = table(spark, root, "orders")
    c = o.select("o_orderkey", (F.col("o_custkey") % 3).alias("env"), (F.col("o_orderkey") % 100).alias("span"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_custkey") * 37 % 101 / 100).alias("share"), F.when(F.col("o_orderkey") % 4 == 0, F.col("o_orderpriority")).alias("listed"))
    return truth.labelled(c, _OCCUPIED, _MACHINES, (20, 70), F.col("env") != 2)


@query(_CAPTURES + " SELECT o_orderkey, env, label, activity, nonhuman, origin, use, reason FROM u")
def truth_table(spark, root):
    return _truth(spark, root).select("o_orderkey", "env", "label", "activity", "nonhuman", "origin", "use", "reason")


@query(_CAPTURES + " SELECT env, count(*) AS n, count(*) FILTER (use = 1 AND label = 'occupied') AS occupied, count(*) FILTER (use = 1 AND label = 'empty' AND nonhuman = 0) AS empty, count(*) FILTER (use = 1 AND nonhuman = 1) AS machine, count(*) FILTER (use = 0) AS unused FROM u GROUP BY 1")
def truth_summary(spark, root):
    return truth.summary(_truth(spark, root), "env")


@query("""WITH g AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), a AS (SELECT user_id, event_type, unnest(range(1, least(n, 12) + 1)) AS layer FROM g)
SELECT user_id, event_type, count(*) AS take FROM (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY layer, event_type) <= 12) GROUP BY 1, 2""")
def training_shares(spark, root):
    g = table(spark, root, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return truth.waterfill(g, "user_id", "event_type", "n", 12)


@query(_CELLS + """, st AS (SELECT user_id, col, CASE WHEN level IS NULL THEN 'unknown' WHEN level > 250 THEN 'high' ELSE 'low' END AS state FROM f),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY col) - row_number() OVER (PARTITION BY user_id, state ORDER BY col) AS g FROM st) SELECT user_id, min(col) AS "first", max(col) AS "last", state, count(*) AS n FROM r GROUP BY user_id, state, g""")
def state_runs(spark, root):
    state = F.when(F.col("level").isNull(), "unknown").when(F.col("level") > 250, "high").otherwise("low")
    return truth.state_runs(day_levels(spark, root).withColumn("state", state), "user_id", "col", "state")


@query("""WITH e AS (SELECT user_id, min(epoch_us(ts)) / 1e6 AS a, max(epoch_us(ts)) / 1e6 AS b, count(*) AS n FROM events GROUP BY 1), q AS (SELECT *, (b - a) / (n - 1) AS step FROM e WHERE b > a),
l AS (SELECT *, unnest(range(0, 41)) AS l FROM q), p AS (SELECT user_id, a, b, least(greatest(min(l) FILTER (ceil((b - a) / (0.001 * pow(2, l))) <= 800), greatest(0, ceil(log2(step / 0.001))::BIGINT)), 40) AS level FROM l GROUP BY user_id, a, b, step)
SELECT user_id, level, floor(a / (0.001 * pow(2, level)))::BIGINT AS first_column, ceil(b / (0.001 * pow(2, level)))::BIGINT AS end_column, round(256 * 0.001 * pow(2, level), 3) AS chunk_seconds FROM p""")
def lattice_levels(spark, root):
    """The finest level at which 800 columns hold each key's span, and the columns that cover it."""
    e = events(spark, root).groupBy("user_id").agg(F.min("t").alias("a"), F.max("t").alias("b"), F.count("*").alias("n")).where("b > a")
    level = cells.pick_level(F.col("b") - F.col("a"), 800, (F.col("b") - F.col("a")) / (F.col("n") - 1))
    first, end = cells.snap_window(F.col("a"), F.col("b"), F.col("level"))
    return e.withColumn("level", level).select("user_id", "level", first.alias("first_column"), end.alias("end_column"), F.round(256 * cells.lattice_dt(F.col("level")), 3).alias("chunk_seconds"))


@query("SELECT event_id, coalesce(['CCK', 'LEGACY_OFDM', 'HT', 'VHT', 'HE', 'EHT'][(event_id * 97 >> 8 & 7) + 1], 'unknown') AS format, coalesce(['20', '40', '80', '160', '320'][(event_id * 97 >> 11 & 7) + 1], 'unknown') AS width FROM events")
def rate_words(spark, root):
    fmt, width = decode.rate_words(F.col("event_id") * 97)
    return table(spark, root, "events").select("event_id", fmt.alias("format"), width.alias("width"))


@query(_P + " SELECT vec_id, i::INTEGER AS i, CASE WHEN x > 0.02 THEN round(ln(x), 6) END AS value FROM p")
def finite_values(spark, root):
    """Logarithms with everything that is no number as null."""
    odd = F.when(F.col("x") > 0.02, F.log("x")).when(F.col("x") > 0, F.lit(float("nan"))).otherwise(F.lit(float("inf")))
    p = vectors(spark, root).select("vec_id", F.posexplode("x").alias("i", "x"))
    return p.select("vec_id", "i", F.round(A.finite(odd), 6).alias("value"))


@query(_P + ", d AS (SELECT vec_id, i, 20 * log10(greatest(abs(x), 1e-6)) AS db FROM p) SELECT vec_id, i::INTEGER AS i, round(db, 5) AS db, round(tanh(db * ln(10) / 40), 6) AS unit, round(atanh(tanh(greatest(db, -60) * ln(10) / 40)) * 40 / ln(10), 3) AS back FROM d")
def decibel_units(spark, root):
    p = vectors(spark, root).select("vec_id", F.posexplode("x").alias("i", "x")).withColumn("db", A.decibels(F.abs("x")))
    return p.select("vec_id", "i", F.round("db", 5).alias("db"), F.round(A.db_to_unit(F.col("db")), 6).alias("unit"), F.round(A.unit_to_db(A.db_to_unit(F.greatest("db", F.lit(-60.0)))), 3).alias("back"))


_GAIN = _P + ", l AS (SELECT vec_id, label, i, x - median(x) OVER (PARTITION BY vec_id) AS y FROM p), g AS (SELECT label, i, median(y) AS g FROM l GROUP BY 1, 2), m AS (SELECT i, median(g) AS m FROM g GROUP BY 1)"


def _levelled(spark, root):
    mid = A.let(F.array_sort("x"), lambda s: (F.get(s, F.lit(31)) + F.get(s, F.lit(32))) / 2)
    return vectors(spark, root).select("vec_id", "label", F.posexplode(A.let(mid, lambda m: F.transform("x", lambda v: v - m))).alias("i", "y"))


def _profiles(spark, root):
    """label, i, excess: how a gain state's median shape differs from the median of all states' shapes."""
    g = medians(_levelled(spark, root), ["label", "i"], "y", "g", 0.01)
    return g.join(g.groupBy("i").agg(F.median("g").alias("m")), "i").select("label", "i", (F.col("g") - F.col("m")).alias("excess"))


@query(_GAIN + " SELECT label, g.i::INTEGER AS i, round(g - m, 6) AS excess FROM g JOIN m ON m.i = g.i")
def gain_table(spark, root):
    return _profiles(spark, root).withColumn("excess", F.round("excess", 6))


@query(_GAIN + " SELECT p.vec_id, p.i::INTEGER AS i, round(p.x - (g.g - m.m), 6) AS value FROM p JOIN g ON g.label = p.label AND g.i = p.i JOIN m ON m.i = p.i")
def gain_applied(spark, root):
    p = vectors(spark, root).select("vec_id", "label", F.posexplode("x").alias("i", "x"))
    return p.join(_profiles(spark, root), ["label", "i"]).select("vec_id", "i", F.round(F.col("x") - F.col("excess"), 6).alias("value"))


def _parts_sql() -> str:
    m, out = models.ONE_MINUTE, []
    for k, name in enumerate(m.names):
        out.append(f"SELECT l_orderkey, '{name}' AS input, {m.coef[k]!r} * (coalesce({_TEN[name]}, {m.fill[k]!r}) - {m.mean[k]!r}) / {m.scale[k]!r} AS part FROM u")
    return " UNION ALL ".join(out)


@query(f"{_UNIT}, x AS ({_parts_sql()}) SELECT l_orderkey, input, round(part, 6) AS part FROM x")
def model_contributions(spark, root):
    """What each input adds to the logit of the one-minute model."""
    u = _units(spark, root)
    parts = models.ONE_MINUTE.contributions(_inputs(_TEN))
    rows = F.array(*(F.struct(F.lit(n).alias("input"), F.round(c, 6).alias("part")) for n, c in parts.items()))
    return u.select("l_orderkey", F.explode(rows).alias("p")).select("l_orderkey", "p.*")


