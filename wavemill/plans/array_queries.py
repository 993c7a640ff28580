"""Array operators bound to ``embeddings``: a vector is a frame of 64 subcarriers, its halves two chains, its label a room."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators.frames import medians
from ..session import table
from .catalog import query

_V = "WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings)"
_P = _V + ", p AS (SELECT vec_id, label, unnest(range(64)) AS i, unnest(x) AS x FROM v)"


def vectors(spark, root):
    return table(spark, root, "embeddings").select("vec_id", "label", A.doubles(F.col("embedding")).alias("x"))


def cells(spark, root):
    return vectors(spark, root).select("vec_id", "label", F.posexplode("x").alias("i", "x"))



@query(_P + " SELECT label, i::INTEGER AS i, round(median(x), 6) AS level FROM p GROUP BY 1, 2")
def amplitude_profile(spark, root):
    return medians(cells(spark, root), ["label", "i"], "x", "level", 0.01).withColumn("level", F.round("level", 6))


@query(_P + ", m AS (SELECT label, i, median(x) AS l FROM p GROUP BY 1, 2) SELECT a.label AS one, b.label AS other, round(avg(abs(a.l - b.l)), 6) AS deviation FROM m a JOIN m b ON a.i = b.i AND a.label < b.label GROUP BY 1, 2")
def baseline_deviation(spark, root):
    m = medians(cells(spark, root), ["label", "i"], "x", "l", 0.01)
    other = m.select(F.col("label").alias("other"), "i", F.col("l").alias("k"))
    pairs = m.join(other, "i").where(F.col("label") < F.col("other"))  # 64 rows a room
    return pairs.groupBy(F.col("label").alias("one"), "other").agg(F.round(F.avg(F.abs(F.col("l") - F.col("k"))), 6).alias("deviation"))


@query(_P + ", m AS (SELECT label, i, median(abs(x)) AS s FROM p GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY s, i) AS k FROM m) SELECT label, i::INTEGER AS i FROM r WHERE k > 9")
def subcarrier_mask(spark, root):
    m = medians(cells(spark, root).withColumn("x", F.abs("x")), ["label", "i"], "x", "s", 0.01)
    k = F.row_number().over(Window.partitionBy("label").orderBy("s", "i"))
    alive = F.count("*").over(Window.partitionBy("label"))
    return m.withColumns({"k": k, "drop": F.floor(alive * 0.15)}).where("k > drop").select("label", "i")


@query(_P + ", m AS (SELECT label, i, median(abs(x)) / sqrt(2 * ln(2)) AS s FROM p GROUP BY 1, 2) SELECT vec_id, i::INTEGER AS i, round(x / s, 5) AS z FROM p JOIN m USING (label, i) WHERE s > 0")
def normalize_columns(spark, root):
    p = cells(spark, root)
    m = medians(p.withColumn("x", F.abs("x")), ["label", "i"], "x", "s", 0.01).withColumn("s", F.col("s") / math.sqrt(2 * math.log(2))).where("s > 0")
    return p.join(m, ["label", "i"]).select("vec_id", "i", F.round(F.col("x") / F.col("s"), 5).alias("z"))


@query(_P + " SELECT vec_id, round(regr_slope(x, i), 8) AS slope, round(regr_intercept(x, i), 6) AS intercept FROM p GROUP BY 1")
def detrend_line(spark, root):
    slope, intercept = A.line(F.col("x"))
    return vectors(spark, root).select("vec_id", F.round(slope, 8).alias("slope"), F.round(intercept, 6).alias("intercept"))


@query(_P + """, m AS (SELECT *, x - avg(x) OVER (PARTITION BY vec_id) AS c FROM p), l AS (SELECT *, lead(c, 1) OVER w AS c1, lead(c, 5) OVER w AS c5, lead(x) OVER w AS x1 FROM m WINDOW w AS (PARTITION BY vec_id ORDER BY i))
SELECT vec_id, round(sum(c * c1) / sum(c * c), 6) AS acf1, round(sum(c * c5) / sum(c * c), 6) AS acf5, round(1 - avg((x1 - x) * (x1 - x)) / (2 * sum(c * c) / 64), 6) AS rho FROM l GROUP BY 1""")
def acf_lags(spark, root):
    x = F.col("x")
    return vectors(spark, root).select("vec_id", F.round(A.acf(x, 1), 6).alias("acf1"), F.round(A.acf(x, 5), 6).alias("acf5"), F.round(A.lag1_noise(x), 6).alias("rho"))


_DFT = _P + ", d AS (SELECT vec_id, k, power(sum(x * cos(2 * pi() * k * i / 64)), 2) + power(sum(x * sin(2 * pi() * k * i / 64)), 2) AS power FROM p, range(0, 33) r(k) GROUP BY 1, 2)"


def _powers(spark, root):
    return vectors(spark, root).select("vec_id", F.posexplode(A.dft_powers(F.col("x"), range(33), 64)).alias("k", "power")).withColumn("k", F.col("k").cast("bigint"))


@query(_DFT + " SELECT vec_id, k, round(power, 4) AS power FROM d")
def dft_power(spark, root):
    return _powers(spark, root).withColumn("power", F.round("power", 4))


@query(_DFT + " SELECT vec_id, round(sum(CASE WHEN k BETWEEN 2 AND 4 THEN power ELSE 0 END) / sum(power), 6) AS weight, arg_max(k, power) AS peak FROM d GROUP BY 1")
def in_band_weight(spark, root):
    inside = F.sum(F.when(F.col("k").between(2, 4), F.col("power")).otherwise(0.0))
    return _powers(spark, root).groupBy("vec_id").agg(F.round(inside / F.sum("power"), 6).alias("weight"), F.max_by("k", "power").alias("peak"))


_H = _V + ", h AS (SELECT vec_id, label, unnest(range(32)) AS i, unnest(x[1:32]) AS a, unnest(x[33:64]) AS b FROM v)"


def _halves(spark, root):
    return vectors(spark, root).select("vec_id", "label", F.slice("x", 1, 32).alias("a"), F.slice("x", 33, 32).alias("b"))


@query(_H + " SELECT vec_id, round(0.5 * atan2(2 * covar_pop(a, b), var_pop(a) - var_pop(b)), 6) AS theta FROM h GROUP BY 1")
def principal_axis(spark, root):
    h = _halves(spark, root).select("vec_id", A.centred(F.col("a")).alias("a"), A.centred(F.col("b")).alias("b"))
    a, b = F.col("a"), F.col("b")
    return h.select("vec_id", F.round(0.5 * F.atan2(2 * A.dot(a, b) / 32, A.dot(a, a) / 32 - A.dot(b, b) / 32), 6).alias("theta"))


@query(_H + " SELECT vec_id, round(avg(20 * log10(greatest(sqrt(a * a + b * b), 1e-6))), 6) AS level_db, round(atan2(avg(b / greatest(sqrt(a * a + b * b), 1e-12)), avg(a / greatest(sqrt(a * a + b * b), 1e-12))), 6) AS direction FROM h GROUP BY 1")
def complex_ratio(spark, root):
    h = _halves(spark, root).withColumn("m", F.zip_with("a", "b", lambda a, b: F.sqrt(a * a + b * b)))
    unit = lambda c: A.mean(F.zip_with(c, "m", lambda v, m: v / F.greatest(m, F.lit(1e-12))))
    return h.select("vec_id", F.round(A.mean(F.transform("m", lambda m: A.decibels(m))), 6).alias("level_db"), F.round(F.atan2(unit("b"), unit("a")), 6).alias("direction"))


@query(_P + " SELECT label, i::INTEGER AS i, round(sqrt(avg(cos(3 * x)) * avg(cos(3 * x)) + avg(sin(3 * x)) * avg(sin(3 * x))), 6) AS resultant FROM p GROUP BY 1, 2")
def circular_mean(spark, root):
    c, s = F.avg(F.cos(3 * F.col("x"))), F.avg(F.sin(3 * F.col("x")))
    return cells(spark, root).groupBy("label", "i").agg(F.round(F.sqrt(c * c + s * s), 6).alias("resultant"))


@query(_P + ", d AS (SELECT *, 40 * x AS y, 40 * (x - lag(x) OVER (PARTITION BY vec_id ORDER BY i)) AS dy FROM p), u AS (SELECT vec_id, i, y - 2 * pi() * sum(coalesce(round_even(dy / (2 * pi()), 0), 0)) OVER (PARTITION BY vec_id ORDER BY i) AS y FROM d) SELECT vec_id, round(max(y) - min(y), 5) AS span, round(arg_max(y, i), 5) AS last FROM u GROUP BY 1")
def unwrap_axis(spark, root):
    u = vectors(spark, root).select("vec_id", A.unwrap(F.transform("x", lambda v: 40 * v)).alias("y"))
    return u.select("vec_id", F.round(F.array_max("y") - F.array_min("y"), 5).alias("span"), F.round(F.get("y", F.lit(63)), 5).alias("last"))


@query(_P + """, b AS (SELECT p.vec_id, p.i, p.x - avg(q.x) AS r FROM p JOIN p q ON p.vec_id = q.vec_id AND q.i BETWEEN greatest(0, least(p.i - 3, 64 - 7)) AND greatest(0, least(p.i - 3, 64 - 7)) + 6 GROUP BY p.vec_id, p.i, p.x)
SELECT vec_id, round(sum(r * r), 6) AS energy FROM b GROUP BY 1""")
def static_removal(spark, root):
    v = vectors(spark, root).withColumn("m", A.box_mean(F.col("x"), 7))
    r = F.zip_with("x", "m", lambda a, b: a - b)
    return v.select("vec_id", F.round(A.dot(r, r), 6).alias("energy"))


@query(_P + " SELECT vec_id, floor(((i + 1) * 6 - 1) / 64)::INTEGER AS g, round(sum(x * (1 + i)) / sum(1 + i), 6) AS level FROM p GROUP BY 1, 2")
def group_combine(spark, root):
    w = F.array(*(F.lit(float(i + 1)) for i in range(64)))
    return vectors(spark, root).select("vec_id", F.posexplode(A.group_means(F.col("x"), w, 64, 6)).alias("g", "level")).withColumn("level", F.round("level", 6))


@query(_P + """, r AS (SELECT label, avg(x) AS m, i FROM p GROUP BY label, i), s AS (SELECT vec_id, p.label, sum(x * m) AS c FROM p JOIN r USING (label, i) GROUP BY 1, 2) SELECT vec_id, sign(c)::INTEGER AS sign FROM s""")
def align_signs(spark, root):
    p = cells(spark, root)
    r = p.groupBy("label", "i").agg(F.avg("x").alias("m"))
    return p.join(r, ["label", "i"]).groupBy("vec_id").agg(F.sign(F.sum(F.col("x") * F.col("m"))).cast("int").alias("sign"))


@query(_V + ", d AS (SELECT a.vec_id, unnest(range(64)) AS i, unnest(a.x) AS p, unnest(b.x) AS q FROM v a JOIN v b ON b.vec_id = a.vec_id + 1) SELECT vec_id, round(median((q - p) / nullif(abs(p) + abs(q), 0)), 6) AS signed, round(median(abs(q - p) / nullif(abs(p) + abs(q), 0)), 6) AS size FROM d GROUP BY 1")
def step_fold(spark, root):
    v = vectors(spark, root)
    after = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y"))
    s = v.join(after, "vec_id").select("vec_id", F.explode(A.step_ratio(F.col("x"), F.col("y"))).alias("s"))
    return s.groupBy("vec_id").agg(F.round(F.median("s"), 6).alias("signed"), F.round(F.median(F.abs("s")), 6).alias("size"))


@query(_P + """, n AS (SELECT p.vec_id, p.i, p.x, list_sort(list(q.x)) AS s FROM p JOIN range(-3, 4) r(k) ON true JOIN p q ON q.vec_id = p.vec_id AND q.i = greatest(0, least(63, p.i + k)) GROUP BY 1, 2, 3),
m AS (SELECT *, s[4] AS mid, list_sort(list_transform(s, lambda y: abs(y - s[4])))[4] AS mad FROM n) SELECT vec_id, count(*) FILTER (abs(x - mid) > 3 * 1.4826 * mad) AS outliers FROM m GROUP BY 1""")
def mad_outliers(spark, root):
    v = vectors(spark, root).withColumn("h", A.hampel(F.col("x"), 3, 3.0))
    return v.select("vec_id", F.size(F.filter(F.zip_with("x", "h", lambda a, b: a != b), lambda f: f)).cast("bigint").alias("outliers"))


@query(_DFT + ", s AS (SELECT a.vec_id, a.k, a.power + b.power AS pair FROM d a JOIN d b ON a.vec_id = b.vec_id AND b.k = 33 - a.k AND a.k BETWEEN 1 AND 16) SELECT vec_id, arg_max(k, pair) AS k, round(max(pair), 4) AS pair FROM s GROUP BY 1")
def sideband_pairs(spark, root):
    d = _powers(spark, root).where("k > 0")
    pair = F.when(F.col("k") <= 16, F.col("k")).otherwise(33 - F.col("k"))
    s = d.groupBy("vec_id", pair.alias("k")).agg(F.sum("power").alias("pair"))
    return s.groupBy("vec_id").agg(F.max_by("k", "pair").alias("k"), F.round(F.max("pair"), 4).alias("pair"))
