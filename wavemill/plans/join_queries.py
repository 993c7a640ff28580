"""Join, label and model operators bound to events, orders, labels and lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import models
from ..operators import joins
from ..session import table
from .catalog import query
from .time_queries import _CELLS, _E, BLOCK, DAY, day_levels, events, r6

_SIX = 21600.0


def _metrics(df):
    return df.withColumns({c: F.round(c, 6) for c in ("accuracy", "recall", "specificity", "precision")})


@query(_E + """, b AS (SELECT user_id, ceil(min(t) / 21600)::BIGINT AS a, floor(max(t) / 21600)::BIGINT AS z FROM e GROUP BY 1),
g AS (SELECT user_id, unnest(range(a, z + 1)) AS i FROM b),
l AS (SELECT g.user_id, i, e.t AS t0, e.value AS v0 FROM g ASOF JOIN e ON g.user_id = e.user_id AND g.i * 21600.0 >= e.t),
h AS (SELECT l.*, e.t AS t1, e.value AS v1 FROM l ASOF JOIN e ON l.user_id = e.user_id AND l.i * 21600.0 <= e.t)
SELECT user_id, i, round(CASE WHEN t1 = t0 OR i * 21600.0 = t1 THEN v1 ELSE v0 + (i * 21600.0 - t0) / (t1 - t0) * (v1 - v0) END, 6) AS value, t1 - t0 > 86400 AND i * 21600.0 < t1 AS fabricated FROM h""")
def resample_uniform(spark, root):
    return r6(joins.resample(events(spark, root), "user_id", "t", "event_id", "value", _SIX, DAY, BLOCK), "value")


_TURN = _E + """, p AS (SELECT *, value > 250 AS up FROM e), d AS (SELECT *, lag(t) OVER w AS pt, lag(up) OVER w AS pu FROM p WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
x AS (SELECT user_id, (t + pt) / 2 AS "at" FROM d WHERE pu <> up)"""


def _up(spark, root):
    return events(spark, root).withColumn("up", F.col("value") > 250)


@query(_TURN + ' SELECT user_id, floor(x."at")::BIGINT AS "at" FROM x')
def transition_times(spark, root):
    return joins.flips(_up(spark, root), "user_id", "t", "event_id", "up", BLOCK).withColumn("at", F.floor("at"))


@query(_TURN + ' SELECT DISTINCT event_id FROM e JOIN x ON e.user_id = x.user_id AND abs(e.t - x."at") <= 3600')
def transition_margin(spark, root):
    e = _up(spark, root)
    return joins.near_flip(e, joins.flips(e, "user_id", "t", "event_id", "up", BLOCK), "user_id", "t", "event_id", 3600.0)


_TRUTH = _CELLS + """, k AS (SELECT user_id, unnest(CASE WHEN t = floor(t / 86400) * 86400 THEN [floor(t / 86400)::BIGINT - 1, floor(t / 86400)::BIGINT] ELSE [floor(t / 86400)::BIGINT] END) AS col, (event_type = 'view')::INT AS o FROM e),
y AS (SELECT user_id, col, CASE WHEN avg(o) = 0 THEN 0 WHEN avg(o) > 0.5 THEN 1 END AS truth FROM k GROUP BY 1, 2)"""


@query(_TRUTH + " SELECT user_id, col, truth::DOUBLE AS truth FROM y")
def cell_truth(spark, root):
    e = events(spark, root).withColumn("seen", F.col("event_type") == "view")
    return joins.cell_truth(e, "user_id", "t", "seen", DAY).withColumn("truth", F.col("truth").cast("double"))


@query(_TRUTH + """, m AS (SELECT user_id, truth, (level > 250)::INT AS p FROM y JOIN f USING (user_id, col) WHERE truth IS NOT NULL AND level IS NOT NULL),
q AS (SELECT user_id, sum((truth = 1 AND p = 1)::INT)::BIGINT AS tp, sum((truth = 0 AND p = 1)::INT)::BIGINT AS fp, sum((truth = 1 AND p = 0)::INT)::BIGINT AS fn, sum((truth = 0 AND p = 0)::INT)::BIGINT AS tn FROM m GROUP BY 1)
SELECT user_id, tp, fp, fn, tn, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, round(tp / nullif(tp + fn, 0), 6) AS recall, round(tn / nullif(tn + fp, 0), 6) AS specificity, round(tp / nullif(tp + fp, 0), 6) AS precision FROM q""")
def confusion(spark, root):
    e = events(spark, root).withColumn("seen", F.col("event_type") == "view")
    df = joins.cell_truth(e, "user_id", "t", "seen", DAY).join(day_levels(spark, root), ["user_id", "col"])
    return _metrics(joins.confusion(df, F.col("truth"), (F.col("level") > 250).cast("int"), "user_id"))


@query("""WITH o AS (SELECT o_orderkey, o_custkey, o_orderstatus, epoch_us(o_orderdate) / 1e6 AS t FROM orders),
p AS (SELECT a.o_orderkey, b.o_orderkey AS other, abs(a.t - b.t) AS away FROM o a JOIN o b ON a.o_custkey = b.o_custkey AND a.o_orderkey <> b.o_orderkey AND b.o_orderstatus = 'O' AND abs(a.t - b.t) <= 15552000),
r AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY away, other) AS rank FROM p) SELECT o_orderkey, other, round(away, 6) AS away, rank::INTEGER AS rank FROM r WHERE rank <= 3""")
def reference_pool(spark, root):
    from ..operators.frames import seconds

    o = table(spark, root, "orders")
    o = o.select("o_orderkey", "o_custkey", "o_orderstatus", seconds(F.col("o_orderdate")).alias("t"))
    return r6(joins.nearest_pool(o, o.where("o_orderstatus = 'O'"), "o_custkey", "t", "o_orderkey", 180 * DAY, 3), "away")


@query(_E + """, p AS (SELECT a.event_id, b.event_id AS capture, b.t - a.t AS away FROM e a JOIN e b ON a.user_id = b.user_id AND a.event_type = 'error' AND b.event_type = 'view' AND b.t - a.t >= -21600 AND b.t - a.t <= 57600),
b AS (SELECT event_id, min({'d': abs(away), 'c': capture, 'a': away}) AS m FROM p GROUP BY 1),
k AS (SELECT m.c AS capture, min({'d': m.d, 'e': event_id, 'a': m.a}) AS m FROM b GROUP BY 1) SELECT m.e AS event_id, capture, round(m.a, 6) AS away FROM k""")
def log_match(spark, root):
    e = events(spark, root)
    return r6(joins.log_match(e.where("event_type = 'error'"), e.where("event_type = 'view'"), "user_id", "t", "event_id", 21600.0, 57600.0), "away")


_SIGN = _E + ", s0 AS (SELECT user_id, event_id, t, CASE event_type WHEN 'signup' THEN '+' ELSE '-' END AS sign FROM e WHERE event_type IN ('signup', 'error'))"


def _signs(spark, root):
    return events(spark, root).where("event_type IN ('signup', 'error')").select("user_id", "event_id", "t", F.when(F.col("event_type") == "signup", "+").otherwise("-").alias("sign"))


@query(_SIGN + """, d AS (SELECT *, lag(sign) OVER w AS ps FROM s0 WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
k AS (SELECT *, lead(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS nt FROM d WHERE ps IS NULL OR ps <> sign), z AS (SELECT user_id, max(t) AS z FROM s0 GROUP BY 1)
SELECT user_id, t AS start, coalesce(nt, z) AS stop FROM k JOIN z USING (user_id) WHERE sign = '+'""")
def event_intervals(spark, root):
    return joins.intervals(_signs(spark, root), "user_id", "t", "event_id", "sign", BLOCK)


@query(_CELLS + """, s0 AS (SELECT user_id, event_id, t, CASE event_type WHEN 'signup' THEN '+' ELSE '-' END AS sign FROM e WHERE event_type IN ('signup', 'error'))
SELECT f.user_id, f.col, coalesce((SELECT arg_max(sign, {'t': x.t, 'i': x.event_id}) FROM s0 x WHERE x.user_id = f.user_id AND x.t <= (f.col + 0.5) * 86400), 'absent') AS state FROM f""")
def state_on_grid(spark, root):
    return joins.state_on_cells(_signs(spark, root), day_levels(spark, root), "user_id", "t", "event_id", "sign", DAY)


@query("""WITH RECURSIVE e AS (SELECT DISTINCT user_id, epoch_us(ts) / 1e6 AS t FROM events WHERE value > 250),
a AS (SELECT user_id, min(t) AS at FROM e GROUP BY 1 UNION ALL SELECT a.user_id, min(e.t) FROM a JOIN e ON e.user_id = a.user_id AND e.t >= a.at + 172800 GROUP BY a.user_id, a.at) SELECT user_id, "at" FROM a""")
def refractory_alarms(spark, root):
    return joins.alarms(events(spark, root).where("value > 250"), "user_id", "t", "event_id", 2 * DAY, BLOCK)


@query("""SELECT c_custkey, coalesce(p.k, n_nationkey % 7) AS k, CASE r_name WHEN 'ASIA' THEN 'seated' WHEN 'EUROPE' THEN 'walking' ELSE 'empty' END AS activity
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey LEFT JOIN (SELECT user_id, max(json_extract(props, '$.k')::BIGINT) AS k FROM events GROUP BY 1) p ON p.user_id = c_custkey""")
def sidecar_coalesce(spark, root):
    props = table(spark, root, "events").groupBy("user_id").agg(F.max(F.get_json_object("props", "$.k").cast("bigint")).alias("k"))
    c, n, r = (table(spark, root, x) for x in ("customer", "nation", "region"))
    words = F.create_map(F.lit("ASIA"), F.lit("seated"), F.lit("EUROPE"), F.lit("walking"))
    places = n.join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    df = c.join(places, F.col("c_nationkey") == F.col("n_nationkey")).join(props, F.col("c_custkey") == F.col("user_id"), "left")
    return df.select("c_custkey", F.coalesce("k", (F.col("n_nationkey") % 7).cast("bigint")).alias("k"), F.coalesce(F.try_element_at(words, F.col("r_name")), F.lit("empty")).alias("activity"))


_UNIT = "WITH u AS (SELECT l_orderkey, avg(l_discount) AS a, avg(l_tax) AS b, sum(l_quantity) / 50 AS c, max(CASE WHEN l_returnflag = 'R' THEN l_discount * 4 END) AS d FROM lineitem GROUP BY 1)"
_ORDER = ("A_slope3", "A_r025_2", "A_r5_2", "A_p90", "F_pkmax", "F_pkmed", "F_run", "F_rpm_sd", "C3_revisit", "C3xRun_diff")


def _units(spark, root):
    li = table(spark, root, "lineitem")
    d = F.max(F.when(F.col("l_returnflag") == "R", F.col("l_discount") * 4))
    return li.groupBy("l_orderkey").agg(F.avg("l_discount").alias("a"), F.avg("l_tax").alias("b"), (F.sum("l_quantity") / 50).alias("c"), d.alias("d"))


def _linear(m: models.Logistic, sql: dict[str, str]) -> str:
    terms = []
    for k, name in enumerate(m.names):
        x = f"coalesce({sql[name]}, {m.fill[k]})" if m.fill else f"({sql[name]})"
        terms.append(f"({m.coef[k]}::DOUBLE) * ({x} - {m.mean[k]}::DOUBLE) / {m.scale[k]}::DOUBLE")
    return f"({m.intercept} + " + " + ".join(terms) + ")"


_TEN = dict(zip(_ORDER, ("a", "b * 10", "a + b", "a * b", "c / 4", "d", "c", "NULL::DOUBLE", "a * 2", "b * d")))
_SEVEN = dict(zip(models.OCCUPIED.names, ("a * 10", "b", "a", "c", "d", "c / 2", "b * 4")))
_THREE = dict(zip(models.HUMAN.names, ("a", "d", "c * 10")))


def _inputs(sql: dict[str, str]):
    return {k: F.expr(v.replace("NULL::DOUBLE", "CAST(NULL AS DOUBLE)")) for k, v in sql.items()}


@query(f"{_UNIT} SELECT l_orderkey, round(1 / (1 + exp(-{_linear(models.ONE_MINUTE, _TEN)})), 6) AS p_present, round(1 / (1 + exp(-{_linear(models.OCCUPIED, _SEVEN)})), 6) AS p_occupied, round(1 / (1 + exp(-{_linear(models.HUMAN, _THREE)})), 6) AS p_human FROM u")
def logistic_score(spark, root):
    u = _units(spark, root)
    return u.select("l_orderkey", *(F.round(m.probability(_inputs(x)), 6).alias(n) for m, x, n in ((models.ONE_MINUTE, _TEN, "p_present"), (models.OCCUPIED, _SEVEN, "p_occupied"), (models.HUMAN, _THREE, "p_human"))))


@query(_UNIT + """, m AS (SELECT median(a) AS ma, median(d) AS md FROM u), f AS (SELECT l_orderkey, coalesce(a, ma) AS a, coalesce(d, md) AS d FROM u, m), s AS (SELECT avg(a) AS aa, stddev_pop(a) AS sa, avg(d) AS ad, stddev_pop(d) AS sd FROM f)
SELECT l_orderkey, round((a - aa) / sa, 6) AS z_a, round((d - ad) / sd, 6) AS z_d FROM f, s""")
def impute_standardise(spark, root):
    return r6(models.standardised(_units(spark, root).select("l_orderkey", "a", "d"), ["a", "d"]), "z_a", "z_d").select("l_orderkey", "z_a", "z_d")


@query(_UNIT + " SELECT l_orderkey, round(0.2 + 0.7 * tanh(0.1 + 2.0 * a - 1.0 * c) - 0.4 * tanh(-0.3 + 0.5 * a + 0.25 * c), 6) AS logit FROM u")
def mlp_forward(spark, root):
    u = _units(spark, root)
    return u.select("l_orderkey", F.round(models.mlp([F.col("a"), F.col("c")], [[2.0, 0.5], [-1.0, 0.25]], [0.1, -0.3], [0.7, -0.4], 0.2), 6).alias("logit"))


_LAB = "WITH x AS (SELECT source, quality, toxic, n_chars % 50 AS score FROM labels JOIN documents USING (doc_id))"


def _labelled(spark, root):
    return table(spark, root, "labels").join(table(spark, root, "documents").select("doc_id", "source", "n_chars"), "doc_id").select("source", "quality", "toxic", (F.col("n_chars") % 50).alias("score"))


@query(_LAB + """, p AS (SELECT a.source, sum(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END) / count(*) AS auc FROM x a JOIN x b ON a.source = b.source AND a.quality = 1 AND b.quality = 0 GROUP BY 1)
SELECT source, round(auc, 6) AS auc FROM (SELECT DISTINCT source FROM x) LEFT JOIN p USING (source)""")
def auc_by_group(spark, root):
    return r6(models.auc(_labelled(spark, root), "source", "score", "quality"), "auc")


@query(_LAB + """, c AS (SELECT source, sum((quality = 1 AND score >= 25)::INT) AS tp, sum((quality = 1)::INT) AS p, sum((quality = 0 AND score < 25)::INT) AS tn, sum((quality = 0)::INT) AS n FROM x GROUP BY 1)
SELECT source, round((tp / nullif(p, 0) + tn / nullif(n, 0)) / 2, 6) AS balanced FROM c""")
def balanced_accuracy(spark, root):
    c = joins.confusion(_labelled(spark, root), F.col("quality"), (F.col("score") >= 25).cast("int"), "source")
    return c.select("source", F.round((F.col("recall") + F.col("specificity")) / 2, 6).alias("balanced"))


@query(_LAB + ", s AS (SELECT source, sum(score) AS s, count(score) AS n FROM x GROUP BY 1) SELECT source, round(((SELECT sum(s) FROM s) - s) / nullif((SELECT sum(n) FROM s) - n, 0), 6) AS others FROM s")
def loeo_split(spark, root):
    return r6(models.leave_one_out(_labelled(spark, root), "source", "score"), "others")
