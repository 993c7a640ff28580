"""Fitted models, delays of changes and conditions of captures, on rows derived from ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import drift, fitting, frames
from ..sources import listing
from .catalog import query
from .time_queries import BLOCK, DAY, events, r6

ROOMS, UNSEEN = (0, 1, 2, 3), (4,)
_NEWTON = """{name} AS (SELECT g, 0 AS k, 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2 FROM (SELECT DISTINCT g FROM {rows})
UNION ALL SELECT g, k + 1, b0 + (u0 * (h11 * h22 - h12 * h12) - h01 * (u1 * h22 - h12 * u2) + h02 * (u1 * h12 - h11 * u2)) / det,
  b1 + (h00 * (u1 * h22 - u2 * h12) - u0 * (h01 * h22 - h12 * h02) + h02 * (h01 * u2 - u1 * h02)) / det,
  b2 + (h00 * (h11 * u2 - h12 * u1) - h01 * (h01 * u2 - u1 * h02) + u0 * (h01 * h12 - h11 * h02)) / det
FROM (SELECT *, h00 * (h11 * h22 - h12 * h12) - h01 * (h01 * h22 - h12 * h02) + h02 * (h01 * h12 - h11 * h02) AS det
 FROM (SELECT g, k, b0, b1, b2, sum(w * (y - p)) AS u0, sum(w * (y - p) * x1) - b1 AS u1, sum(w * (y - p) * x2) - b2 AS u2, sum(w * p * (1 - p)) AS h00, sum(w * p * (1 - p) * x1) AS h01, sum(w * p * (1 - p) * x2) AS h02,
   sum(w * p * (1 - p) * x1 * x1) + 1 AS h11, sum(w * p * (1 - p) * x1 * x2) AS h12, sum(w * p * (1 - p) * x2 * x2) + 1 AS h22
  FROM (SELECT t.*, k, b0, b1, b2, 1 / (1 + exp(-(b0 + b1 * x1 + b2 * x2))) AS p FROM {name} JOIN {rows} t USING (g) WHERE k < 14) GROUP BY g, k, b0, b1, b2)))"""
_WINDOWS = """WITH RECURSIVE r AS (SELECT event_id, user_id, user_id % 5 AS room, CASE WHEN event_id % 11 > 0 THEN ln(1 + value) END AS a,
  sin(event_id * 0.37) + value / 200 AS b, (value * (1 + event_id % 5) > 60)::INT AS y, event_id % 13 > 0 AS known FROM events)"""


def windows(spark, root):
    """Rows of rooms with two measurements, one of them missing at times, and a label that they tell in part."""
    e = events(spark, root)
    return e.select("event_id", "user_id", (F.col("user_id") % 5).alias("room"), F.when(F.col("event_id") % 11 > 0, F.log(1 + F.col("value"))).alias("a"), (F.sin(F.col("event_id") * 0.37) + F.col("value") / 200).alias("b"), (F.col("value") * (1 + F.col("event_id") % 5) > 60).cast("int").alias("y"))


@query(_WINDOWS + """, f AS (SELECT unnest([0, 1, 2, 3, 4]) AS g), t0 AS (SELECT g, r.* FROM f JOIN r ON room < 4 AND room <> g),
m AS (SELECT g, median(a) AS ma, median(b) AS mb, avg(y) AS share FROM t0 GROUP BY 1), t1 AS (SELECT g, coalesce(a, ma) AS a, coalesce(b, mb) AS b, y, CASE WHEN y = 1 THEN 0.5 / share ELSE 0.5 / (1 - share) END AS w FROM t0 JOIN m USING (g)),
s AS (SELECT g, avg(a) AS aa, stddev_pop(a) AS sa, avg(b) AS ab, stddev_pop(b) AS sb FROM t1 GROUP BY 1), t AS (SELECT g, (a - aa) / sa AS x1, (b - ab) / sb AS x2, y, w FROM t1 JOIN s USING (g)), """ + _NEWTON.format(name="n", rows="t") + """,
p AS (SELECT event_id, room, y, 1 / (1 + exp(-(b0 + b1 * (coalesce(a, ma) - aa) / sa + b2 * (coalesce(b, mb) - ab) / sb))) AS p FROM r JOIN n ON g = room AND k = 14 JOIN m ON m.g = room JOIN s ON s.g = room)
SELECT event_id, room, y, round(p, 5) AS probability, (p > 0.5)::INT AS predicted FROM p""")
def held_out_scores(spark, root):
    """Each room's rows scored by a model that was fitted on the other rooms; one room never teaches."""
    w = fitting.held_out(windows(spark, root), "room", list(ROOMS), ["a", "b"], "y", unseen=list(UNSEEN))
    return w.select("event_id", "room", "y", F.round("probability", 5).alias("probability"), "predicted")


_REFERENCE = """, q AS (SELECT user_id, quantile_cont(a, 0.05) AS ca, quantile_cont(a, 0.25) - quantile_cont(a, 0.05) AS sa, quantile_cont(b, 0.05) AS cb, quantile_cont(b, 0.25) - quantile_cont(b, 0.05) AS sb FROM r GROUP BY 1),
e AS (SELECT user_id, count(a) AS na, median(a) AS ca, stddev_pop(a) AS sa, count(b) AS nb, median(b) AS cb, stddev_pop(b) AS sb FROM r WHERE known AND y = 0 GROUP BY 1), o AS (SELECT user_id, median(a) AS ca, stddev_pop(a) AS sa, median(b) AS cb, stddev_pop(b) AS sb FROM r GROUP BY 1),
l AS (SELECT o.user_id, CASE WHEN na >= 10 THEN e.ca ELSE o.ca END AS ca, CASE WHEN na >= 10 THEN e.sa ELSE o.sa END AS sa, CASE WHEN nb >= 10 THEN e.cb ELSE o.cb END AS cb, CASE WHEN nb >= 10 THEN e.sb ELSE o.sb END AS sb FROM o LEFT JOIN e USING (user_id)),
z AS (SELECT event_id, user_id, y, known, (a - q.ca) / greatest(q.sa, 1e-30) AS fa, (b - q.cb) / greatest(q.sb, 1e-30) AS fb, (a - l.ca) / greatest(l.sa, 1e-30) AS la, (b - l.cb) / greatest(l.sb, 1e-30) AS lb FROM r JOIN q USING (user_id) JOIN l USING (user_id))"""


def _camera(spark, root):
    """Windows of which some have no label."""
    return windows(spark, root).withColumn("y", F.when(F.col("event_id") % 13 > 0, F.col("y")))


@query(_WINDOWS + _REFERENCE + " SELECT event_id, round(fa, 4) AS free_a, round(fb, 4) AS free_b, round(la, 4) AS label_a, round(lb, 4) AS label_b FROM z WHERE user_id % 5 < 4")
def motion_design(spark, root):
    """Windows against the reference of their own capture: its low percentiles, and its empty windows."""
    w = _camera(spark, root).where("room < 4")
    free = fitting.normalised(w, "user_id", ["a", "b"]).select("event_id", F.round("z_a", 4).alias("free_a"), F.round("z_b", 4).alias("free_b"))
    label = fitting.normalised(w, "user_id", ["a", "b"], F.col("y") == 0).select("event_id", F.round("z_a", 4).alias("label_a"), F.round("z_b", 4).alias("label_b"))
    return free.join(label, "event_id")


@query(_WINDOWS + _REFERENCE + """, c AS (SELECT user_id, y, la AS x1, lb AS x2 FROM z WHERE known), t0 AS (SELECT 0 AS g, x1, x2, y FROM c WHERE x1 IS NOT NULL AND x2 IS NOT NULL),
t AS (SELECT g, x1, x2, y, CASE WHEN y = 1 THEN 0.5 / (SELECT avg(y) FROM t0) ELSE 0.5 / (1 - (SELECT avg(y) FROM t0)) END AS w FROM t0), """ + _NEWTON.format(name="n", rows="t") + """,
d AS (SELECT user_id, y, b0 + b1 * x1 + b2 * x2 AS d FROM c, n WHERE k = 14), h AS (SELECT quantile_cont(d, 0.9) AS h FROM d WHERE y = 0),
s AS (SELECT user_id, sum((y = 1 AND coalesce(d > h, false))::INT) / nullif(sum((y = 1)::INT), 0) AS recall, sum((y = 0 AND NOT coalesce(d > h, false))::INT) / nullif(sum((y = 0)::INT), 0) AS specificity FROM d, h GROUP BY 1)
SELECT user_id, round(recall, 6) AS recall, round(specificity, 6) AS specificity, round((recall + specificity) / 2, 6) AS balanced FROM s""")
def motion_fit(spark, root):
    """Weights fitted over all captures' windows, the threshold nine tenths of the empty ones stay under, and each capture's result."""
    z = fitting.kept(fitting.labelled_windows(_camera(spark, root), "user_id", ["a", "b"], "y", True))
    model, threshold = fitting.fit_normalised(z, ["a", "b"], "y")
    return r6(fitting.judged_normalised(z, "user_id", ["a", "b"], "y", model, threshold), "recall", "specificity", "balanced")


SC = 8
_EVENTS = "WITH e AS (SELECT event_id, CASE WHEN user_id % 3 = 0 THEN 0 ELSE user_id END AS link, epoch_us(ts) / 1000000.0 AS t, value FROM events)"


@query(_EVENTS + f""", o AS (SELECT *, row_number() OVER (PARTITION BY link ORDER BY t, event_id) - 1 AS i, t - lag(t) OVER (PARTITION BY link ORDER BY t, event_id) AS step FROM e),
l AS (SELECT link, greatest(round_even({DAY} / median(step), 0), 1)::BIGINT AS lag FROM o GROUP BY 1 HAVING count(step) > 0),
s AS (SELECT link, i, k, (1 + value / 100 + 0.3 * sin(event_id)) * cos(0.2 * k * (event_id * 7 % 11 - 5.5)) AS x, (1 + value / 100 + 0.3 * sin(event_id)) * sin(0.2 * k * (event_id * 7 % 11 - 5.5)) AS y FROM o, (SELECT unnest(range({SC})) AS k)),
d AS (SELECT a.link, a.i, a.k, a.x - b.x AS x, a.y - b.y AS y FROM s a JOIN l USING (link) JOIN s b ON b.link = a.link AND b.k = a.k AND b.i = a.i - lag),
c AS (SELECT *, x - avg(x) OVER (PARTITION BY link, i) AS cx, y - avg(y) OVER (PARTITION BY link, i) AS cy FROM d),
f AS (SELECT link, i, m, sum(cx * cos(2 * pi() * k * m / {4 * SC}) + cy * sin(2 * pi() * k * m / {4 * SC})) AS re, sum(cy * cos(2 * pi() * k * m / {4 * SC}) - cx * sin(2 * pi() * k * m / {4 * SC})) AS im FROM c, (SELECT unnest(range({4 * SC})) AS m) GROUP BY 1, 2, 3),
p AS (SELECT link, i, arg_max(m, re * re + im * im) AS m FROM f GROUP BY 1, 2), g AS (SELECT link, count(*) AS n, stddev_pop(CASE WHEN m > {2 * SC} THEN m - {4 * SC} ELSE m END) AS spread FROM p GROUP BY 1)
SELECT link, coalesce(n, 0) AS n, CASE WHEN n >= 4 THEN round(spread, 6) END AS spread FROM l LEFT JOIN g USING (link)""")
def change_delay(spark, root):
    """How far the strongest delay of a day's change strays, by link; a third of the frames are of one link. No frame is flat, whose change would be rounding alone."""
    e = events(spark, root).withColumn("link", F.when(F.col("user_id") % 3 == 0, 0).otherwise(F.col("user_id")).cast("bigint"))
    n = frames.numbered(e, "link", ["t", "event_id"], F.floor(F.col("t") / BLOCK))
    at, level = F.sequence(F.lit(0), F.lit(SC - 1)), 1 + F.col("value") / 100 + 0.3 * F.sin("event_id")
    turn = lambda k: 0.2 * k * (F.col("event_id") * 7 % 11 - 5.5)
    n = n.select("link", "i", "n", "t", F.transform(at, lambda k: level * F.cos(turn(k))).alias("re"), F.transform(at, lambda k: level * F.sin(turn(k))).alias("im"))
    return r6(drift.delay_spread(n, "link", "t", DAY), "spread")


@query("""WITH u AS (SELECT user_id, avg((value > 50)::INT) AS share, count(*) AS n FROM events GROUP BY 1),
c AS (SELECT *, user_id % 4 > 0 AS meta, user_id % 3 <> 1 AS camera, user_id % 5 = 0 AS listed, CASE WHEN user_id % 8 < 5 THEN 'scene ' || user_id % 2 END AS scenario,
  CASE user_id % 7 WHEN 1 THEN 'occupied' WHEN 2 THEN 'empty' END AS presence, ['still', 'rot fan + small', 'empty', 'cat'][(user_id // 5) % 4 + 1] AS cond, CASE (user_id // 5) % 3 WHEN 0 THEN '0' WHEN 1 THEN '1' END AS y FROM u),
k AS (SELECT *, CASE WHEN meta THEN scenario END AS s, CASE WHEN meta THEN presence END AS p, CASE WHEN camera THEN share END AS v, CASE WHEN meta THEN 'room ' || user_id % 6 END AS room FROM c)
SELECT user_id, room, coalesce(s, CASE WHEN v = 0 THEN 'empty' WHEN v > 0.5 THEN 'occupied' WHEN v IS NOT NULL THEN 'partial' END) AS scenario,
  CASE WHEN listed THEN CASE cond WHEN 'still' THEN 'still (breathing)' WHEN 'empty' THEN 'empty room' WHEN 'cat' THEN 'cat' ELSE 'small move + rotating fan' END ELSE s END AS recorded,
  CASE WHEN listed THEN 'GT table env' || user_id % 4 || ', session ' || user_id % 9 WHEN s IS NOT NULL THEN 'operator, at capture time' END AS recorded_source,
  CASE WHEN listed AND y IS NOT NULL THEN CASE y WHEN '1' THEN 'person' ELSE 'empty' END WHEN p IS NOT NULL THEN CASE p WHEN 'occupied' THEN 'person' ELSE 'empty' END END AS gt,
  CASE WHEN listed AND y IS NOT NULL THEN 'GT table env' || user_id % 4 WHEN p IS NOT NULL THEN 'operator' END AS gt_source, p AS presence, round(v, 6) AS camera_occupancy, CASE WHEN s IS NULL THEN round(v, 6) END AS occupancy FROM k""")
def capture_conditions(spark, root):
    """What sidecars, the camera and the operator's table say of captures, one a user; each is absent for some."""
    u = events(spark, root).groupBy("user_id").agg(F.avg((F.col("value") > 50).cast("int")).alias("share"))
    u = u.withColumns({"capture": F.concat(F.lit("day/u"), F.col("user_id")), "stem": F.concat(F.lit("u"), F.col("user_id"))})
    i = lambda k: F.col("user_id") % k
    said = F.to_json(F.struct(F.concat(F.lit("room "), i(6)).alias("room"), F.when(i(8) < 5, F.concat(F.lit("scene "), i(2))).alias("scenario"), F.when(i(7) == 1, "occupied").when(i(7) == 2, "empty").alias("presence")))
    meta = u.where(i(4) > 0).select("capture", said.alias("text"))
    camera = u.where(i(3) != 1).select("capture", F.to_json(F.struct(F.struct(F.col("share").alias("fraction_occupied")).alias("summary"))).alias("text"))
    fifth = F.floor(F.col("user_id") / 5)
    cond = F.get(F.array(*map(F.lit, ("still", "rot fan + small", "empty", "cat"))), (fifth % 4).cast("int"))
    table = u.where(i(5) == 0).select("stem", F.concat(F.lit("env"), i(4)).alias("env"), i(9).alias("session"), cond.alias("cond"), F.when(fifth % 3 == 0, "0").when(fifth % 3 == 1, "1").alias("y"))
    c = listing.conditions(u.select("user_id", "capture", "stem"), meta, camera, table)
    return r6(c, "camera_occupancy", "occupancy").select("user_id", "room", "scenario", "recorded", "recorded_source", "gt", "gt_source", "presence", "camera_occupancy", "occupancy")
