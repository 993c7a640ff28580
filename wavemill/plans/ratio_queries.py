"""Orientation of chain ratios on frames derived from ``events``: a link is a user, a third of them share one link.

Every frame has a ratio whose shape over 16 subcarriers belongs to its link and whose level moves with the event's
value. Days are exchanged, turned by half, or both, by a rule on link and day, and so are single frames; the operator
sees only the damaged frames and has to find out which.
"""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import breathing, gains, orientation, pools
from ..operators.joins import kept
from .catalog import query
from .time_queries import BLOCK, events

SC = 16
_DAMAGED = """WITH e AS (SELECT event_id, CASE WHEN user_id % 3 = 0 THEN 0 ELSE user_id END AS link, value, floor(epoch_us(ts) / 86400000000.0)::BIGINT AS day FROM events),
d AS (SELECT *, (link * 31 + day * 17) % 10 AS k FROM e)"""


def damaged(spark, root):
    """link, event_id, t, phase, level (dB) of frames, and swap and rot, the damage done to them."""
    e = events(spark, root).select("event_id", F.when(F.col("user_id") % 3 == 0, 0).otherwise(F.col("user_id")).cast("bigint").alias("link"), "t", "value")
    k = (F.col("link") * 31 + F.floor(F.col("t") / 86400) * 17) % 10
    single = F.col("event_id") % 37 == 0
    e = e.withColumns({"swap": k.isin(0, 2) != single, "rot": k.isin(1, 2) != (F.col("event_id") % 41 == 0)})
    at = F.sequence(F.lit(0), F.lit(SC - 1))
    level = F.transform(at, lambda s: 6 * F.sin(0.9 * s + F.col("link")) + F.col("value") / 500 * F.cos(0.3 * s))
    phase = F.transform(at, lambda s: 0.4 + 0.8 * F.sin(0.5 * s + F.col("link")) + F.col("value") / 2500 * F.sin(0.2 * s))
    broken = F.transform(phase, lambda p: F.when(F.col("swap"), -p).otherwise(p) + F.when(F.col("rot"), math.pi).otherwise(0.0))
    wrapped = F.transform(broken, lambda p: F.atan2(F.sin(p), F.cos(p)))
    return e.select("link", "event_id", "t", "swap", "rot", wrapped.alias("phase"), F.transform(level, lambda x: F.when(F.col("swap"), -x).otherwise(x)).alias("level"))


def in_order(frames):
    return kept(orientation.numbered(frames, "link", ["t", "event_id"], F.floor(F.col("t") / BLOCK)))


@query(_DAMAGED + """ SELECT link, event_id, (k IN (0, 2)) <> (event_id % 37 = 0) AS swapped, (k IN (1, 2)) <> (event_id % 41 = 0) AS rotated FROM d""")
def ratio_states(spark, root):
    """Which frames are exchanged and turned, against a reference of each link; the SQL knows the damage."""
    rows = in_order(damaged(spark, root))
    references = kept(orientation.reference(rows, "link", "phase", "level"))
    return orientation.numbered_states(rows, "link", "phase", "level", references).select("link", "event_id", "swapped", "rotated")


@query(_DAMAGED + f""", s AS (SELECT *, unnest(range({SC})) AS sc FROM d)
SELECT link, event_id, round(sum(0.4 + 0.8 * sin(0.5 * sc + link) + value / 2500 * sin(0.2 * sc)), 5) AS phase,
  round(max(6 * sin(0.9 * sc + link) + value / 500 * cos(0.3 * sc)), 5) AS level FROM s GROUP BY 1, 2""")
def ratio_corrected(spark, root):
    """Sum of the corrected phases and highest corrected level of each frame, where no reference is known."""
    done = orientation.numbered_states(in_order(damaged(spark, root)), "link", "phase", "level").select("link", "event_id", orientation.corrected_phase("phase").alias("p"), orientation.corrected_amplitude("level").alias("l"))
    return done.select("link", "event_id", F.round(F.aggregate("p", F.lit(0.0), lambda a, x: a + x), 5).alias("phase"), F.round(F.array_max("l"), 5).alias("level"))


# Gain states --------------------------------------------------------------------------------------------------------

_STATED = f"""WITH e AS (SELECT event_id, CASE WHEN user_id % 3 = 0 THEN 0 ELSE 1 + user_id % 4 END AS link FROM events),
g AS (SELECT *, CASE WHEN event_id % 5 = 0 THEN 1 WHEN event_id % 7 = 0 THEN 2 ELSE 0 END AS gain, 1 + event_id % 3 AS much FROM e),
c AS (SELECT *, unnest(range({SC})) AS sc FROM g),
p AS (SELECT *, 4 * sin(0.9 * sc + link) AS clean, much * CASE gain WHEN 1 THEN sign(7.5 - sc) * (1 + sc % 8 % 3) WHEN 2 THEN (CASE WHEN sc % 2 = 0 THEN 1 ELSE -1 END) * (1 + sc // 2 % 2) ELSE 0 END AS bent FROM c)"""


def stated(spark, root):
    """link, event_id, i, n, gain, level: frames of one shape a link, bent along one direction by each of two gain states."""
    link = F.when(F.col("user_id") % 3 == 0, 0).otherwise(1 + F.col("user_id") % 4).cast("bigint")
    e = events(spark, root).select("event_id", link.alias("link"), "t")
    e = e.withColumns({"gain": F.when(F.col("event_id") % 5 == 0, 1).when(F.col("event_id") % 7 == 0, 2).otherwise(0), "much": 1 + F.col("event_id") % 3})
    first = lambda s: F.signum(7.5 - s) * (1 + s % 8 % 3)
    second = lambda s: F.when(s % 2 == 0, 1).otherwise(-1) * (1 + F.floor(s / 2) % 2)
    bent = lambda s: F.col("much") * F.when(F.col("gain") == 1, first(s)).when(F.col("gain") == 2, second(s)).otherwise(0)
    level = F.transform(F.sequence(F.lit(0), F.lit(SC - 1)), lambda s: 4 * F.sin(0.9 * s + F.col("link")) + bent(s))
    return orientation.numbered(e.select("link", "event_id", "t", "gain", level.alias("level")), "link", ["t", "event_id"], F.floor(F.col("t") / BLOCK))


@query(_STATED + " SELECT link, event_id, sc::INTEGER AS sc, round(clean, 5) AS level FROM p")
def gain_removed(spark, root):
    """Decibels without the shapes of gain states; the SQL knows what they were before."""
    done = gains.without_gain(stated(spark, root), "link", "gain", "level")
    return done.select("link", "event_id", F.posexplode("corrected").alias("sc", "level")).withColumn("level", F.round("level", 5))


@query(_STATED + """, d AS (SELECT link, gain, sc, bent - median(clean + bent) OVER w + median(clean) OVER w AS delta FROM p WINDOW w AS (PARTITION BY event_id)),
o AS (SELECT link, gain, sc, median(delta) AS o, count(*) AS n FROM d WHERE gain > 0 GROUP BY 1, 2, 3)
SELECT link, gain::INTEGER AS gain, sc::INTEGER AS sc, round(o - median(o) OVER (PARTITION BY link, gain), 5) AS excess FROM o WHERE n >= 20""")
def gain_offsets(spark, root):
    """What each gain state that is frequent enough does to the shape, as the median over its frames."""
    rows = gains.with_main_state(stated(spark, root), "link", "gain")
    deltas = kept(gains.differences(rows, "link", "gain", "level").withColumn("gain", F.col("gain").cast("int")))
    return gains.offsets(deltas, "link", "gain").select("link", "gain", F.posexplode("offset").alias("sc", "excess")).withColumn("excess", F.round("excess", 5))


@query(_STATED + " SELECT link, event_id, round(sqrt(sum(bent * bent)), 5) AS length FROM p WHERE gain > 0 GROUP BY 1, 2")
def gain_strengths(spark, root):
    """How far each frame of a lesser state lies from the main shape along the directions that such frames share."""
    rows = kept(gains.with_main_state(stated(spark, root), "link", "gain"))
    bases = gains.shared_directions(kept(gains.differences(rows, "link", "gain", "level")), "link")
    based = rows.join(F.broadcast(bases), "link").select("link", "event_id", "i", "n", "gain", "main", gains.along("level").alias("y"))
    moves = gains.strengths(based, "link", "gain").where("NOT stays").join(rows.where("gain <> main").select("link", "i", "event_id"), ["link", "i"])
    return moves.select("link", "event_id", F.round(F.sqrt(F.aggregate("move", F.lit(0.0), lambda a, x: a + x * x)), 5).alias("length"))


# Reference pools and breathing -----------------------------------------------------------------------------------------

_POOL = """WITH e AS (SELECT event_id, user_id, event_type, epoch_us(ts) / 1e6 AS t, value FROM events),
p AS (SELECT event_id, sc, 3 * sin(0.9 * sc) + CASE WHEN event_id % 3 = 0 THEN 4 ELSE 0 END + value / 1000 * cos(sc) AS x FROM e, range(8) r(sc)),
n AS (SELECT a.event_id, b.event_id AS other, abs(a.t - b.t) AS away FROM e a JOIN e b ON a.user_id = b.user_id AND a.event_id <> b.event_id AND a.event_type = 'error' AND b.event_type = 'view' AND abs(a.t - b.t) <= 864000),
k AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY away, other) AS rank FROM n QUALIFY rank <= 6),
d AS (SELECT i.event_id, i.rank AS a, j.rank AS b, any_value(i.other) AS ao, any_value(j.other) AS bo, avg(abs(x.x - y.x)) AS d FROM k i JOIN k j USING (event_id) JOIN p x ON x.event_id = i.other JOIN p y ON y.event_id = j.other AND y.sc = x.sc GROUP BY 1, 2, 3),
g AS (SELECT event_id, a, count(*) AS size, list(bo ORDER BY b) AS kept FROM d WHERE d <= 2 GROUP BY 1, 2),
b AS (SELECT event_id, kept, size FROM g QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY size DESC, a) = 1),
s AS (SELECT event_id, max(a) AS n_pool, coalesce(median(d) FILTER (a < b), 0) AS spread FROM d GROUP BY 1)"""


@query(_POOL + " SELECT event_id, array_to_string(kept, ',') AS kept, n_pool::INTEGER AS n_pool, round(spread, 6) AS spread, CASE WHEN size >= 2 THEN kept[1] END AS reference FROM b JOIN s USING (event_id)")
def screened_pool(spark, root):
    """Errors against the profiles of the six views nearest in time, screened for those of one room."""
    at = F.sequence(F.lit(0), F.lit(7))
    profile = F.transform(at, lambda s: 3 * F.sin(0.9 * s) + F.when(F.col("event_id") % 3 == 0, 4).otherwise(0) + F.col("value") / 1000 * F.cos(s))
    e = events(spark, root).select("event_id", "user_id", "event_type", "t", profile.alias("profile"))
    found = pools.screen_pools(e.where("event_type = 'error'"), e.where("event_type = 'view'"), "user_id", "t", "event_id", "profile", 10 * 86400.0, 6, 2.0)
    return found.select("event_id", F.array_join(F.transform("kept", lambda x: x.cast("string")), ",").alias("kept"), "n_pool", F.round("spread", 6).alias("spread"), "reference")


CHEST = breathing.Breathing(rate=5.0)
_CHEST = """WITH e AS (SELECT event_id, event_type, CASE WHEN user_id % 3 = 0 THEN 0 ELSE 1 + user_id % 4 END AS link, epoch_us(ts) / 1e6 AS t FROM events),
g AS (SELECT *, row_number() OVER (PARTITION BY link ORDER BY t, event_id) - 1 AS i, count(*) OVER (PARTITION BY link) AS n FROM e),
w AS (SELECT link, i AS start, n, avg((event_type IN ('error', 'click'))::INT) OVER (PARTITION BY link ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING) AS made FROM g)"""


def chest(spark, root):
    """link, i, n, re, im, fabricated: a uniform grid a link, in which a chest moves with a period that is the link's own."""
    link = F.when(F.col("user_id") % 3 == 0, 0).otherwise(1 + F.col("user_id") % 4).cast("bigint")
    e = events(spark, root).select("event_id", "event_type", link.alias("link"), "t")
    g = orientation.numbered(e, "link", ["t", "event_id"], F.floor(F.col("t") / BLOCK))
    period = F.get(F.array(*map(F.lit, (12, 16, 20, 18, 14))), F.col("link").cast("int"))
    at = F.sequence(F.lit(0), F.lit(7))
    move = 0.05 * F.sin(2 * math.pi * F.col("i") / period)
    plane = lambda f: F.transform(at, lambda s: f(0.7 * s) + move * f(1.1 * s + 0.3))
    return g.select("link", "i", "n", plane(F.cos).alias("re"), plane(F.sin).alias("im"), F.col("event_type").isin("error", "click").alias("fabricated"))


@query(_CHEST + """ SELECT link, start, made > 0.5 AS unknown, made <= 0.5 AS still, CASE WHEN made <= 0.5 THEN [12, 16, 20, 18, 14][link + 1] END::BIGINT AS period
FROM w WHERE start % 5 = 0 AND start + 50 <= n""")
def breathing_windows(spark, root):
    """The period (samples) that each window of ten seconds shows, where enough of its frames are real; the SQL knows the chest's."""
    w = breathing.windows(chest(spark, root), "link", CHEST)
    known = ~F.col("unknown")
    return w.select("link", "start", "unknown", (F.col("still") & known).alias("still"), F.when(known, F.round(60 * CHEST.rate / F.col("rpm")).cast("bigint")).alias("period"))


@query(_CHEST + """, o AS (SELECT g.link, g.i, min(start) AS start, bool_or(made <= 0.5) AS present FROM g JOIN w ON w.link = g.link AND start % 5 = 0 AND start + 50 <= w.n AND
    g.i >= CASE WHEN start = 0 THEN 0 ELSE start + 22 END AND g.i < CASE WHEN start + 55 > w.n THEN least(w.n, start + 50) ELSE start + 27 END GROUP BY 1, 2)
SELECT o.link, o.i, event_type NOT IN ('error', 'click') AS shown FROM o JOIN g ON g.link = o.link AND g.i = o.i WHERE present""")
def breathing_pattern(spark, root):
    """Which frames of the one pattern a link have a value: those of windows with enough real frames, where they are real themselves."""
    line = breathing.stitched(breathing.windows(chest(spark, root), "link", CHEST), "link")
    return line.select("link", "i", F.col("value").isNotNull().alias("shown"))
