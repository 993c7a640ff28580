"""Frame, cell and run operators bound to the ``events`` table: a user is a capture, a day or an hour a cell."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cells, frames, runs
from ..session import table
from .catalog import query

DAY, HOUR = 86400.0, 3600.0
BLOCK = 7 * DAY
_E = "WITH e AS (SELECT event_id, user_id, event_type, value, props, epoch_us(ts) / 1e6 AS t FROM events)"


def events(spark: SparkSession, root: str) -> DataFrame:
    e = table(spark, root, "events")
    return e.withColumn("t", frames.seconds(F.col("ts"))).drop("ts")


def r6(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query(f"{_E} SELECT user_id, floor(t / 86400)::BIGINT AS col, max(value) AS peak, count(*) AS n FROM e GROUP BY 1, 2")
def tile_max_hold(spark, root):
    return cells.max_hold(events(spark, root), "user_id", "t", "value", DAY)


@query(f"""{_E} SELECT user_id, floor(t / 86400)::BIGINT AS col,
  arg_min(value, {{'a': abs(t - (floor(t / 86400) + 0.5) * 86400), 't': t, 'i': event_id}}) AS value FROM e GROUP BY 1, 2""")
def tile_nearest(spark, root):
    return cells.nearest(events(spark, root), "user_id", "t", "event_id", "value", DAY)


_CELLS = _E + """, c AS (SELECT user_id, floor(t / 86400)::BIGINT AS col, median(value) AS v, count(value) AS n FROM e GROUP BY 1, 2),
s AS (SELECT user_id, unnest(range(min(col), max(col) + 1)) AS col FROM c GROUP BY 1),
f AS (SELECT s.user_id, s.col, c.v AS level, coalesce(c.n, 0) AS n FROM s LEFT JOIN c USING (user_id, col))"""


def day_levels(spark, root):
    return cells.per_cell_median(events(spark, root), "user_id", "t", "value", DAY)


@query(_CELLS + """, g AS (SELECT *, max(CASE WHEN level IS NOT NULL THEN col END) OVER (PARTITION BY user_id ORDER BY col ROWS UNBOUNDED PRECEDING) AS a,
  min(CASE WHEN level IS NOT NULL THEN col END) OVER (PARTITION BY user_id ORDER BY col ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM f)
SELECT g.user_id, g.col, round(coalesce(g.level, CASE WHEN least(g.col - a, b - g.col) <= 2 THEN x.level + (g.col - a)::DOUBLE / (b - a) * (y.level - x.level) END), 6) AS value, g.level IS NULL AS filled
FROM g JOIN f x ON x.user_id = g.user_id AND x.col = a JOIN f y ON y.user_id = g.user_id AND y.col = b""")
def tile_gap_fill(spark, root):
    return r6(cells.gap_fill(day_levels(spark, root), "user_id", "col", "level", 2), "value")


@query(_CELLS + " SELECT user_id, col, round(level, 6) AS level, n FROM f")
def per_cell_median(spark, root):
    return r6(day_levels(spark, root), "level")


@query(_CELLS + " SELECT user_id, round(quantile_cont(level, 0.2), 6) AS floor FROM f GROUP BY 1")
def floor_level(spark, root):
    return r6(cells.floor_level(day_levels(spark, root), "user_id"), "floor")


@query(f"{_E} SELECT event_type, min(value) AS lo, max(value) AS hi, round(quantile_cont(value, 0.01), 6) AS p01, round(quantile_cont(value, 0.99), 6) AS p99 FROM e GROUP BY 1")
def scale_bounds(spark, root):
    return r6(cells.scale_bounds(events(spark, root), "value", "event_type"), "p01", "p99")


@query(f"{_E} SELECT user_id, count(*) AS n_frames, min(t) AS t_min, max(t) AS t_max, round(max(t) - min(t), 6) AS span FROM e GROUP BY 1")
def frame_meta(spark, root):
    return r6(frames.frame_meta(events(spark, root), "user_id"), "span")


@query(f"{_E} SELECT event_type, min(event_id) AS first_seen, count(*) AS n FROM e GROUP BY 1")
def distinct_filters(spark, root):
    return frames.distinct_in_order(events(spark, root), "event_type", "event_id")


@query(f"{_E} SELECT event_id, user_id, value FROM e WHERE event_type = 'click' AND user_id = 7")
def mode_source_filter(spark, root):
    e = events(spark, root).withColumn("source", F.col("user_id").cast("string"))
    return frames.filter_frames(e, "click", "7", "event_type").select("event_id", "user_id", "value")


@query(f"""{_E}, c AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS first FROM e GROUP BY 1, 2)
SELECT user_id, arg_max(event_type, {{'n': n, 'f': -first}}) AS dominant, max(n) AS n FROM c GROUP BY 1""")
def dominant_peer(spark, root):
    return frames.dominant(events(spark, root), "user_id", "event_type", "event_id")


@query(f"""{_E}, c AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS first FROM e GROUP BY 1, 2),
d AS (SELECT user_id, arg_max(event_type, {{'n': n, 'f': -first}}) AS dominant FROM c GROUP BY 1)
SELECT event_id, user_id, event_type, value FROM e JOIN d USING (user_id) WHERE event_type = dominant""")
def uniform_selection(spark, root):
    e = events(spark, root)
    return e.join(frames.dominant(e, "user_id", "event_type", "event_id").drop("n"), "user_id").where("event_type = dominant").select("event_id", "user_id", "event_type", "value")


_DT = _E + ", d AS (SELECT *, t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS dt FROM e)"


@query(_DT + """ SELECT user_id, count(*) AS n_steps, round(1 / avg(dt), 12) AS mean_rate, round(1 / median(dt), 12) AS median_rate, round(2 * quantile_cont(dt, 0.95), 6) AS gap_limit
FROM d WHERE dt > 0 GROUP BY 1""")
def sample_rate(spark, root):
    rate = frames.sample_rate(events(spark, root), "user_id", "t", "event_id", BLOCK)
    return r6(rate.withColumns({c: F.round(c, 12) for c in ("mean_rate", "median_rate")}), "gap_limit")


@query(_DT + """, k AS (SELECT *, sum(CASE WHEN dt > 86400 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS session FROM d)
SELECT user_id, session::INTEGER AS session, min(t) AS start, max(t) AS stop, count(*) AS n FROM k GROUP BY 1, 2""")
def gap_sessions(spark, root):
    return frames.sessions(events(spark, root), "user_id", "t", "event_id", DAY, BLOCK)


@query(_E + """, x AS (SELECT event_id, user_id, event_id * 7919 % 4096 AS tick, (event_id * 1000000)::BIGINT AS us FROM e),
d AS (SELECT *, tick - lag(tick) OVER w AS dk, (us - lag(us) OVER w) / 1e6 AS ds FROM x WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT event_id, user_id, round(sum(CASE WHEN dk IS NULL THEN 0.0 WHEN ds < 40.96 THEN CASE WHEN dk > 0 THEN dk * 0.01 ELSE dk * 0.01 + 40.96 END ELSE ds END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 4) AS t FROM d""")
def clock_chain(spark, root):
    x = table(spark, root, "events").select("event_id", "user_id", (F.col("event_id") * 7919 % 4096).alias("tick"), (F.col("event_id") * 1000000).alias("us"))
    return frames.clock(x, "user_id", "event_id", "tick", "us", 0.01, 40.96, 2000).select("event_id", "user_id", F.round("t", 4).alias("t"))


_N = _E + ", m AS (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM e)"


def _numbered(spark, root):
    return frames.numbered(events(spark, root), "user_id", ["t", "event_id"], F.floor(F.col("t") / BLOCK))


@query(_N + ", p AS (SELECT DISTINCT user_id, (j * (n - 1)) // 15 AS i FROM (SELECT DISTINCT user_id, n FROM m) , range(16) r(j)) SELECT m.user_id, event_id, m.i FROM m JOIN p ON p.user_id = m.user_id AND p.i = m.i WHERE m.n > 16 UNION ALL SELECT user_id, event_id, i FROM m WHERE n <= 16")
def even_sample(spark, root):
    return frames.even_sample(_numbered(spark, root), 16).select("user_id", "event_id", "i")


@query(_N + " SELECT user_id, event_id, i FROM m WHERE i % ceil(n / 20.0)::BIGINT = 0")
def stride_sample(spark, root):
    return frames.stride_sample(_numbered(spark, root), 20).select("user_id", "event_id", "i")


@query(_E + " SELECT event_id, user_id, value FROM e WHERE t >= 1705000000 ORDER BY t DESC, event_id DESC LIMIT 50")
def snapshot_tail(spark, root):
    return frames.tail(events(spark, root), "t", "event_id", 50, 1705000000.0).select("event_id", "user_id", "value")


@query(_E + """, b AS (SELECT user_id, min(t) AS a, max(t) AS z FROM e GROUP BY 1),
k AS (SELECT e.user_id, CASE WHEN z > a THEN least(floor((t - a) * 12 / (z - a)), 11) ELSE 0 END::BIGINT AS bin, value FROM e JOIN b USING (user_id))
SELECT user_id, bin, round(median(value), 6) AS mid, min(value) AS lo, max(value) AS hi, count(value) AS n FROM k GROUP BY 1, 2""")
def decimate_envelope(spark, root):
    return r6(cells.envelope(events(spark, root), "user_id", "t", "value", 12), "mid")


_RUN = _CELLS + """, a AS (SELECT *, coalesce(level > 250, false) AS above, coalesce(level >= 300, false) AS strong, level IS NULL AS unknown FROM f),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY col) - row_number() OVER (PARTITION BY user_id, above ORDER BY col) AS g FROM a),
b AS (SELECT *, above AND count(*) OVER (PARTITION BY user_id, above, g) >= 3 AS burst FROM r),
h AS (SELECT *, max(burst::INT) OVER (PARTITION BY user_id ORDER BY col ROWS 2 PRECEDING) = 1 AS after, max(burst::INT) OVER (PARTITION BY user_id ORDER BY col ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) = 1 AS before FROM b),
q AS (SELECT *, sum(burst::INT) OVER (PARTITION BY user_id ORDER BY col) AS seen, sum(burst::INT) OVER (PARTITION BY user_id) AS total FROM h),
p AS (SELECT *, CASE WHEN NOT burst AND seen > 0 AND seen < total THEN seen END AS gap FROM q)"""


def _bursts(spark, root):
    return runs.bursts(day_levels(spark, root), "user_id", "col", "level", 250.0, 3)


@query(_RUN + " SELECT user_id, col, burst FROM b")
def bursts(spark, root):
    return _bursts(spark, root).select("user_id", "col", "burst")


@query(_RUN + " SELECT user_id, col, after FROM h")
def hold_after(spark, root):
    return _bursts(spark, root).select("user_id", "col", runs.hold("burst", "user_id", "col", after=2).alias("after"))


@query(_RUN + " SELECT user_id, col, before FROM h")
def hold_before(spark, root):
    return _bursts(spark, root).select("user_id", "col", runs.hold("burst", "user_id", "col", before=2).alias("before"))


@query(_RUN + " SELECT user_id, col, gap IS NOT NULL AND coalesce(max(strong::INT) OVER (PARTITION BY user_id, gap), 0) = 1 AS filled FROM p")
def gaps_between_bursts(spark, root):
    g = runs.between(_bursts(spark, root), "user_id", "col", "burst").withColumn("strong", F.coalesce(F.col("level") >= 300, F.lit(False)))
    return g.select("user_id", "col", runs.gaps_with(g, "user_id", "col", "burst", "strong").alias("filled"))


@query(_RUN + " SELECT user_id, col, gap IS NOT NULL AND min((after OR before)::INT) OVER (PARTITION BY user_id, gap) = 1 AS bridged FROM p")
def bridged_gaps(spark, root):
    g = _bursts(spark, root).withColumn("covered", runs.hold("burst", "user_id", "col", after=2) | runs.hold("burst", "user_id", "col", before=2))
    g = runs.between(g, "user_id", "col", "burst")
    return g.select("user_id", "col", runs.bridged(g, "user_id", "col", "covered").alias("bridged"))


@query(_RUN + """ SELECT user_id, col, sum((NOT unknown)::INT) OVER w * 2 >= count(*) OVER w AND sum(strong::INT) OVER w >= 0.4 * sum((NOT unknown)::INT) OVER w AS sparse
FROM a WINDOW w AS (PARTITION BY user_id ORDER BY col ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)""")
def sparse_evidence(spark, root):
    d = day_levels(spark, root).withColumn("unknown", F.col("level").isNull())
    return d.select("user_id", "col", runs.sparse("user_id", "col", "level", "unknown", 300.0, 3, 0.4).alias("sparse"))


@query(_CELLS + """, z AS (SELECT *, CASE WHEN level >= 150 THEN n::DOUBLE END AS rate FROM f),
k AS (SELECT *, list(rate) OVER w AS rates, quantile_cont(rate, 0.5) OVER w AS mid, count(*) OVER w AS m FROM z WINDOW w AS (PARTITION BY user_id ORDER BY col ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
o AS (SELECT *, m = 5 AND len(list_filter(rates, lambda x: x IS NOT NULL)) >= 4 AND len(list_filter(rates, lambda x: x IS NOT NULL AND abs(x - mid) <= 1.0)) >= 4 AS ok FROM k)
SELECT user_id, col, max(ok::INT) OVER (PARTITION BY user_id ORDER BY col ROWS 4 PRECEDING) = 1 AS consistent FROM o""")
def consistent_runs(spark, root):
    d = day_levels(spark, root).withColumn("rate", F.col("n").cast("double"))
    return runs.consistent(d, "user_id", "col", "level", "rate", 150.0, 5, 1.0, 0.8).select("user_id", "col", "consistent")


@query(_RUN + ", l AS (SELECT user_id, above, g, count(*) AS c FROM r GROUP BY ALL) SELECT user_id, max(CASE WHEN above THEN c ELSE 0 END) AS longest FROM l GROUP BY 1")
def longest_run(spark, root):
    return runs.longest_run(day_levels(spark, root).withColumn("above", F.coalesce(F.col("level") > 250, F.lit(False))), "user_id", "col", "above")


@query(_CELLS + """, a AS (SELECT *, coalesce(level >= 200, false) AS s FROM f), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY col) - row_number() OVER (PARTITION BY user_id, s ORDER BY col) AS g FROM a),
l AS (SELECT user_id, max(CASE WHEN s THEN c ELSE 0 END) AS longest FROM (SELECT user_id, s, g, count(*) AS c FROM r GROUP BY ALL) GROUP BY 1),
p AS (SELECT user_id, quantile_cont(level, 0.9) AS p90 FROM f GROUP BY 1)
SELECT user_id, round(p90, 6) AS p90, longest, CASE WHEN p90 > 400 THEN 'motion' WHEN longest >= 5 THEN 'breathing' ELSE 'empty' END AS verdict FROM p JOIN l USING (user_id)""")
def range_verdict(spark, root):
    return r6(runs.range_verdict(day_levels(spark, root), "user_id", "col", "level", "level", 400.0, 200.0, 5), "p90")


@query(_CELLS + """, w AS (SELECT user_id, col, list({'v': level, 's': coalesce(level >= 200, false), 'u': level IS NULL} ORDER BY col) OVER (PARTITION BY user_id ORDER BY col ROWS 9 PRECEDING) AS x, quantile_cont(level, 0.9) OVER (PARTITION BY user_id ORDER BY col ROWS 9 PRECEDING) AS p90 FROM f),
k AS (SELECT user_id, col, p90, len(list_filter(x, lambda y: NOT y.u)) AS known, coalesce(max(len(r)), 0) AS longest FROM (SELECT user_id, col, p90, x, unnest(string_split(list_aggregate(list_transform(x, lambda y: CASE WHEN y.s THEN '1' ELSE '0' END), 'string_agg', ''), '0')) AS r FROM w) GROUP BY user_id, col, p90, x)
SELECT user_id, col, CASE WHEN known * 2 < 10 THEN 'unknown' WHEN p90 > 400 THEN 'motion' WHEN longest >= 3 THEN 'breathing' ELSE 'empty' END AS state FROM k""")
def range_series(spark, root):
    d = day_levels(spark, root).withColumn("unknown", F.col("level").isNull())
    return runs.range_series(d, "user_id", "col", "level", "level", "unknown", 10, 400.0, 200.0, 3).select("user_id", "col", "state")


@query(_CELLS + """, m AS (SELECT *, abs(level - lag(level) OVER (PARTITION BY user_id ORDER BY col)) AS dev FROM f)
SELECT user_id, col, CASE WHEN n = 0 OR level IS NULL THEN 'unknown' WHEN level > 350 OR coalesce(level / 100 > 3.2, false) THEN 'moving' WHEN dev IS NULL THEN 'unknown' WHEN dev > 60 THEN 'present' ELSE 'empty' END AS state FROM m""")
def state_cascade(spark, root):
    from pyspark.sql import Window

    d = day_levels(spark, root)
    dev = F.abs(F.col("level") - F.lag("level").over(Window.partitionBy("user_id").orderBy("col")))
    return d.select("user_id", "col", runs.presence_state(F.col("level"), F.col("n") == 0, dev, F.col("level") / 100, 60.0, 350.0, 3.2).alias("state"))


@query(_RUN + """ SELECT user_id, col, CASE WHEN unknown THEN 'unknown' WHEN burst THEN 'moving' WHEN strong THEN 'breathing' WHEN gap IS NOT NULL AND min((after OR before)::INT) OVER (PARTITION BY user_id, gap) = 1 THEN 'bridged' WHEN after THEN 'held' ELSE 'empty' END AS state FROM p""")
def hybrid_cascade(spark, root):
    g = _bursts(spark, root).withColumn("after", runs.hold("burst", "user_id", "col", after=2))
    g = g.withColumn("covered", F.col("after") | runs.hold("burst", "user_id", "col", before=2))
    g = runs.between(g, "user_id", "col", "burst")
    state = runs.hybrid_state(F.col("level").isNull(), F.col("burst"), F.coalesce(F.col("level") >= 300, F.lit(False)), F.col("after"), runs.bridged(g, "user_id", "col", "covered"))
    return g.select("user_id", "col", state.alias("state"))


@query(_E + """, d AS (SELECT event_id, user_id, (value - lag(value) OVER w) / (abs(value) + abs(lag(value) OVER w)) AS step FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id))
SELECT event_id, user_id, round(step, 6) AS step FROM d WHERE step IS NOT NULL""")
def lagged_step(spark, root):
    d = frames.previous(events(spark, root), "user_id", "t", "event_id", ["value"], BLOCK)
    step = (F.col("value") - F.col("prev_value")) / (F.abs("value") + F.abs("prev_value"))
    return d.select("event_id", "user_id", F.round(step, 6).alias("step")).where("step IS NOT NULL")


@query(_E + """, j AS (SELECT event_id, user_id, t, value FROM e WHERE value > 250)
SELECT event_id, user_id, (SELECT min(v) FROM (SELECT value AS v FROM j x WHERE x.user_id = j.user_id AND x.t >= j.t - 259200 AND x.t < j.t ORDER BY x.t DESC, x.event_id DESC LIMIT 20) HAVING count(*) >= 3) AS floor FROM j""")
def trailing_floor(spark, root):
    j = events(spark, root).where("value > 250").withColumn("us", F.round(F.col("t") * 1e6).cast("bigint"))
    return trailing_least(j, 259_200_000_000, 20, 3)


def trailing_least(j, reach, most, least):
    """event_id, user_id, floor: the least value of the last ``most`` rows at most ``reach`` before, null for fewer than ``least``.

    Windows hold one block of ``reach`` of one user, and each row keeps ``most`` rows; a block's last ones are carried on.
    """
    from pyspark.sql import Window

    j = j.withColumn("_block", F.floor(F.col("us") / reach))
    seen = F.struct("us", "event_id", "value")
    tied = Window.partitionBy("user_id", "_block").orderBy("us", "event_id")
    ahead = F.reverse(F.collect_list(seen).over(tied.rowsBetween(-most, -1)))
    # rows of the same instant do not count: those before the instant are what its first row has ahead of it
    first = F.row_number().over(Window.partitionBy("user_id", "_block", "us").orderBy("event_id")) == 1
    ahead = j.withColumns({"_ahead": ahead, "_first": first}).where("_first").select("user_id", "_block", "us", "_ahead")
    back = F.row_number().over(Window.partitionBy("user_id", "_block").orderBy(F.desc("us"), F.desc("event_id")))
    last = j.withColumn("_k", back).where(F.col("_k") <= most).groupBy("user_id", "_block").agg(F.sort_array(F.collect_list(seen), False).alias("_carried"))
    last = last.withColumn("_block", F.col("_block") + 1)
    both = j.join(ahead, ["user_id", "_block", "us"]).join(last, ["user_id", "_block"], "left")
    carried = F.filter(F.coalesce("_carried", F.slice("_ahead", 1, 0)), lambda x: x["us"] >= F.col("us") - reach)
    both = both.withColumn("seen", F.slice(F.concat("_ahead", carried), 1, most))
    return both.select("event_id", "user_id", F.when(F.size("seen") >= least, F.array_min(F.transform("seen", lambda x: x["value"]))).alias("floor"))
