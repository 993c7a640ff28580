"""Joins in time: two-sided as-of, intervals, nearest neighbours, states and labels.

Where a condition is a range, both sides are first dealt by key and time bucket, so nothing is compared across keys or
far apart in time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .frames import following, previous, running


def resample(df: DataFrame, key: str, t: str, tie: str, value: str, step: float, gap: float, block: float) -> DataFrame:
    """key, i, value, fabricated: linear interpolation at each multiple i * step between a key's first and last row.

    Each pair of neighbours yields the grid points behind the earlier and up to the later one; a point strictly inside
    a pair further apart than ``gap`` is fabricated.
    """
    p = previous(df, key, t, tie, [t, value], block)
    t0, t1 = F.col(f"prev_{t}"), F.col(t)
    first = F.when(t0.isNull(), F.ceil(t1 / step)).otherwise(F.floor(t0 / step) + 1)
    last = F.floor(t1 / step)
    g = p.where(first <= last).select(key, t1.alias("_t1"), t0.alias("_t0"), F.col(value).alias("_v1"), F.col(f"prev_{value}").alias("_v0"), F.explode(F.sequence(first, last)).alias("i"))
    at = F.col("i") * step
    share = (at - F.col("_t0")) / (F.col("_t1") - F.col("_t0"))
    made = F.when(F.col("_t0").isNull() | (at == F.col("_t1")), F.col("_v1")).otherwise(F.col("_v0") + share * (F.col("_v1") - F.col("_v0")))
    inside = F.coalesce((F.col("_t1") - F.col("_t0") > gap) & (at < F.col("_t1")), F.lit(False))
    return g.select(key, "i", made.alias("value"), inside.alias("fabricated"))


def flips(df: DataFrame, key: str, t: str, tie: str, flag: str, block: float) -> DataFrame:
    """key, at: midpoints between neighbours of different flags."""
    p = previous(df, key, t, tie, [t, flag], block)
    return p.where(F.col(f"prev_{flag}") != F.col(flag)).select(key, ((F.col(t) + F.col(f"prev_{t}")) / 2).alias("at"))


def within(left: DataFrame, right: DataFrame, key: str, lt: str, rt: str, reach: float) -> DataFrame:
    """Pairs of one key with |left.lt - right.rt| <= reach: each right row is dealt to the buckets it can meet."""
    r = right.withColumn("_b", F.explode(F.sequence(F.floor((F.col(rt) - reach) / reach), F.floor((F.col(rt) + reach) / reach))))
    l = left.withColumn("_b", F.floor(F.col(lt) / reach))
    return l.join(r, [key, "_b"]).where(F.abs(F.col(lt) - F.col(rt)) <= reach).drop("_b")


def near_flip(frames: DataFrame, turns: DataFrame, key: str, t: str, row_id: str, margin: float) -> DataFrame:
    """Ids of the rows at most ``margin`` from a flip."""
    return within(frames.select(key, t, row_id), turns, key, t, "at", margin).select(row_id).distinct()


def cell_truth(frames: DataFrame, key: str, t: str, flag: str, width: float) -> DataFrame:
    """key, col, truth: 0 where no frame of a cell (closed at both ends) is set, 1 where more than half are, else null."""
    c = F.floor(F.col(t) / width)
    on_edge = F.col(t) == c * width  # closed cells share their edges
    cols = F.when(on_edge, F.array(c - 1, c)).otherwise(F.array(c))
    share = frames.select(key, F.explode(cols).alias("col"), flag).groupBy(key, "col").agg(F.avg(F.col(flag).cast("int")).alias("share"))
    return share.select(key, "col", F.when(F.col("share") == 0, 0).when(F.col("share") > 0.5, 1).alias("truth"))


def confusion(df: DataFrame, truth: Column, predicted: Column, *keys: str) -> DataFrame:
    """tp, fp, fn, tn, accuracy, recall, specificity and precision over rows of known truth; null on empty denominators."""
    n = lambda t, p: F.sum(((truth == t) & (predicted == p)).cast("int"))
    out = df.where(truth.isNotNull() & predicted.isNotNull()).groupBy(*keys).agg(n(1, 1).alias("tp"), n(0, 1).alias("fp"), n(1, 0).alias("fn"), n(0, 0).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return out.withColumns({"accuracy": F.try_divide(tp + tn, tp + tn + fp + fn), "recall": F.try_divide(tp, tp + fn), "specificity": F.try_divide(tn, tn + fp), "precision": F.try_divide(tp, tp + fp)})


def nearest_pool(rows: DataFrame, pool: DataFrame, key: str, t: str, row_id: str, reach: float, k: int) -> DataFrame:
    """row_id, other, away, rank: the k pool rows nearest in time, of the same key, not the row itself; ties by id.

    Pool rows are numbered in time; a row's place among them gives the k + 1 on either side of it, whatever the number
    of pool rows in reach. Of those at one time the least id is the nearest on both sides.
    """
    u = F.col(t).cast("double").alias("_u")
    events = pool.select(key, u, F.lit(0).alias("_asks"), F.col(row_id).alias("_id"), F.lit(1).alias("_one"))
    asked = rows.select(key, u, F.lit(1).alias("_asks"), F.col(row_id).alias("_id"), F.lit(0).alias("_one"))
    both = events.union(asked).withColumn("_block", F.floor(F.col("_u") / reach))
    sums = both.groupBy(key, "_block").agg(F.sum("_one").alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(key, "_block", before.alias("_before"))
    so_far = lambda *order: F.col("_before") + F.sum("_one").over(Window.partitionBy(key, "_block").orderBy("_u", "_asks", *order).rowsBetween(Window.unboundedPreceding, 0))
    # of pool rows at one time the least id has to come last behind a row's time, and first ahead of it
    placed = both.join(sums, [key, "_block"]).withColumns({"_behind": so_far(F.desc("_id")), "_ahead": so_far(F.asc("_id"))})
    side = lambda n, place: F.struct(F.lit(n).alias("side"), place.alias("place"))
    numbered = placed.where("_one = 1").select(key, F.explode(F.array(side(0, F.col("_behind")), side(1, F.col("_ahead")))).alias("_at"), F.col("_u").alias("_ou"), F.col("_id").alias("other"))
    last = F.col("_behind")  # of a row: how many pool rows are not later
    around = F.concat(F.transform(F.sequence(last - k, last), lambda p: side(0, p)), F.transform(F.sequence(last + 1, last + k + 1), lambda p: side(1, p)))
    wanted = placed.where("_one = 0").select(key, F.col("_id").alias(row_id), "_u", F.explode(around).alias("_at"))
    pairs = wanted.select(key, row_id, "_u", "_at.*").join(numbered.select(key, "_at.*", "_ou", "other"), [key, "side", "place"]).select(row_id, "other", F.abs(F.col("_u") - F.col("_ou")).alias("away"))
    pairs = pairs.where((F.col("away") <= reach) & (F.col(row_id) != F.col("other")))
    rank = F.row_number().over(Window.partitionBy(row_id).orderBy("away", "other"))  # 2 * k + 2 at most
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select(row_id, "other", "away", "rank")


def log_match(logs: DataFrame, captures: DataFrame, key: str, t: str, row_id: str, before: float, after: float) -> DataFrame:
    """row_id, capture, away: the nearest capture that starts at most ``before`` ahead of or ``after`` behind a log row.

    A capture is claimed once, by the log row nearest to it; ties by id.
    """
    c = captures.select(key, F.col(t).alias("_ct"), F.col(row_id).alias("capture"))
    pairs = within(logs.select(key, t, row_id), c, key, t, "_ct", max(before, after))
    pairs = pairs.withColumn("away", F.col("_ct") - F.col(t)).where((F.col("away") >= -before) & (F.col("away") <= after))
    best = pairs.groupBy(row_id).agg(F.min(F.struct(F.abs("away").alias("d"), F.col("capture"), F.col("away"))).alias("b")).select(row_id, "b.*")
    mine = best.groupBy("capture").agg(F.min(F.struct("d", F.col(row_id), "away")).alias("m"))
    return mine.select(F.col(f"m.{row_id}").alias(row_id), "capture", F.col("m.away").alias("away"))


def intervals(df: DataFrame, key: str, t: str, tie: str, sign: str, block: float) -> DataFrame:
    """key, start, stop: from each first '+' to the next '-'; an open one ends with the key's last event."""
    last = df.groupBy(key).agg(F.max(t).alias("_end"))
    turns = previous(df, key, t, tie, [sign], block).where(F.col(f"prev_{sign}").isNull() | (F.col(f"prev_{sign}") != F.col(sign)))
    ended = following(turns, key, t, tie, [t], block).where(F.col(sign) == "+")
    return ended.join(last, key).select(key, F.col(t).alias("start"), F.coalesce(f"next_{t}", "_end").alias("stop"))


def state_on_cells(changes: DataFrame, cells: DataFrame, key: str, t: str, tie: str, sign: str, width: float, block: int = 4096) -> DataFrame:
    """key, col, state: the sign of the last change at or before each cell's centre; absent before the first.

    Signs are carried inside blocks of ``block`` cells, and one from block to block.
    """
    centre = F.ceil(F.col(t) / width - 0.5)  # the first cell whose centre is not before the change
    at = changes.groupBy(key, centre.alias("col")).agg(F.max_by(sign, F.struct(t, tie)).alias("_s"))
    every = cells.select(key, "col").withColumn("_cell", F.lit(True)).join(at, [key, "col"], "full").withColumn("_block", F.floor(F.col("col") / block))
    last = every.groupBy(key, "_block").agg(F.max_by("_s", F.when(F.col("_s").isNotNull(), F.col("col"))).alias("_last"))
    carried = F.last("_last", True).over(Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    last = last.withColumn("_carried", carried).select(key, "_block", "_carried")
    inside = F.last("_s", True).over(Window.partitionBy(key, "_block").orderBy("col").rowsBetween(Window.unboundedPreceding, 0))
    out = every.withColumn("_own", inside).where("_cell").join(last, [key, "_block"])
    return out.select(key, "col", F.coalesce("_own", "_carried", F.lit("absent")).alias("state"))


def shared(spark: SparkSession) -> str:
    """The folder that all machines see: spark.checkpoint.dir, else one under the warehouse."""
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared")
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def kept(df: DataFrame) -> DataFrame:
    """``df`` read from files in the folder that all machines see."""
    shared(df.sparkSession)
    return df.checkpoint()


def alarms(df: DataFrame, key: str, t: str, tie: str, quiet: float, block: float) -> DataFrame:
    """key, at: rows that raise an alarm when each alarm silences the ``quiet`` seconds behind it.

    Every row's next alarm, if it were one, is found inside blocks of ``block`` seconds, with the first row of the next
    block that has rows carried back; from each key's first row the alarms then double: those found jump as far as they
    reach, and the jumps are joined with themselves. So a task holds one block of one key, and rounds grow with the
    logarithm of a key's span.
    """
    rows = df.select(key, F.col(t).cast("double").alias("at")).dropna().distinct()
    none = F.lit(None).cast("double")
    asked = rows.select(key, (F.col("at") + quiet).alias("_u"), F.col("at").alias("_from"), none.alias("_event"))
    both = rows.select(key, F.col("at").alias("_u"), none.alias("_from"), F.col("at").alias("_event")).union(asked).withColumn("_block", F.floor(F.col("_u") / block))
    behind = Window.partitionBy(key, "_block").orderBy(F.desc("_u"), F.desc_nulls_last("_event")).rowsBetween(Window.unboundedPreceding, 0)
    later = Window.partitionBy(key).orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    carried = both.groupBy(key, "_block").agg(F.min("_event").alias("_first")).select(key, "_block", F.last("_first", True).over(later).alias("_carried"))
    jumps = both.withColumn("_own", F.last("_event", True).over(behind)).where("_from IS NOT NULL").join(carried, [key, "_block"])
    jumps = kept(jumps.select(key, F.col("_from").alias("at"), F.coalesce("_own", "_carried").alias("_to")).dropna())
    ends = kept(rows.groupBy(key).agg(F.min("at").alias("at"), F.max("at").alias("_last")))
    most = ends.agg(F.max(F.floor((F.col("_last") - F.col("at")) / quiet))).first()[0] or 0
    found, reach = ends.select(key, "at"), 1
    while reach <= most:  # a key has at most ``most`` + 1 alarms
        found = kept(found.union(found.join(jumps, [key, "at"]).select(key, "_to")))
        reach *= 2
        if reach <= most:
            on = jumps.select(key, F.col("at").alias("_to"), F.col("_to").alias("_next"))
            jumps = kept(jumps.join(on, [key, "_to"]).select(key, "at", F.col("_next").alias("_to")))
    return found
