"""Frame streams: clocks, filters, modes, spacing, sessions and samples.

A frame table has a key (the capture or transmitter), a time ``t`` in seconds and a tie-breaking ``id``. One key may
hold a large share of all rows, so row-to-row steps are taken in two levels: inside time blocks, and from block to
block on one carried row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seconds(ts: Column) -> Column:
    """Seconds since the epoch of a zone-less timestamp, whatever the session's zone."""
    micros = (F.unix_date(F.to_date(ts)) * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60).cast("bigint") * 1_000_000 + (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("bigint")
    return micros / 1e6


def previous(df: DataFrame, key: str, t: str, tie: str, columns: list[str], block: float) -> DataFrame:
    """``df`` with prev_<column>: the values of the row before in (t, tie) order of the same key.

    Rows are windowed inside blocks of ``block`` seconds; the last row of each block is carried to the next one that
    has rows. So a task holds one block of one key, not all of a key.
    """
    df = df.withColumn("_block", F.floor(F.col(t) / block))
    order = [F.col(t), F.col(tie)]
    inside = Window.partitionBy(key, "_block").orderBy(*order)
    last = df.groupBy(key, "_block").agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_last"))
    carried = last.withColumn("_carried", F.lag("_last").over(Window.partitionBy(key).orderBy("_block"))).select(key, "_block", "_carried")
    out = df.withColumns({"_own": F.lag(F.struct(*columns)).over(inside)}).join(carried, [key, "_block"])
    picked = F.coalesce("_own", "_carried")
    return out.withColumns({f"prev_{c}": picked[c] for c in columns}).drop("_own", "_carried", "_block")


def following(df: DataFrame, key: str, t: str, tie: str, columns: list[str], block: float) -> DataFrame:
    """``df`` with next_<column>: the values of the row behind, found like those of ``previous`` and carried back."""
    df = df.withColumn("_block", F.floor(F.col(t) / block))
    order = [F.col(t), F.col(tie)]
    inside = Window.partitionBy(key, "_block").orderBy(*order)
    first = df.groupBy(key, "_block").agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("_first"))
    carried = first.withColumn("_carried", F.lead("_first").over(Window.partitionBy(key).orderBy("_block"))).select(key, "_block", "_carried")
    out = df.withColumn("_own", F.lead(F.struct(*columns)).over(inside)).join(carried, [key, "_block"])
    picked = F.coalesce("_own", "_carried")
    return out.withColumns({f"next_{c}": picked[c] for c in columns}).drop("_own", "_carried", "_block")


def running(df: DataFrame, key: str, order: list[str], value: str, name: str, block: Column) -> DataFrame:
    """``df`` with the sum of ``value`` up to each row of its key, counted block by block; blocks ascend with ``order``."""
    df = df.withColumn("_block", block)
    sums = df.groupBy(key, "_block").agg(F.sum(value).alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.withColumn("_before", before).drop("_sum")
    inside = Window.partitionBy(key, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.join(sums, [key, "_block"]).withColumn(name, F.col("_before") + F.sum(value).over(inside)).drop("_before", "_block")


def quantiles(df: DataFrame, key: str, value: str, shares: list[float], width: float | Column) -> DataFrame:
    """key, n, mean, q0, q1, ...: exact quantiles (straight lines between neighbours) of the values of each key; nulls do not count.

    Values are counted by slices of ``width`` first; only slices that hold a wanted rank are ordered, so a key with most
    of the rows costs a shuffle of counts and of those few slices. A column in place of ``width`` is the slice itself: a
    whole number that never falls as the value grows.
    """
    cut = width if isinstance(width, Column) else F.floor(F.col(value) / width)
    df = df.where(F.col(value).isNotNull()).select(key, F.col(value).alias("_v"), cut.alias("_slice"))
    counts = df.groupBy(key, "_slice").agg(F.count("*").alias("_n"), F.sum("_v").alias("_sum"))
    w = Window.partitionBy(key).orderBy("_slice")  # one row a slice
    counts = counts.withColumns({"_end": F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)), "n": F.sum("_n").over(Window.partitionBy(key)), "mean": F.sum("_sum").over(Window.partitionBy(key)) / F.sum("_n").over(Window.partitionBy(key))})
    at = [(F.col("n") - 1) * q for q in shares]
    ranks = F.array_distinct(F.flatten(F.array(*(F.array(F.floor(x), F.ceil(x)) for x in at))))
    counts = counts.withColumn("_base", F.col("_end") - F.col("_n")).withColumn("_ranks", F.filter(ranks, lambda r: (r >= F.col("_base")) & (r < F.col("_end")))).where(F.size("_ranks") > 0)
    rank = F.row_number().over(Window.partitionBy(key, "_slice").orderBy("_v")) - 1 + F.col("_base")
    found = df.join(counts.select(key, "_slice", "_base", "_ranks", "n", "mean"), [key, "_slice"]).withColumn("_rank", rank).where(F.array_contains("_ranks", F.col("_rank")))
    found = found.groupBy(key, "n", "mean").agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_at"))  # two a share at most

    def read(x):
        low, high = F.element_at("_at", F.floor(x)), F.element_at("_at", F.ceil(x))
        return low + (high - low) * (x - F.floor(x))

    return found.select(key, "n", "mean", *(read(x).alias(f"q{k}") for k, x in enumerate(at)))


def medians(df: DataFrame, keys: list[str], value: str, name: str, width: float) -> DataFrame:
    """keys, name: exact medians of groups of any size, counted by slices of ``width`` first."""
    found = quantiles(df.select(F.struct(*keys).alias("_k"), F.col(value).alias("_x")), "_k", "_x", [0.5], width)
    return found.select(*(F.col(f"_k.{k}").alias(k) for k in keys), F.col("q0").alias(name))


def filter_frames(df: DataFrame, mode: str | None = None, source: str | None = None, mode_column: str = "mode", source_column: str = "source") -> DataFrame:
    """Rows of one antenna mode and one transmitter; None, blank or ``all`` skips a filter."""
    if mode and mode.strip().lower() != "all":
        df = df.where(F.col(mode_column) == mode.strip().lower())
    if source and source.strip().lower() != "all":
        df = df.where(F.col(source_column) == source.strip().lower())
    return df


def frame_meta(df: DataFrame, *keys: str, t: str = "t") -> DataFrame:
    """Number of frames, first and last time and span of each key."""
    return df.groupBy(*keys).agg(F.count("*").alias("n_frames"), F.min(t).alias("t_min"), F.max(t).alias("t_max"), (F.max(t) - F.min(t)).alias("span"))


def distinct_in_order(df: DataFrame, column: str, order: str) -> DataFrame:
    """Distinct values of a column with when they were first seen, and their count."""
    return df.groupBy(column).agg(F.min(order).alias("first_seen"), F.count("*").alias("n"))


def dominant(df: DataFrame, key: str, column: str, order: str) -> DataFrame:
    """The most frequent value of each key; ties go to the one seen first."""
    counts = df.groupBy(key, column).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return counts.groupBy(key).agg(F.max_by(column, F.struct("n", -F.col("first"))).alias("dominant"), F.max("n").alias("n"))


def spacing(df: DataFrame, key: str, t: str, tie: str, block: float) -> DataFrame:
    """key, dt: the positive time steps of each key."""
    return previous(df, key, t, tie, [t], block).select(key, (F.col(t) - F.col(f"prev_{t}")).alias("dt")).where("dt > 0")


def sample_rate(df: DataFrame, key: str, t: str, tie: str, block: float) -> DataFrame:
    """Mean and median rate, and 2 * p95 of the step as the gap limit."""
    steps = spacing(df, key, t, tie, block)
    return quantiles(steps, key, "dt", [0.5, 0.95], block / 256).select(key, F.col("n").alias("n_steps"), (1 / F.col("mean")).alias("mean_rate"), (1 / F.col("q0")).alias("median_rate"), (2 * F.col("q1")).alias("gap_limit"))


def sessions(df: DataFrame, key: str, t: str, tie: str, limit: float | Column, block: float) -> DataFrame:
    """One row for each stretch without a step over ``limit``: key, session, start, stop, n. Sessions are counted block by block."""
    flagged = previous(df, key, t, tie, [t], block).withColumn("_new", F.coalesce((F.col(t) - F.col(f"prev_{t}") > limit).cast("int"), F.lit(0)))
    at = running(flagged, key, [t, tie], "_new", "session", F.floor(F.col(t) / block)).withColumn("session", F.col("session").cast("int"))
    return at.groupBy(key, "session").agg(F.min(t).alias("start"), F.max(t).alias("stop"), F.count("*").alias("n"))


def clock(df: DataFrame, key: str, order: str, tick: str, coarse: str, tick_seconds: float, wrap_seconds: float, block: int) -> DataFrame:
    """``df`` with t: seconds from the first frame, from a wrapping tick counter and a coarse microsecond clock.

    A step is the tick difference, corrected for a wrap where the counter does not advance, if the coarse clock moved
    less than one wrap; else it is the coarse difference.
    """
    d = previous(df, key, order, order, [tick, coarse], block)
    ticks = F.col(tick) - F.col(f"prev_{tick}")
    fine = F.when(ticks > 0, ticks * tick_seconds).otherwise(ticks * tick_seconds + wrap_seconds)
    slow = (F.col(coarse) - F.col(f"prev_{coarse}")) / 1e6
    d = d.withColumn("_step", F.when(F.col(f"prev_{tick}").isNull(), 0.0).when(slow < wrap_seconds, fine).otherwise(slow)).withColumn("_block", F.floor(F.col(order) / block))
    sums = d.groupBy(key, "_block").agg(F.sum("_step").alias("_sum"))
    before = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).drop("_sum")
    inside = Window.partitionBy(key, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return d.join(before, [key, "_block"]).withColumn("t", F.col("_before") + F.sum("_step").over(inside)).drop("_step", "_before", "_block", f"prev_{tick}", f"prev_{coarse}")


def numbered(df: DataFrame, key: str, order: list[str], block: Column) -> DataFrame:
    """``df`` with i (0-based place in its key) and n (rows of its key), counted block by block; blocks ascend with ``order``."""
    df = df.withColumn("_block", block)
    sizes = df.groupBy(key, "_block").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(key).orderBy("_block")
    sizes = sizes.withColumns({"_base": F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "n": F.sum("_n").over(Window.partitionBy(key))}).drop("_n")
    inside = F.row_number().over(Window.partitionBy(key, "_block").orderBy(*order)) - 1
    return df.withColumn("_i", inside).join(sizes, [key, "_block"]).withColumn("i", F.col("_base") + F.col("_i")).drop("_i", "_base", "_block")


def even_sample(df: DataFrame, k: int) -> DataFrame:
    """Of a numbered table, the rows at floor(j * (n - 1) / (k - 1)), j < k: evenly spread, both ends included."""
    near = F.expr(f"(i * {k - 1} + n - 2) div greatest(n - 1, 1)")  # the only j that can land on i
    hit = F.expr(f"({{j}} * (n - 1)) div {k - 1}".format(j=f"((i * {k - 1} + n - 2) div greatest(n - 1, 1))"))
    return df.where((F.col("n") <= k) | ((hit == F.col("i")) & (near < k)))


def stride_sample(df: DataFrame, most: int) -> DataFrame:
    """Of a numbered table, every ceil(n / most)-th row."""
    return df.where(F.col("i") % F.ceil(F.col("n") / most) == 0)


def tail(df: DataFrame, t: str, tie: str, most: int, since: float | None = None) -> DataFrame:
    """The last ``most`` rows from ``since`` on."""
    return (df if since is None else df.where(F.col(t) >= since)).orderBy(F.desc(t), F.desc(tie)).limit(most)
