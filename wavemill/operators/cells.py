"""Lattice cells: tiles, per-cell statistics, envelopes and scales."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import medians, quantiles


def cell(t: Column, width: float, origin: float | Column = 0.0) -> Column:
    """The half-open cell [c * width, (c + 1) * width) that a time lies in."""
    return F.floor((t - origin) / width)


#: Seconds of a column at level 0, and the coarsest level.
FINEST, COARSEST = 1e-3, 40


def lattice_dt(level: Column) -> Column:
    """Seconds covered by one column at a level."""
    return FINEST * F.pow(F.lit(2.0), level)


def pick_level(span: Column, width: int, least: Column) -> Column:
    """The finest level whose columns still fit ``width``, and whose columns are no finer than ``least`` seconds."""
    levels = F.sequence(F.lit(0).cast("bigint"), F.lit(COARSEST).cast("bigint"))
    fits = F.array_min(F.filter(levels, lambda k: F.ceil(span / lattice_dt(k)) <= width))
    floor = F.greatest(F.lit(0).cast("bigint"), F.ceil(F.log2(least / FINEST)))
    return F.least(F.greatest(F.coalesce(fits, F.lit(COARSEST).cast("bigint")), F.coalesce(floor, F.lit(0).cast("bigint"))), F.lit(COARSEST).cast("bigint"))


def snap_window(t0: Column, t1: Column, level: Column) -> tuple[Column, Column]:
    """First and end column at a level that cover a window, one at least."""
    first, end = F.floor(t0 / lattice_dt(level)), F.ceil(t1 / lattice_dt(level))
    return first, F.greatest(end, first + 1)


def max_hold(df: DataFrame, key: str, t: str, value: str, width: float) -> DataFrame:
    """key, col, peak, n: the maximum of each cell (NaN counts as larger than any number)."""
    return df.groupBy(key, cell(F.col(t), width).alias("col")).agg(F.max(value).alias("peak"), F.count("*").alias("n"))


def nearest(df: DataFrame, key: str, t: str, tie: str, value: str, width: float) -> DataFrame:
    """key, col, value of the frame nearest to the centre of each cell; ties go to the earlier one."""
    c = cell(F.col(t), width)
    away = F.abs(F.col(t) - (c + 0.5) * width)
    return df.groupBy(key, c.alias("col")).agg(F.min_by(value, F.struct(away, F.col(t), F.col(tie))).alias("value"))


def spine(cells: DataFrame, key: str, col: str = "col") -> DataFrame:
    """key, col: every cell from the first to the last of each key."""
    return cells.groupBy(key).agg(F.min(col).alias("a"), F.max(col).alias("b")).select(key, F.explode(F.sequence("a", "b")).alias(col))


def gap_fill(cells: DataFrame, key: str, col: str, value: str, limit: int) -> DataFrame:
    """Every cell of each key; empty ones are interpolated between their neighbours if the nearer one is within ``limit`` cells.

    Each known cell yields the gap behind it, so there is one window, over known cells alone.
    """
    known = cells.where(F.col(value).isNotNull()).select(key, F.col(col).alias("_c"), F.col(value).alias("_v"))
    w = Window.partitionBy(key).orderBy("_c")
    pair = known.withColumns({"_p": F.lag("_c").over(w), "_pv": F.lag("_v").over(w)})
    at = pair.select(key, "_c", "_v", "_p", "_pv", F.explode(F.sequence(F.coalesce(F.col("_p") + 1, F.col("_c")), F.col("_c"))).alias(col))
    share = (F.col(col) - F.col("_p")) / (F.col("_c") - F.col("_p"))
    near = F.least(F.col(col) - F.col("_p"), F.col("_c") - F.col(col)) <= limit
    made = F.when(F.col(col) == F.col("_c"), F.col("_v")).when(near, F.col("_pv") + share * (F.col("_v") - F.col("_pv")))
    return at.select(key, col, made.alias("value"), (F.col(col) != F.col("_c")).alias("filled"))


def per_cell_median(df: DataFrame, key: str, t: str, value: str, width: float) -> DataFrame:
    """key, col, level, n: the median of each cell from the key's first to its last; NaN is missing, an empty cell null."""
    v = F.when(~F.isnan(value), F.col(value))
    found = df.groupBy(key, cell(F.col(t), width).alias("col")).agg(F.median(v).alias("level"), F.count(v).alias("n"))
    return spine(found, key).join(found, [key, "col"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def floor_level(cells: DataFrame, key: str, level: str = "level", percentile: float = 0.2) -> DataFrame:
    """key, floor: a low percentile of the known levels."""
    return cells.groupBy(key).agg(F.percentile(level, F.lit(percentile)).alias("floor"))


def scale_bounds(df: DataFrame, value: str, key: str, width: float = 1.0) -> DataFrame:
    """Least, greatest, first and ninety-ninth percentile of the finite values."""
    v = F.when(~F.isnan(value) & (F.abs(value) < float("inf")), F.col(value))
    df = df.select(key, v.alias("_x"))
    ends = df.groupBy(key).agg(F.min("_x").alias("lo"), F.max("_x").alias("hi"))
    q = quantiles(df, key, "_x", [0.01, 0.99], width)
    return ends.join(q, key, "left").select(key, "lo", "hi", F.col("q0").alias("p01"), F.col("q1").alias("p99"))


def envelope(df: DataFrame, key: str, t: str, value: str, bins: int, width: float = 1.0) -> DataFrame:
    """Median, least, greatest and count in ``bins`` equal bins between each key's first and last time; the last is closed."""
    ends = df.groupBy(key).agg(F.min(t).alias("a"), F.max(t).alias("b"))
    k = F.least(F.floor((F.col(t) - F.col("a")) * bins / (F.col("b") - F.col("a"))), F.lit(bins - 1))
    at = F.when(F.col("b") > F.col("a"), k).otherwise(F.lit(0))
    binned = df.join(ends, key).select(key, at.alias("bin"), value)
    rest = binned.groupBy(key, "bin").agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(value).alias("n"))
    return rest.join(medians(binned, [key, "bin"], value, "mid", width), [key, "bin"], "left").select(key, "bin", "mid", "lo", "hi", "n")
