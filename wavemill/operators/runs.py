"""Runs over the cells of a key: bursts, holds, bridges, persistence and verdicts.

Tables have one row for each (key, col) with consecutive col; there are as many rows to a key as cells, not frames.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _w(key: str, col: str):
    return Window.partitionBy(key).orderBy(col)


def with_runs(df: DataFrame, key: str, col: str, flag: str) -> DataFrame:
    """``df`` with run (number of the stretch of equal flags) and run_length."""
    w = _w(key, col)
    change = F.coalesce((F.col(flag) != F.lag(flag).over(w)).cast("int"), F.lit(1))
    df = df.withColumn("_c", change).withColumn("run", F.sum("_c").over(w)).drop("_c")
    return df.withColumn("run_length", F.count("*").over(Window.partitionBy(key, "run")))


def bursts(df: DataFrame, key: str, col: str, level: str, threshold: float | Column, least: int) -> DataFrame:
    """``df`` with burst: inside at least ``least`` consecutive cells above the threshold."""
    df = with_runs(df.withColumn("_above", F.coalesce(F.col(level) > threshold, F.lit(False))), key, col, "_above")
    return df.withColumn("burst", F.col("_above") & (F.col("run_length") >= least)).drop("_above", "run", "run_length")


def hold(flag: str, key: str, col: str, after: int = 0, before: int = 0) -> Column:
    """Whether a set cell lies at most ``after`` cells back or ``before`` cells ahead."""
    return F.max(flag).over(_w(key, col).rowsBetween(-after, before))


def between(df: DataFrame, key: str, col: str, mark: str) -> DataFrame:
    """``df`` with gap: number of the stretch of unmarked cells between two marked ones, null elsewhere."""
    w = _w(key, col)
    seen = F.sum(F.col(mark).cast("int")).over(w)
    total = F.sum(F.col(mark).cast("int")).over(Window.partitionBy(key))
    return df.withColumns({"_s": seen, "_t": total}).withColumn("gap", F.when(~F.col(mark) & (F.col("_s") > 0) & (F.col("_s") < F.col("_t")), F.col("_s"))).drop("_s", "_t")


def gaps_with(df: DataFrame, key: str, col: str, mark: str, inside: str) -> Column:
    """Of a table with gap: cells of a gap that has any ``inside`` cell."""
    return F.col("gap").isNotNull() & F.coalesce(F.max(inside).over(Window.partitionBy(key, "gap")), F.lit(False))


def bridged(df: DataFrame, key: str, col: str, covered: str) -> Column:
    """Of a table with gap: cells of a gap that is covered throughout."""
    return F.col("gap").isNotNull() & F.min(covered).over(Window.partitionBy(key, "gap"))


def sparse(key: str, col: str, peak: str, unknown: str, least: float, half: int, fraction: float) -> Column:
    """Cells around which ``fraction`` of the known cells reach ``least`` and at least half the cells are known."""
    w = _w(key, col).rowsBetween(-half, half)
    known = F.sum((~F.col(unknown)).cast("int")).over(w)
    good = F.sum((F.coalesce(F.col(peak) >= least, F.lit(False)) & ~F.col(unknown)).cast("int")).over(w)
    return (known * 2 >= F.count("*").over(w)) & (good >= fraction * known)


def consistent(df: DataFrame, key: str, col: str, peak: str, rate: str, least: float, n: int, tolerance: float, fraction: float) -> DataFrame:
    """``df`` with consistent: inside ``n`` cells of which most reach ``least`` and most of those agree on the rate."""
    w = _w(key, col)
    ahead = w.rowsBetween(0, n - 1)
    need = max(1, -int(-fraction * n // 1))
    strong = F.when((F.col(peak) >= least) & F.col(rate).isNotNull(), F.col(rate))
    df = df.withColumns({"_rates": F.collect_list(strong).over(ahead), "_mid": F.percentile(strong, F.lit(0.5)).over(ahead), "_n": F.count("*").over(ahead)})
    agree = F.size(F.filter("_rates", lambda r: F.abs(r - F.col("_mid")) <= tolerance))
    df = df.withColumn("_ok", (F.col("_n") == n) & (F.size("_rates") >= need) & (agree >= need))
    return df.withColumn("consistent", F.max("_ok").over(w.rowsBetween(-(n - 1), 0))).drop("_rates", "_mid", "_n", "_ok")


def longest_run(df: DataFrame, key: str, col: str, flag: str) -> DataFrame:
    """key, longest: the longest stretch of set cells."""
    runs = with_runs(df, key, col, flag)
    return runs.groupBy(key).agg(F.max(F.when(F.col(flag), F.col("run_length")).otherwise(F.lit(0))).alias("longest"))


def range_verdict(df: DataFrame, key: str, col: str, level: str, peak: str, motion: float, least: float, run: int) -> DataFrame:
    """key, p90, longest, verdict: motion where p90 of the level exceeds ``motion``, breathing where ``run`` peaks follow each other."""
    p90 = df.groupBy(key).agg(F.percentile(level, F.lit(0.9)).alias("p90"))
    longest = longest_run(df.withColumn("_b", F.coalesce(F.col(peak) >= least, F.lit(False))), key, col, "_b")
    return p90.join(longest, key).withColumn("verdict", F.when(F.col("p90") > motion, "motion").when(F.col("longest") >= run, "breathing").otherwise("empty"))


def range_series(df: DataFrame, key: str, col: str, level: str, peak: str, unknown: str, window: int, motion: float, least: float, run: int) -> DataFrame:
    """``df`` with state: the range rule on the ``window`` cells that end at each cell; runs are clipped at its start."""
    w = _w(key, col).rowsBetween(-(window - 1), 0)
    back = F.sum((~F.coalesce(F.col(peak) >= least, F.lit(False))).cast("int")).over(_w(key, col))
    df = df.withColumn("_z", back)
    place = F.row_number().over(Window.partitionBy(key, "_z").orderBy(col))
    strong = F.coalesce(F.col(peak) >= least, F.lit(False))
    # place counts the run so far, plus one for the weak cell that opens it
    df = df.withColumn("_run", F.when(strong, place - F.when(F.col("_z") > 0, 1).otherwise(0)).otherwise(0))
    df = df.withColumns({"_known": F.sum((~F.col(unknown)).cast("int")).over(w), "_p90": F.percentile(level, F.lit(0.9)).over(w), "_runs": F.collect_list("_run").over(w)})
    clipped = F.array_max(F.transform("_runs", lambda x, i: F.least(x, i + 1)))
    state = F.when(F.col("_known") * 2 < window, "unknown").when(F.col("_p90") > motion, "motion").when(clipped >= run, "breathing").otherwise("empty")
    return df.withColumn("state", state).drop("_z", "_run", "_known", "_p90", "_runs")


def presence_state(motion: Column, unknown: Column, deviation: Column, ratio: Column, deviation_most: float | None, motion_most: float, ratio_most: float) -> Column:
    """unknown before moving before unknown (no reference) before present before empty."""
    referenced = F.lit(deviation_most is not None)
    return (
        F.when(F.coalesce(unknown, F.lit(True)) | motion.isNull() | F.isnan(motion), "unknown")
        .when((motion > motion_most) | F.coalesce(ratio > ratio_most, F.lit(False)), "moving")
        .when(~referenced | deviation.isNull() | F.isnan(deviation), "unknown")
        .when(deviation > F.lit(deviation_most), "present")
        .otherwise("empty")
    )


def hybrid_state(unknown: Column, moving: Column, breathing: Column, held: Column, bridged_: Column) -> Column:
    """The strongest claim of a cell: empty, held, bridged, breathing, moving, unknown in ascending order."""
    return F.when(unknown, "unknown").when(moving, "moving").when(breathing, "breathing").when(bridged_, "bridged").when(held, "held").otherwise("empty")
