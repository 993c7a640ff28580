"""Ground truth of captures, as expressions: camera labels, the label each source gives, and shares of a training set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def camera_label(share: Column, occupied: float = 0.5, partial: tuple[float, float] = (0.05, 0.95)) -> tuple[Column, Column]:
    """Label and reason against it, from the share of camera frames with a person (null: no camera)."""
    label = F.when(share.isNull(), "").when(share >= occupied, "occupied").otherwise("empty")
    reason = F.when(share.isNull(), "no camera sidecar").when((share > partial[0]) & (share < partial[1]), "camera partial").otherwise("")
    return label, reason


def labelled(captures: DataFrame, occupied: list[str], machines: list[str], span: tuple[float, float], trusted: Column) -> DataFrame:
    """``captures`` (span, share, listed: the operator's class or null) of the right length with label, activity, nonhuman, origin, use and reason.

    The operator's list decides; without an entry the camera does, and its label is only used where ``trusted`` holds
    and nothing speaks against it.
    """
    df = captures.where(F.col("span").between(*span))
    label, why = camera_label(F.col("share"))
    listed, human, machine = F.col("listed").isNotNull(), F.col("listed").isin(occupied), F.col("listed").isin(machines)
    final = F.when(listed, F.when(human, "occupied").otherwise("empty")).otherwise(label)
    by_camera = F.when(label == "occupied", "unknown").when(label == "empty", "none").otherwise("")
    reason = F.when(listed, "").when(~trusted, "not in the operator table").otherwise(why)
    return df.withColumns({
        "label": final,
        "activity": F.when(listed, F.when(human | machine, F.col("listed")).otherwise("none")).otherwise(by_camera),
        "nonhuman": F.coalesce(machine, F.lit(False)).cast("int"),
        "origin": F.when(listed, "table").when(label != "", "camera").otherwise(""),
        "use": ((reason == "") & (final != "")).cast("int"),
        "reason": reason,
    })


def summary(truth: DataFrame, *keys: str) -> DataFrame:
    """Counts of what is usable, by label, and of what is not."""
    n = lambda c: F.sum(c.cast("int"))
    used = F.col("use") == 1
    return truth.groupBy(*keys).agg(F.count("*").alias("n"), n(used & (F.col("label") == "occupied")).alias("occupied"), n(used & (F.col("label") == "empty") & (F.col("nonhuman") == 0)).alias("empty"), n(used & (F.col("nonhuman") == 1)).alias("machine"), n(~used).alias("unused"))


def waterfill(groups: DataFrame, key: str, order: str, size: str, wanted: int) -> DataFrame:
    """key, order, take: ``wanted`` places of each key dealt one by one to the group that has taken least and has any left.

    A group asks for at most ``wanted`` places, so the rows are few whatever its size.
    """
    asks = groups.select(key, order, F.explode(F.sequence(F.lit(1), F.least(F.col(size).cast("int"), F.lit(wanted)))).alias("_layer"))
    nth = F.row_number().over(Window.partitionBy(key).orderBy("_layer", order))
    return asks.withColumn("_nth", nth).where(F.col("_nth") <= wanted).groupBy(key, order).agg(F.count("*").alias("take"))


def state_runs(df: DataFrame, key: str, col: str, state: str) -> DataFrame:
    """key, first, last, state, n: stretches of neighbouring cells of one state (a row a cell)."""
    w = Window.partitionBy(key).orderBy(col)
    new = F.coalesce(((F.lag(state).over(w) != F.col(state)) | (F.lag(col).over(w) != F.col(col) - 1)).cast("int"), F.lit(1))
    run = F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    runs = df.withColumn("_new", new).withColumn("_run", run)
    return runs.groupBy(key, "_run").agg(F.min(col).alias("first"), F.max(col).alias("last"), F.first(state).alias("state"), F.count("*").alias("n")).drop("_run")
