"""Connected components by alternating large and small stars (Kiveris et al., 2014), on edge tables alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Work


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link each node's larger (or smaller) neighbours, and in a small star itself, to its least neighbour."""
    back = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    both = edges.unionByName(back) if large else edges.unionByName(back).where(F.col("v") < F.col("u"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = both.join(least, "u")
    if large:
        joined = joined.where(F.col("v") > F.col("u"))
    out = joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        out = out.unionByName(least.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node of its component) of every node but the roots, from undirected edges (u, v)."""
    work, k = Work(edges.sparkSession), 0
    edges = work.saved(edges.select("u", "v").where(F.col("u") != F.col("v")).distinct(), "0")
    mark = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = mark(edges)
    while before[0]:
        edges = work.saved(_star(_star(edges, True), False), str(k + 1))
        work.drop(str(k))
        k, now = k + 1, mark(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
