"""Reference pools: which of a row's few nearest references describe the same room, and the one to compare with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from .joins import nearest_pool


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def deviation(a: Column, b: Column) -> Column:
    """Mean absolute difference of two profiles over the places that both have; null where there are none."""
    both = F.filter(F.zip_with(a, b, lambda x, y: F.when(_finite(x) & _finite(y), F.abs(x - y))), lambda d: d.isNotNull())
    return A.let(both, lambda d: F.try_divide(F.aggregate(d, F.lit(0.0), lambda s, x: s + x), F.size(d)))


def _median(x: Column) -> Column:
    ordered = F.array_sort(x)
    return A.let(ordered, lambda s: (F.get(s, F.floor((F.size(s) - 1) / 2).cast("int")) + F.get(s, F.floor(F.size(s) / 2).cast("int"))) / 2)


def screened(pool: Column, radius: float) -> Column:
    """kept (places of the largest group of profiles within ``radius`` of one of them; of equally large ones that of the first) and spread (median distance of all pairs, 0 without any).

    ``pool`` is an array of profiles of bounded length; null of an empty one.
    """
    n = F.size(pool)
    every = F.sequence(F.lit(0), n - 1)
    at = lambda k: F.get(pool, k)
    # an anchor is always near itself; a pair without common places is near nothing
    near = F.transform(every, lambda i: F.filter(every, lambda j: (i == j) | F.coalesce(deviation(at(i), at(j)) <= radius, F.lit(False))))
    best = A.let(near, lambda g: F.get(F.filter(g, lambda x: F.size(x) == F.array_max(F.transform(g, lambda y: F.size(y)))), F.lit(0)))
    pairs = F.flatten(F.transform(every, lambda i: F.transform(F.filter(every, lambda j: j > i), lambda j: deviation(at(i), at(j)))))
    known = F.filter(pairs, lambda d: d.isNotNull())
    return F.when(n > 0, F.struct(best.alias("kept"), F.coalesce(_median(known), F.lit(0.0)).alias("spread")))


def screen_pools(rows: DataFrame, references: DataFrame, key: str, t: str, row_id: str, profile: str, reach: float, most: int, radius: float) -> DataFrame:
    """row_id, kept (reference ids), n_pool, spread and reference: the screened pool of each row's ``most`` nearest references.

    References are of the same key, at most ``reach`` away and not the row itself; a pool holds them in order of
    distance in time, ties by id. ``reference`` is the nearest of those kept, where at least two are, else null.
    Rows without any reference in reach are left out.
    """
    near = nearest_pool(rows.select(key, t, row_id), references.select(key, t, row_id), key, t, row_id, reach, most)
    with_profile = near.join(references.select(F.col(row_id).alias("other"), F.col(profile).alias("_p")), "other")
    pools = with_profile.groupBy(row_id).agg(F.sort_array(F.collect_list(F.struct("rank", "other", "_p"))).alias("_pool"))  # ``most`` at most
    judged = pools.withColumn("_s", screened(F.transform("_pool", lambda x: x["_p"]), radius))
    kept = F.transform(F.col("_s.kept"), lambda k: F.get("_pool", k)["other"])
    return judged.select(row_id, kept.alias("kept"), F.size("_pool").alias("n_pool"), F.col("_s.spread").alias("spread"), F.when(F.size("_s.kept") >= 2, F.get(kept, F.lit(0))).alias("reference"))
