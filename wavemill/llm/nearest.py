"""Approximate nearest neighbours by collision counting: query-centred windows on sorted projections (Huang et al., 2015).

Each vector is projected on ``m`` random lines, and every line's projections are kept as one sorted array. A query opens
a window around its own projection on each line; a vector that lies in the windows of at least ``l`` lines is verified
by its distance. While fewer than k verified vectors lie within the radius R that the windows stand for, R and with it
all windows grow (virtual rehashing): only what the wider windows add is counted. ``l`` is the largest number that a
vector at distance R reaches with probability ``recall``, so true neighbours are missed with 1 - recall at most, at any
distribution of the data. Windows that hold everything verify everything: a small table is searched exactly.

The index is dealt in blocks of about ``block_rows`` vectors by hash, the queries in groups; every group meets every
block in one task, which holds one block and streams the queries. The k best of each block meet by query.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import schema_of

#: Lines, width of the windows in units of R, growth of R, and the share of neighbours that windows must not miss.
LINES, WIDTH, GROWTH, RECALL = 64, 2.72, 1.15, 0.98
#: Vectors of a block and queries of a group. They only decide what meets in one task.
BLOCK_ROWS, GROUP_ROWS = 4096, 2048
#: Vectors of a block that tell a query where its windows start, and queries that widen theirs together.
SOME, TOGETHER = 128, 64
SEED = 20


def collision_threshold(lines: int, width: float, recall: float) -> int:
    """The largest number of lines that a vector at distance R shares with the query with probability ``recall`` or more."""
    p = math.erf(width / 2 / math.sqrt(2))  # |N(0, R^2)| <= width * R / 2
    at_least = 0.0
    for n in range(lines, 0, -1):
        at_least += math.exp(math.lgamma(lines + 1) - math.lgamma(n + 1) - math.lgamma(lines - n + 1) + n * math.log(p) + (lines - n) * math.log1p(-p))
        if at_least >= recall:
            return n
    return 1


class Block:
    """The sorted projections of some vectors of one length."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, lines: int, width: float, growth: float, recall: float):
        self.ids, self.vectors, self.width, self.growth = ids, vectors, width, growth
        self.need = collision_threshold(lines, width, recall)
        self.lines = np.random.default_rng(SEED).standard_normal((vectors.shape[1], lines))
        projected = (vectors @ self.lines).T
        self.order = np.argsort(projected, axis=1, kind="stable")
        self.sorted = np.take_along_axis(projected, self.order, axis=1)
        self.some = vectors[:: max(1, len(vectors) // SOME)]

    def search(self, queries: np.ndarray, own: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query the ids and distances of the k nearest vectors found, nearest first, ties by id; those under the query's id in ``own`` do not count."""
        projected = queries @ self.lines
        # windows start at the distance of the nearest of a few vectors, and at no less than rounding can tell apart
        near = np.array([np.sqrt(((self.some - q) ** 2).sum(1)) for q in queries])
        radius = np.maximum(np.where(near > 0, near, np.inf).min(1), 1e-9 * np.abs(self.sorted).max())
        radius = np.where(np.isfinite(radius), radius, 1.0) / self.growth
        asked = [_Asked(len(self.ids), projected.shape[1], self.ids == i) for i in own]
        going = np.arange(len(queries))
        while len(going):
            reach = self.width * radius[going] / 2
            low, high = np.empty((len(going), len(self.sorted)), np.int64), np.empty((len(going), len(self.sorted)), np.int64)
            for i, line in enumerate(self.sorted):  # all queries at once on one sorted array
                low[:, i] = np.searchsorted(line, projected[going, i] - reach, "left")
                high[:, i] = np.searchsorted(line, projected[going, i] + reach, "right")
            left = []
            for row, q in enumerate(going):
                asked[q].widen(self, queries[q], low[row], high[row])
                if not asked[q].enough(self, radius[q], k):
                    left.append(q)
            going = np.array(left, np.int64)
            radius[going] *= self.growth
        return [x.best(self, k) for x in asked]


class _Asked:
    """What one query has seen of a block: its windows, the collisions of each vector, and the verified ones."""

    def __init__(self, n: int, lines: int, own: np.ndarray):
        self.low = self.high = None
        self.counts, self.verified, self.found, self.distances = np.zeros(n, np.int64), own, [], []

    def widen(self, block: Block, query: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        """Count what the wider windows add, and verify the vectors that now collide often enough."""
        if self.low is None:
            added = [block.order[i, a:b] for i, (a, b) in enumerate(zip(low.tolist(), high.tolist()))]
        else:
            added = [block.order[i, a:b] for i, (a, b) in enumerate(zip(low.tolist(), self.low.tolist())) if a < b]
            added += [block.order[i, a:b] for i, (a, b) in enumerate(zip(self.high.tolist(), high.tolist())) if a < b]
        self.low, self.high = low, high
        if not added:
            return
        self.counts += np.bincount(np.concatenate(added), minlength=len(self.counts))
        fresh = np.flatnonzero((self.counts >= block.need) & ~self.verified)
        if len(fresh):
            self.verified[fresh] = True
            self.found.append(fresh)
            self.distances.append(np.sqrt(((block.vectors[fresh] - query) ** 2).sum(1)))

    def enough(self, block: Block, radius: float, k: int) -> bool:
        """Whether k different ids lie within the radius, or nothing is left to verify."""
        if self.verified.all():
            return True
        near = [block.ids[rows[d <= radius]] for rows, d in zip(self.found, self.distances)]
        return sum(map(len, near)) >= k and len(np.unique(np.concatenate(near))) >= k

    def best(self, block: Block, k: int) -> tuple[np.ndarray, np.ndarray]:
        if not self.found:
            return np.zeros(0, np.int64), np.zeros(0)
        rows, d = np.concatenate(self.found), np.concatenate(self.distances)
        order = np.lexsort((block.ids[rows], d))
        ids = block.ids[rows[order]]
        _, first = np.unique(ids, return_index=True)  # an id of several vectors counts with the nearest
        first = np.sort(first)[:k]
        return ids[first], d[order][first]


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """Rows with an id and a vector of finite components that are not all zero."""
    good = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(column, lambda x: x != 0)
    return vectors.where(F.col("vec_id").isNotNull() & F.coalesce(good, F.lit(False)))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, lines: int = LINES, width: float = WIDTH, growth: float = GROWTH, recall: float = RECALL, block_rows: int = BLOCK_ROWS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest vectors found of each query by Euclidean distance, ties by id.

    ``vectors`` and ``queries`` have vec_id (integer) and embedding (array of floats or doubles); other columns are
    ignored. Rows with a null id and vectors that are null, empty, zero or hold null or non-finite components take no
    part. Vectors of another length than the query's are no candidates, nor is what shares its id. Repeated rows count
    once; an id with several vectors counts with the nearest. No vectors or no queries give no rows.
    """
    pick = lambda df: usable(df).select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).distinct()
    vectors, queries = pick(vectors), pick(queries)
    blocks, groups = max(1, math.ceil(vectors.count() / block_rows)), max(1, math.ceil(queries.count() / group_rows))
    hashed = lambda n, salt: F.pmod(F.xxhash64("vec_id", "v", F.lit(salt)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    index = vectors.select(hashed(blocks, "block").alias("block"), every(groups).alias("of"), F.lit(0).alias("asks"), "vec_id", "v")
    asked = queries.select(every(blocks).alias("block"), hashed(groups, "group").alias("of"), F.lit(1).alias("asks"), "vec_id", "v")
    dealt = index.union(asked).repartition("block", "of").sortWithinPartitions("block", "of", "asks", "vec_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, built = None, [], {}

        def index_of(length):
            if length not in built:
                ids = np.concatenate([i[s == length] for i, s, _ in held]) if held else np.zeros(0, np.int64)
                rows = [v for _, s, vs in held for v, n in zip(vs, s) if n == length]
                built[length] = Block(ids, np.stack(rows), lines, width, growth, recall) if rows else None
            return built[length]

        for batch in batches:
            keys = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], 1)
            cuts = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(1)))
            for i, j in zip(cuts, np.append(cuts[1:], len(keys))):
                if at != tuple(keys[i]):
                    at, held, built = tuple(keys[i]), [], {}
                part = batch.slice(i, j - i)
                asks, ids = part.column(2).to_numpy().astype(bool), part.column(3).to_numpy()
                flat, offsets = part.column(4).flatten().to_numpy(), part.column(4).offsets.to_numpy()
                rows = np.split(flat, (offsets - offsets[0])[1:-1])
                mine = ~asks
                if mine.any():
                    held.append((ids[mine], np.diff(offsets)[mine], [r for r, m in zip(rows, mine) if m]))
                out: tuple[list, list, list] = [], [], []
                lengths, questions = np.diff(offsets), np.flatnonzero(asks)
                for length in np.unique(lengths[questions]):
                    block, same = index_of(length), questions[lengths[questions] == length]
                    for at_once in range(0, len(same) if block is not None else 0, TOGETHER):
                        mine = same[at_once : at_once + TOGETHER]
                        for q, (near, d) in zip(mine, block.search(np.stack([rows[x] for x in mine]), ids[mine], k)):
                            out[0].append(np.full(len(near), ids[q]))
                            out[1].append(near)
                            out[2].append(d)
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=["query_id", "vec_id", "score"])

    met = dealt.mapInArrow(run, schema_of(query_id="bigint", vec_id="bigint", score="double"))
    met = met.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))  # k rows a block
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
