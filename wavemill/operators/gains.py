"""Receiver gain states: what each does to the shape of a frame's decibels, and its removal.

Frames of the state that most frames of a key have stand for the true shape. Every other frame is compared with the
median of such frames close to it; the differences of a state give its offset, and those of all states together the few
directions that distortions lie along: leading singular vectors, from sums of products that add up frame by frame.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import let, total
from .frames import quantiles
from .joins import kept
from .orientation import BLOCK, _finite, _lists, _matrix, in_blocks

# Frames on either side that a frame is compared with, least number of them, least frames of a state and of the directions, number of directions, share of true frames that stay as they are.
NEAR, LEAST_NEAR, LEAST_STATE, LEAST_SHAPE, DIRECTIONS, TRUE_SHARE, LEAST_WIDTH = 50, 8, 20, 30, 3, 0.99, 8
#: Samples of neighbouring frames that are ordered at once.
CELLS = 1 << 19


def _middles(x: np.ndarray) -> np.ndarray:
    """Medians along the last axis, NaN left out; NaN where there is nothing else."""
    if not x.shape[-1]:
        return np.full(x.shape[:-1], np.nan)
    x = np.sort(x, axis=-1)  # NaN goes last
    n = (~np.isnan(x)).sum(-1)
    at = lambda k: np.take_along_axis(x, np.maximum(k, 0)[..., None], -1)[..., 0]
    return (at((n - 1) // 2) + at(n // 2)) / 2


def _shapes(levels: np.ndarray) -> np.ndarray:
    """Rows less their own medians; NaN where absent."""
    levels = np.where(np.isfinite(levels), levels, np.nan)
    return levels - _middles(levels)[:, None]


def _near_medians(rows: np.ndarray, places: np.ndarray, at: np.ndarray, asked: np.ndarray, near: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """For each ``asked`` row: whether ``least`` of ``places`` besides itself are at most ``near`` away, and the median of their rows, if so."""
    first, end = (np.searchsorted(at[places], at[asked] + reach, side) for reach, side in ((-near, "left"), (near, "right")))
    enough = end - first - np.isin(asked, places) >= least
    out = np.full((len(asked), rows.shape[1]), np.nan)
    todo = np.flatnonzero(enough)
    wide = int((end - first)[todo].max(initial=0))
    size = max(1, CELLS // max(1, wide * rows.shape[1]))
    for k in range(0, len(todo), size):
        part = todo[k : k + size]
        spots = first[part, None] + np.arange(wide)
        other = places[np.minimum(spots, len(places) - 1)]
        window = rows[other]
        window[(spots >= end[part, None]) | (other == asked[part, None])] = np.nan
        out[part] = _middles(np.ascontiguousarray(window.transpose(0, 2, 1)))
    return enough, out


def with_main_state(frames: DataFrame, key: str, state: str) -> DataFrame:
    """``frames`` with main: the state of most frames of each key, the least of equally frequent ones; null states do not count."""
    counts = frames.where(F.col(state).isNotNull()).groupBy(key, state).agg(F.count("*").alias("_n"))
    main = counts.groupBy(key).agg(F.max_by(state, F.struct("_n", -F.col(state))).alias("main"))
    return frames.join(F.broadcast(main), key)  # one number a key


def differences(frames: DataFrame, key: str, state: str, level: str, near: int = NEAR, least: int = LEAST_NEAR, block: int = BLOCK) -> DataFrame:
    """key, i, state, delta: how the shape of each frame of another state differs from the median shape of main frames at most ``near`` places away."""

    def run(c: dict, own: np.ndarray) -> dict:
        shapes = _shapes(_matrix(c[level]))
        states, main = (c[k].to_numpy(zero_copy_only=False) for k in (state, "main"))
        true = states == main
        asked = np.flatnonzero(own & ~true & (states == states))  # a null state is NaN here
        enough, middles = _near_medians(shapes, np.flatnonzero(true), c["i"], asked, near, least)
        out, known = np.full(shapes.shape, np.nan), np.zeros(len(shapes), bool)
        out[asked], known[asked] = shapes[asked] - middles, enough
        return {state: pa.array(states[own].astype(float)), "delta": _lists(out[own], known[own])}

    return in_blocks(frames, key, near, block, run, [state, level, "main", "n"], {state: "double", "delta": "array<double>"}).where("delta IS NOT NULL")


def offsets(deltas: DataFrame, key: str, state: str, least: int = LEAST_STATE) -> DataFrame:
    """key, state, offset: the median difference of each state that has at least ``least`` of them, less its own median; 0 where unknown."""
    often = deltas.groupBy(key, state).agg(F.count("*").alias("_rows"), F.max(F.size("delta")).alias("_width")).where(F.col("_rows") >= least)
    cells = deltas.join(often.select(key, state), [key, state], "left_semi").select(F.struct(key, state).alias("_k"), F.posexplode("delta").alias("_sc", "_v")).where(_finite(F.col("_v")))
    medians = quantiles(cells.select(F.struct("_k", "_sc").alias("_ks"), "_v"), "_ks", "_v", [0.5], 0.25)
    listed = medians.groupBy(F.col(f"_ks._k.{key}").alias(key), F.col(f"_ks._k.{state}").alias(state)).agg(F.map_from_entries(F.collect_list(F.struct("_ks._sc", "q0"))).alias("_m"))  # one entry a subcarrier
    full = F.transform(F.sequence(F.lit(0), F.col("_width") - 1), lambda k: F.try_element_at("_m", k))
    known = F.array_sort(F.map_values("_m"))
    n = F.size("_m")
    middle = (F.element_at(known, F.floor((n + 1) / 2).cast("int")) + F.element_at(known, F.floor(n / 2 + 1).cast("int"))) / 2
    return listed.join(often, [key, state]).select(key, state, F.transform(full, lambda x: F.coalesce(x - middle, F.lit(0.0))).alias("offset"))


def products(rows: DataFrame, key: str, values: str) -> DataFrame:
    """key, a, b, total: sums of x[a] * x[b] over the rows of each key (b = -1: of x[a]; b = -2: how many are finite), absent values as 0.

    Tasks add up their rows as matrices and pass on one per key; sums by place meet with partial aggregation. Cells are
    those of one matrix a key, whatever the number of rows.
    """

    def run(batches):
        sums: dict = {}
        for batch in batches:
            codes, x = batch.column(0).dictionary_encode(null_encoding="encode"), _matrix(batch.column(1))
            of = codes.indices.to_numpy(zero_copy_only=False)
            for j, k in enumerate(codes.dictionary.to_pylist()):
                mine = x[of == j]
                good = np.isfinite(mine)
                mine = np.where(good, mine, 0)
                total = np.concatenate([mine.T @ mine, mine.sum(0)[:, None], good.sum(0)[:, None]], 1)
                old = sums.get(k)
                if old is not None and old.shape != total.shape:  # rows of several widths: the narrower one is padded
                    wide = max(len(old), len(total))
                    old, total = (_padded(x, wide) for x in (old, total))
                sums[k] = total if old is None else old + total
            if sum(x.size for x in sums.values()) > 1 << 22:
                yield from passed(sums)
                sums = {}
        yield from passed(sums)

    def passed(sums: dict):
        for k, total in sums.items():
            n = len(total)
            a, b = np.meshgrid(np.arange(n), np.r_[np.arange(n), -1, -2], indexing="ij")
            yield pa.RecordBatch.from_arrays([pa.array([k] * a.size), pa.array(a.ravel().astype(np.int32)), pa.array(b.ravel().astype(np.int32)), pa.array(total.ravel())], names=[key, "a", "b", "total"])

    kind = rows.schema[key].dataType.simpleString()
    parts = rows.select(key, values).mapInArrow(run, f"`{key}` {kind}, a int, b int, total double")
    return parts.groupBy(key, "a", "b").agg(F.sum("total").alias("total"))


def _padded(total: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((n, n + 2))
    k = len(total)
    out[:k, :k], out[:k, n:] = total[:, :k], total[:, k:]
    return out


def shared_directions(deltas: DataFrame, key: str, count: int = DIRECTIONS, least: int = LEAST_SHAPE) -> DataFrame:
    """key, basis: up to ``count`` orthonormal directions of a key's differences, without level, zero where a subcarrier is not always known.

    The leading eigenvectors of the scatter matrix. A key of fewer than ``least`` differences, or of fewer than eight
    subcarriers that all of them have, has no row.
    """
    sizes = deltas.groupBy(key).agg(F.count("*").alias("_rows")).where(F.col("_rows") >= least)
    cells = products(deltas, key, "delta").join(sizes, key)

    def directions(table: pa.Table) -> pa.Table:
        rows, n = table.column("_rows")[0].as_py(), max(table.column("a").to_pylist()) + 1
        full = np.zeros((n, n + 2))
        full[table.column("a").to_numpy(), table.column("b").to_numpy()] = table.column("total").to_numpy()  # -1 and -2 are the last two
        gram, known, total = full[:, :n], np.flatnonzero(full[:, n] == rows), full[:, n + 1]
        basis: list[np.ndarray] = []
        if len(known) >= LEAST_WIDTH:
            mean = total[known] / rows
            _, vectors = np.linalg.eigh(gram[np.ix_(known, known)] - rows * np.outer(mean, mean))
            level = np.full((len(known), 1), len(known) ** -0.5)
            held = level
            for v in vectors[:, ::-1].T[: min(count, rows)]:
                for _ in range(2):  # twice, so that rounding leaves nothing of what was taken out
                    v = v - held @ (held.T @ v)
                if np.linalg.norm(v) > 1e-9:
                    v = v / np.linalg.norm(v)
                    held = np.concatenate([held, v[:, None]], 1)
                    wide = np.zeros(n)
                    wide[known] = v
                    basis.append(wide)
        out = table.select([key]).slice(0, 1 if basis else 0)
        return out.append_column("basis", pa.array([[b.tolist() for b in basis]][: len(out)], pa.list_(pa.list_(pa.float64()))))

    kind = deltas.schema[key].dataType.simpleString()
    return cells.groupBy(key).applyInArrow(directions, f"`{key}` {kind}, basis array<array<double>>")  # one matrix a key


def along(level: str, basis: str = "basis"):
    """The coefficients of a frame's shape along each direction of a basis; absent samples count as 0."""
    middle = lambda v: (F.get(v, F.floor((F.size(v) - 1) / 2).cast("int")) + F.get(v, F.floor(F.size(v) / 2).cast("int"))) / 2
    shape = lambda m: F.transform(level, lambda x: F.when(_finite(x), x - m).otherwise(0.0))
    one = lambda y, b: total(F.zip_with(y, b, lambda x, d: F.coalesce(x * d, F.lit(0.0))))
    # the median of a frame is bound once: inside the lambdas it would be sorted anew for every sample and direction
    return let(F.array_sort(F.filter(level, _finite)), lambda v: let(middle(v), lambda m: let(shape(m), lambda y: F.transform(basis, lambda b: one(y, b)))))


def strengths(frames: DataFrame, key: str, state: str, near: int = NEAR, least: int = LEAST_NEAR, block: int = BLOCK) -> DataFrame:
    """key, i, stays, move: whether a frame is a main one, and how each frame's coefficients ``y`` differ from the median of main frames close to it, itself left out; null if those are too few."""

    def run(c: dict, own: np.ndarray) -> dict:
        y, asked = _matrix(c["y"]), np.flatnonzero(own)
        true = c[state].to_numpy(zero_copy_only=False) == c["main"].to_numpy(zero_copy_only=False)
        enough, middles = _near_medians(y, np.flatnonzero(true), c["i"], asked, near, least)
        return {"stays": true[own], "move": _lists(y[asked] - middles, enough)}

    return in_blocks(frames, key, near, block, run, ["y", state, "main", "n"], {"stays": "boolean", "move": "array<double>"})


def without_gain(frames: DataFrame, key: str, state: str, level: str, consecutive: bool = True, near: int = NEAR, block: int = BLOCK) -> DataFrame:
    """``frames`` (numbered: i, n) with corrected: the decibels without what the gain state does to their shape.

    Where frames are consecutive, a frame of another state than the main one is moved back along the shared directions
    by its own coefficients, if those are longer than those of 99 % of the main frames; all others of such states by
    their state's offset, if it is known. Main frames, those of unknown states and keys of one state stay as they are.
    """
    rows = kept(with_main_state(frames, key, state))
    deltas = kept(differences(rows, key, state, level, near, block=block).withColumn(state, F.col(state).cast(frames.schema[state].dataType)))
    found = rows.join(offsets(deltas, key, state), [key, state], "left")
    away = F.zip_with(level, "offset", lambda x, o: x - F.coalesce(o, F.lit(0.0)))
    by_state = F.when((F.col(state) != F.col("main")) & F.col("offset").isNotNull(), away).otherwise(F.col(level))
    if not consecutive:
        return found.withColumn("corrected", by_state).drop("main", "offset")
    bases = kept(shared_directions(deltas, key))
    moves = kept(strengths(rows.join(F.broadcast(bases), key).select(key, "i", "n", state, "main", along(level).alias("y")), key, state, near, block=block))
    length = F.sqrt(F.aggregate("move", F.lit(0.0), lambda a, x: a + x * x))
    floors = quantiles(moves.where("stays").select(key, length.alias("_length")), key, "_length", [TRUE_SHARE], 0.05).select(key, F.col("q0").alias("floor"))
    found = found.join(moves.drop("stays"), [key, "i"], "left").join(F.broadcast(bases), key, "left").join(F.broadcast(floors), key, "left")
    shift = lambda x, at: x - F.aggregate(F.zip_with("move", "basis", lambda m, b: m * F.coalesce(F.get(b, at), F.lit(0.0))), F.lit(0.0), lambda a, v: a + v)
    moved = F.transform(level, shift)
    clear = (F.col(state) != F.col("main")) & F.col("move").isNotNull() & (length > F.coalesce("floor", F.lit(0.0)))
    return found.withColumn("corrected", F.when(clear, moved).otherwise(by_state)).drop("main", "offset", "move", "basis", "floor")
