"""Directions of complex frames: how they drift from block to block, removal of fast ones, and frames without the direct path.

Frames are a numbered table (key, i, n, arrays of real and imaginary parts). Eigenvectors come from matrices of bounded
size: those of one block of frames, or sums of products over a whole key that add up task by task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import previous, quantiles
from .gains import products
from .joins import kept
from .orientation import BLOCK, _matrix, in_blocks

# Directions that are taken out, points of a delay tap, taps around the peak that are the direct path.
FAST, PADDING, TAPS = 4, 4, 1.5
#: Slices in which steps are counted while they grow by a factor of e.
SLICES = 256


def _complex(re: pa.Array, im: pa.Array) -> np.ndarray:
    """Rows of complex samples; absent ones are 0."""
    return np.nan_to_num(_matrix(re)) + 1j * np.nan_to_num(_matrix(im))


def block_directions(frames: DataFrame, key: str, length: int, re: str = "re", im: str = "im") -> DataFrame:
    """key, block, re, im: the leading direction of every ``length`` frames in a row, each subcarrier without its straight line.

    As many blocks as end before the key's last frame: a block that ends with it is left out.
    """
    kind = frames.schema[key].dataType.simpleString()
    line = np.linalg.qr(np.stack([np.ones(length), np.arange(length)], 1))[0]

    def leading(table: pa.Table) -> pa.Table:
        table = table.sort_by("i")
        z = _complex(*(table.column(c).combine_chunks() for c in (re, im)))
        z = z - line @ (line.T @ z)
        v = np.linalg.eigh(z.conj().T @ z)[1][:, -1]
        return pa.table({key: table.column(key).slice(0, 1), "block": table.column("block").slice(0, 1), "re": pa.array([v.real.tolist()]), "im": pa.array([v.imag.tolist()])})

    blocks = frames.withColumn("block", F.floor(F.col("i") / length)).where((F.col("block") + 1) * length < F.col("n"))
    return blocks.select(key, "block", "i", re, im).groupBy(key, "block").applyInArrow(leading, f"`{key}` {kind}, block bigint, re array<double>, im array<double>")


def direction_drift(directions: DataFrame, key: str) -> DataFrame:
    """key, drift: the median over neighbouring blocks of 1 - |inner product| of their directions. Keys of one block have no row."""
    w = Window.partitionBy(key).orderBy("block")  # one row a block
    both = directions.withColumns({"_re": F.lag("re").over(w), "_im": F.lag("im").over(w)}).where("_re IS NOT NULL")
    part = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    along, across = part("re", "_re") + part("im", "_im"), part("re", "_im") - part("im", "_re")
    steps = both.select(key, F.greatest(1 - F.hypot(along, across), F.lit(0.0)).alias("_step"))
    return quantiles(steps, key, "_step", [0.5], 0.01).select(key, F.col("q0").alias("drift"))


def means(frames: DataFrame, key: str, re: str = "re", im: str = "im") -> DataFrame:
    """key, mean: the mean of each real and imaginary sample of a key, in one array; absent samples count as 0."""
    known = lambda c: F.transform(c, lambda x: F.when(x.isNotNull() & ~F.isnan(x), x).otherwise(0.0))
    cells = frames.select(key, F.posexplode(F.concat(known(re), known(im))).alias("_at", "_v")).groupBy(key, "_at").agg(F.avg("_v").alias("_m"))
    return cells.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("_at", "_m"))), lambda x: x["_m"]).alias("mean"))  # one entry a sample


def without_fast(frames: DataFrame, key: str, smooth: int, count: int = FAST, re: str = "re", im: str = "im", block: int = BLOCK) -> DataFrame:
    """key, i, re, im: frames without the ``count`` directions in which they change fastest.

    Fast is what a moving mean over ``smooth`` frames (zeros beyond the ends) leaves of the frames less their mean; its
    directions are the leading eigenvectors over the whole key. The mean stays.
    """
    centred = kept(frames.select(key, "i", "n", re, im).join(means(frames, key, re, im), key))

    def fast(c: dict, own: np.ndarray) -> dict:
        mean = _matrix(c["mean"])
        z = _complex(c[re], c[im])
        z = z - (mean[:, : z.shape[1]] + 1j * mean[:, z.shape[1] :])
        total = np.concatenate([np.zeros((1, z.shape[1]), complex), np.cumsum(z, axis=0)])
        at, behind = np.arange(len(z)), (smooth - 1) // 2
        high = z - (total[np.clip(at + behind + 1, 0, len(z))] - total[np.clip(at - (smooth - 1 - behind), 0, len(z))]) / smooth
        return {"x": pa.array(np.concatenate([high.real, high.imag], 1)[own].tolist(), pa.list_(pa.float64()))}

    high = in_blocks(centred, key, smooth, block, fast, [re, im, "mean", "n"], {"x": "array<double>"})
    kind = frames.schema[key].dataType.simpleString()

    def directions(table: pa.Table) -> pa.Table:
        n = max(table.column("a").to_pylist()) + 1
        full = np.zeros((n, n + 2))
        full[table.column("a").to_numpy(), table.column("b").to_numpy()] = table.column("total").to_numpy()
        g, m = full[:, :n], n // 2
        v = np.linalg.eigh(g[:m, :m] + g[m:, m:] + 1j * (g[:m, m:] - g[m:, :m]))[1][:, -count:].T  # sums of conj(a) * b
        return pa.table({key: table.column(key).slice(0, 1), "basis": pa.array([np.concatenate([v.real, v.imag], 1).tolist()], pa.list_(pa.list_(pa.float64())))})

    bases = products(high, key, "x").groupBy(key).applyInArrow(directions, f"`{key}` {kind}, basis array<array<double>>")  # one matrix a key

    def removed(batches):
        for batch in batches:
            z, mean = _complex(batch.column(2), batch.column(3)), _matrix(batch.column(4))
            m, out = z.shape[1], []
            bases_of = batch.column(5).to_pylist()
            for row, mu, basis in zip(z, mean[:, :m] + 1j * mean[:, m:], bases_of):
                v = np.array([np.array(b[:m]) + 1j * np.array(b[m:]) for b in basis])
                x = row - mu
                out.append(x - (x @ v.T) @ v.conj() + mu)
            z = np.array(out).reshape(len(out), m)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(z.real.tolist(), pa.list_(pa.float64())), pa.array(z.imag.tolist(), pa.list_(pa.float64()))], names=[key, "i", "re", "im"])

    joined = centred.join(bases, key).select(key, "i", re, im, "mean", "basis")
    return joined.mapInArrow(removed, f"`{key}` {kind}, i bigint, re array<double>, im array<double>")


def without_direct_path(frames: DataFrame, re: str = "re", im: str = "im", padding: int = PADDING, taps: float = TAPS) -> DataFrame:
    """``frames`` with re and im less the direct path: in the delay domain what lies within ``taps`` of the strongest delay is zero.

    A frame's arrays are all bins of its band, absent ones null; those stay null. Row by row, in Arrow batches.
    """
    spots = [frames.columns.index(c) for c in (re, im)]

    def run(batches):
        for batch in batches:
            a, b = (_matrix(batch.column(k)) for k in spots)
            absent, size = ~(np.isfinite(a) & np.isfinite(b)), a.shape[1] * padding
            if size:
                delays = np.fft.ifft(np.where(absent, 0, np.nan_to_num(a) + 1j * np.nan_to_num(b)), n=size, axis=1)
                away = (np.arange(size) - np.abs(delays).argmax(1)[:, None] + size // 2) % size - size // 2
                z = np.fft.fft(np.where(np.abs(away) < taps * padding, 0, delays), axis=1)[:, : a.shape[1]]
                planes = []
                for x, k in ((z.real, spots[0]), (z.imag, spots[1])):
                    rows = [None if not old.is_valid else [None if gone else float(v) for v, gone in zip(row[: len(old)], hole)] for row, hole, old in zip(x, absent, batch.column(k))]
                    planes.append(pa.array(rows, batch.schema.field(k).type))
                columns = list(batch.columns)
                columns[spots[0]], columns[spots[1]] = planes
                batch = pa.RecordBatch.from_arrays(columns, schema=batch.schema)
            yield batch

    return frames.mapInArrow(run, frames.schema)


def previous_step(frames: DataFrame, key: str, t: str, block: int) -> DataFrame:
    """key, _step: the time from each frame of a numbered table to the next, found in blocks of frames."""
    return previous(frames.select(key, "i", t), key, "i", "i", [t], block).select(key, (F.col(t) - F.col(f"prev_{t}")).alias("_step")).where("_step IS NOT NULL")


def delay_spread(frames: DataFrame, key: str, t: str, lag: float, re: str = "re", im: str = "im", block: int = BLOCK) -> DataFrame:
    """key, n, spread: how far the strongest delay of a frame's change over ``lag`` seconds strays, as a deviation in bins.

    A change is a frame less the one ``lag`` seconds before it in frames of the key's median step (at least one frame),
    less its mean over subcarriers; its delays are the bins of a transform four times as long, the later half negative,
    of equally strong ones the first. Changes with an unknown sample do not count. Keys of one frame have no row, keys
    of fewer than four changes a null spread.
    """
    steps = previous_step(frames, key, t, block)
    # steps differ by orders of size between keys and within one, so slices are even in their logarithm
    at = quantiles(steps, key, "_step", [0.5], F.when(F.col("_step") > 0, F.floor(F.log("_step") * SLICES)).otherwise(-(1 << 20)).cast("bigint")).select(key, F.when(F.col("q0") > 0, F.greatest(F.rint(lag / F.col("q0")), F.lit(1.0))).otherwise(1.0).cast("bigint").alias("_lag"))
    at = kept(at)
    kind = frames.schema[key].dataType.simpleString()

    def peaks(batches):
        for batch in batches:
            now, then = (_matrix(batch.column(k)) + 1j * _matrix(batch.column(k + 1)) for k in (1, 3))
            width = max(now.shape[1], then.shape[1])
            wide = lambda z: np.pad(z, ((0, 0), (0, width - z.shape[1])), constant_values=np.nan)
            d = wide(now) - wide(then)
            out = np.full(len(d), np.nan)
            if width and len(d):
                d = d - d.mean(axis=1, keepdims=True)
                size = PADDING * width
                top = np.abs(np.fft.fft(d, n=size, axis=1)).argmax(1).astype(float)
                out = np.where(np.isfinite(d).all(axis=1), np.where(top > size / 2, top - size, top), np.nan)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, from_pandas=True)], names=[key, "delay"])

    # each frame meets the one its key's lag before it by its place: a margin would hold the longest lag of all keys
    known = kept(frames.select(key, "i", "n", re, im).join(at, key).where(F.col("_lag") < F.col("n")))  # others have no change
    then = known.select(key, (F.col("i") + F.col("_lag")).alias("i"), F.col(re).alias("_re"), F.col(im).alias("_im"))
    found = known.join(then, [key, "i"]).select(key, re, im, "_re", "_im").mapInArrow(peaks, f"`{key}` {kind}, delay double")
    spread = found.groupBy(key).agg(F.count("delay").alias("n"), F.stddev_pop("delay").alias("spread"))
    every = at.select(key).join(spread, key, "left")
    return every.select(key, F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("n") >= 4, F.col("spread")).alias("spread"))
