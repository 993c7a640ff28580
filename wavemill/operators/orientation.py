"""Orientation of chain ratios: frames whose two chains were exchanged, or whose ratio is half a turn off, and their repair.

An exchange makes a frame's ratio its reciprocal (phase and decibels change sign), half a turn shifts the phase by pi.
Three comparisons find both, all with one score: how well a frame, or its mirror image, lines up with something to
compare with, up to one constant turn. That is the frame before (which finds where stretches begin), the sum of the
corrected frames around (which mends single frames) and, for a whole stretch, the sum of the frames before a place
against those behind it. They look a few frames far and only tell whether neighbours differ, so they run on blocks of
frames with a margin on both sides; each block starts from an orientation of its own, and blocks are put in line by the
frame that both of two neighbours hold: a running parity over one row a block.

Which of two orientations is the right one is settled last, over longer stretches: against a reference measured once
over the key (`reference`), or, without one, against what most frames of the key agree on.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import let, total
from .frames import numbered, quantiles
from .joins import kept

# Least alignment that counts, frames on either side of a local comparison, rounds of local comparisons.
ALIGNED, NEAR, ROUNDS = 0.7, 8, 2
# Frames of a stretch that is settled, least run that is turned without a reference, least spread (dB) of a profile, least majority of a direction.
STRETCH, LONG_RUN, LEAST_SPREAD, LEAST_MAJORITY = 201, 200, 0.5, 0.15
#: Frames of a block, its margin for the local comparisons, and frames of a part whose medians one task takes. They decide where work is cut.
BLOCK, MARGIN, PART = 2048, 128, 8192


def in_blocks(frames: DataFrame, key: str, margin: int, block: int, run: Callable[[dict, np.ndarray], dict], columns: list[str], out: dict[str, str]) -> DataFrame:
    """key, i and what ``run`` makes of blocks of a numbered table's ``columns``, each block with ``margin`` more rows on both sides.

    ``run`` gets the columns of a block in order of i and which rows are the block's own, and returns columns for them.
    """
    last = F.floor((F.col("n") - 1) / block)
    reach = F.sequence(F.greatest(F.floor((F.col("i") - margin) / block), F.lit(0)), F.least(F.floor((F.col("i") + margin) / block), last))
    dealt = frames.select(key, "i", *columns, F.explode(reach).alias("_block"))
    schema = [frames.schema[key].simpleString().replace(":", " ", 1), "i bigint", *(f"{k} {v}" for k, v in out.items())]

    def part(table: pa.Table) -> pa.Table:
        table = table.sort_by("i")
        at, number = table.column("i").to_numpy(), table.column("_block")[0].as_py()
        own = at // block == number
        made = run({c: table.column(c).combine_chunks() for c in columns} | {"i": at}, own)
        return pa.table({key: table.column(key).filter(pa.array(own)), "i": at[own]} | {c: pa.array(v) for c, v in made.items()})

    return dealt.groupBy(key, "_block").applyInArrow(part, ", ".join(schema))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column as a matrix; null rows and short ones are filled with NaN."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    values = column.flatten().cast(pa.float64(), safe=False).to_numpy(zero_copy_only=False)  # nulls become NaN
    width = int(lengths.max(initial=0))
    out = np.full((len(lengths), width), np.nan)
    out[np.arange(width) < lengths[:, None]] = values
    return out


def _lists(rows: np.ndarray, known: np.ndarray | None = None) -> pa.Array:
    """The rows of a matrix as a list column; those that are not ``known`` are null."""
    known = np.ones(len(rows), bool) if known is None else known
    ends = np.concatenate([[0], np.cumsum(known * rows.shape[1])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(rows[known].ravel().astype(float)), mask=pa.array(~known))


def lined_up(z: np.ndarray, other: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows of unit vectors: whether the mirror image fits ``other`` better, whether half a turn comes with it, and how well (0 to 1)."""
    straight, mirrored = (z * other.conj()).sum(1), (z.conj() * other.conj()).sum(1)
    swapped = np.abs(mirrored) > np.abs(straight)
    best = np.where(swapped, mirrored, straight)
    return swapped, best.real < 0, np.divide(np.abs(best), weight, out=np.zeros(len(z)), where=weight > 0)


def _turned(z: np.ndarray, swap: np.ndarray, rot: np.ndarray) -> np.ndarray:
    z = np.where(swap[:, None], z.conj(), z)
    return np.where(rot[:, None], -z, z)


def _sums(z: np.ndarray, before: int, behind: int) -> np.ndarray:
    """Sums of the rows from ``before`` ahead of each row to ``behind`` after it, itself included."""
    total = np.concatenate([np.zeros((1, z.shape[1]), z.dtype), np.cumsum(z, axis=0)])
    at = np.arange(len(z))
    return total[np.clip(at + behind + 1, 0, len(z))] - total[np.clip(at - before, 0, len(z))]


def _steps(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parities of the turns between each frame and the last one before it that has any sample."""
    there = np.abs(z) > 0
    usable = np.flatnonzero(there.any(1))
    toggles = np.zeros((len(z), 2), bool)
    if len(usable) > 1:
        now, then = usable[1:], usable[:-1]
        swapped, half, fit = lined_up(z[now], z[then], (there[now] & there[then]).sum(1).astype(float))
        toggles[now] = np.stack([swapped, half], 1) & (fit >= ALIGNED)[:, None]
    parity = np.logical_xor.accumulate(toggles, axis=0)
    return parity[:, 0], parity[:, 1]


def _mended(z: np.ndarray, swap: np.ndarray, rot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each frame held against the corrected frames around it, where those agree among themselves."""
    near = min(NEAR, (len(z) - 1) // 2)
    usable = (np.abs(z) > 0).any(1)
    if near < 1:
        return swap, rot
    around = _sums(usable[:, None].astype(float), near, near)[:, 0] - usable
    for _ in range(ROUNDS):
        own = _turned(z, swap, rot)
        other = _sums(own, near, near) - own
        weight = np.abs(other).sum(1)
        swapped, half, _ = lined_up(z, other, weight)
        decided = usable & (weight / np.maximum(around, 1) / z.shape[1] >= ALIGNED)
        swap, rot = np.where(decided, swapped, swap), np.where(decided, half, rot)
    return swap, rot


def _rejoined(z: np.ndarray, swap: np.ndarray, rot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches turned where the frames behind a place fit those before it only when turned; of places close by the clearest counts."""
    near = min(NEAR, len(z) // 2)
    if len(z) < 4 or near < 2:
        return swap, rot
    own = _turned(z, swap, rot)
    behind, before = _sums(own, 0, near - 1), _sums(own, near, -1)
    swapped, half, fit = lined_up(behind, before, (np.abs(behind) * np.abs(before)).sum(1))
    at = np.arange(len(z))
    places = np.flatnonzero((swapped | half) & (fit >= ALIGNED) & (at >= near) & (at < len(z) - near))
    toggles, free = np.zeros((len(z), 2), bool), np.ones(len(z), bool)
    for k in places[np.argsort(-fit[places], kind="stable")]:
        if free[k]:
            toggles[k] = swapped[k], half[k]
            free[max(0, k - near) : k + near + 1] = False
    parity = np.logical_xor.accumulate(toggles, axis=0)
    return swap ^ parity[:, 0], rot ^ parity[:, 1]


def local_states(phase: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Swapped and rotated frames of consecutive rows of ratio phase, relative to the first of them."""
    z = np.where(np.isfinite(phase), np.exp(1j * np.nan_to_num(phase)), 0)
    if len(z) < 2:
        return np.zeros(len(z), bool), np.zeros(len(z), bool)
    swap, rot = _steps(z)
    for _ in range(ROUNDS):
        swap, rot = _rejoined(z, *_mended(z, swap, rot))
        again = _steps(_turned(z, swap, rot))
        swap, rot = swap ^ again[0], rot ^ again[1]
    return swap, rot


def relative_states(frames: DataFrame, key: str, phase: str, block: int = BLOCK, margin: int = MARGIN) -> DataFrame:
    """key, i, swap, rot of a numbered table, in line over each whole key."""

    def run(columns: dict, own: np.ndarray) -> dict:
        swap, rot = local_states(_matrix(columns[phase]))
        mine = np.flatnonzero(own)
        after = mine[-1] + 1  # the next block's first frame, as this block sees it
        ahead = [None] * len(mine)
        if after < len(own):
            ahead[-1] = [bool(swap[after]), bool(rot[after])]
        return {"swap": swap[own], "rot": rot[own], "_ahead": pa.array(ahead, pa.list_(pa.bool_()))}

    local = kept(in_blocks(frames, key, margin, block, run, [phase], {"swap": "boolean", "rot": "boolean", "_ahead": "array<boolean>"}))
    local = local.withColumn("_block", F.floor(F.col("i") / block))
    joints = local.groupBy(key, "_block").agg(*(F.min_by(c, "i").alias(f"_{c}") for c in ("swap", "rot")), F.max_by("_ahead", "i").alias("_ahead"))
    w = Window.partitionBy(key).orderBy("_block")  # one row a block
    differs = lambda c, k: F.coalesce((F.col(f"_{c}") != F.lag(F.col("_ahead")[k]).over(w)).cast("int"), F.lit(0))
    joints = joints.withColumns({"_ds": differs("swap", 0), "_dr": differs("rot", 1)})
    odd = lambda c: F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, 0)) % 2 == 1
    joints = joints.select(key, "_block", odd("_ds").alias("_os"), odd("_dr").alias("_or"))
    return local.join(joints, [key, "_block"]).select(key, "i", (F.col("swap") != F.col("_os")).alias("swap"), (F.col("rot") != F.col("_or")).alias("rot"))


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def _mean(values: Column) -> Column:
    """Mean of an array without nulls; null where it is empty."""
    return F.try_divide(F.aggregate(values, F.lit(0.0), lambda a, x: a + x), F.size(values))


def directions(phase: str) -> tuple[Column, Column]:
    """Real and imaginary part of the mean unit vector of a frame, absent samples as zeros."""
    part = lambda f: F.try_divide(F.aggregate(phase, F.lit(0.0), lambda a, x: a + F.when(_finite(x), f(x)).otherwise(0.0)), F.size(phase))
    return F.coalesce(part(F.cos), F.lit(0.0)), F.coalesce(part(F.sin), F.lit(0.0))


def profile_fit(amplitude: str, profile: Column) -> Column:
    """A frame's decibels, less their mean, against a profile."""
    part = lambda x, p, m: F.when(_finite(x), (x - m) * p).otherwise(0.0)
    # the mean is bound: inside the lambda it would be taken anew for each sample
    fit = let(_mean(F.filter(amplitude, _finite)), lambda m: total(F.transform(F.zip_with(amplitude, profile, lambda x, p: part(x, p, m)), lambda v: F.coalesce(v, F.lit(0.0)))))
    return F.coalesce(fit, F.lit(0.0))


def _profiles(medians: DataFrame, key: str) -> DataFrame:
    """key, profile from (key, _sc, median): less its mean, absent parts 0; null where it is too flat to tell sides apart."""
    found = medians.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_sc", "median"))).alias("_p"), F.avg("median").alias("_centre"), F.stddev_pop("median").alias("_spread"))  # one entry a subcarrier
    places = F.sequence(F.lit(0), F.element_at("_p", -1)["_sc"])
    full = let(F.map_from_entries("_p"), lambda p: F.transform(places, lambda k: F.coalesce(F.try_element_at(p, k) - F.col("_centre"), F.lit(0.0))))
    return found.select(key, F.when(F.col("_spread") >= LEAST_SPREAD, full).alias("profile"))


def band_medians(frames: DataFrame, key: str, values: str, part: int = PART) -> DataFrame:
    """key, _sc, median: exact medians at each place of the arrays of a numbered table; null and non-finite samples do not count.

    The frames of a key are dealt to parts of about ``part``. The median of all lies between the least and the greatest
    median of the parts, so the values below are counted and only the few between them are ordered; parts are drawn
    from all over the key, so that their medians lie close together. A key of one part is done at once.
    """
    number = F.when(F.col("n") > part, F.pmod(F.xxhash64("i"), F.ceil(F.col("n") / part))).otherwise(0)
    dealt = frames.select(key, number.alias("_part"), values)
    named = frames.schema[key].simpleString().replace(":", " ", 1)

    def middles(table: pa.Table) -> pa.Table:
        x = _matrix(table.column(values).combine_chunks())
        x = np.sort(np.where(np.isfinite(x), x, np.nan), axis=0)  # absent ones last
        count = np.isfinite(x).sum(0)
        at = np.flatnonzero(count)
        count = count[at]
        keys = table.column(key).take(pa.array(np.zeros(len(at), np.int64)))
        return pa.table({key: keys, "_sc": at.astype(np.int32), "_low": x[(count - 1) // 2, at], "_high": x[count // 2, at], "_n": count})

    parts = dealt.groupBy(key, "_part").applyInArrow(middles, f"{named}, _sc int, _low double, _high double, _n bigint")
    bounds = kept(parts.groupBy(key, "_sc").agg(F.min("_low").alias("_low"), F.max("_high").alias("_high"), F.sum("_n").alias("_all"), F.count("*").alias("_parts")))
    wide = (F.col("_parts") > 1) & (F.col("_low") < F.col("_high"))
    cells = frames.where(F.col("n") > part).select(key, F.posexplode(values).alias("_sc", "_v")).where(_finite(F.col("_v")))
    asked = F.broadcast(bounds.where(wide).drop("_parts"))  # of keys of several parts only
    between = cells.join(asked, [key, "_sc"]).where(F.col("_v") <= F.col("_high"))
    counts = between.groupBy(key, "_sc", "_all", F.when(F.col("_v") >= F.col("_low"), F.col("_v").cast("double")).alias("_v")).agg(F.count("*").alias("_n"))  # null: all below
    w = Window.partitionBy(key, "_sc").orderBy(F.asc_nulls_first("_v")).rowsBetween(Window.unboundedPreceding, 0)
    reached = lambda rank: F.min(F.when(F.col("_end") > F.floor(rank), F.col("_v")))
    found = counts.withColumn("_end", F.sum("_n").over(w)).groupBy(key, "_sc").agg(reached((F.col("_all") - 1) / 2).alias("_low"), reached(F.col("_all") / 2).alias("_high"))
    return bounds.where(~wide).select(key, "_sc", "_low", "_high").unionByName(found).select(key, "_sc", ((F.col("_low") + F.col("_high")) / 2).alias("median"))


def reference(frames: DataFrame, key: str, phase: str, amplitude: str, part: int = PART) -> DataFrame:
    """key, profile, re, im of a numbered table: median decibels across the band, and the direction in which most frames point.

    Measured on all frames of each key. A key whose band is too flat, or whose frames point in no direction clearly, has
    no row.
    """
    profiles = _profiles(band_medians(frames, key, amplitude, part), key)
    re, im = directions(phase)
    points = frames.select(key, re.alias("_re"), im.alias("_im")).groupBy(key).agg(F.sum("_re").alias("_re"), F.sum("_im").alias("_im"), F.sum(F.hypot("_re", "_im")).alias("_arc"))
    size = F.hypot("_re", "_im")
    points = points.where((F.col("_arc") > 0) & (size / F.col("_arc") >= LEAST_MAJORITY))
    return profiles.where("profile IS NOT NULL").join(points.select(key, (F.col("_re") / size).alias("re"), (F.col("_im") / size).alias("im")), key)


def _smooth(x: np.ndarray, width: int) -> np.ndarray:
    """Sums over ``width`` rows around each, fewer at the ends."""
    behind = (width - 1) // 2
    return _sums(x[:, None], width - 1 - behind, behind)[:, 0]


def _long(mask: np.ndarray, least: int) -> np.ndarray:
    """The runs of true of at least that length."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
    out = np.zeros(len(mask), bool)
    for a, b in zip(edges[::2], edges[1::2]):
        out[a:b] = b - a >= least
    return out


def _settled(states: DataFrame, key: str, native: bool, block: int) -> DataFrame:
    """Both states turned where the frames around contradict the reference: swap by the profile, then rot by the direction."""

    def run(c: dict, own: np.ndarray) -> dict:
        n = int(c["n"][0].as_py())
        width = min(STRETCH, n) if native else 1
        swap, rot = (c[k].to_numpy(zero_copy_only=False).astype(bool) for k in ("swap", "rot"))
        fit, re, im = (c[k].to_numpy(zero_copy_only=False) for k in ("_fit", "_along", "_across"))
        if n < 2:
            return {"swap": swap[own], "rot": rot[own]}
        swap = swap ^ (_smooth(np.where(swap, -fit, fit), width) < 0)
        along = np.where(swap, re - im, re + im)  # Re(v * conj(d)); a mirrored v has the other sign across
        rot = rot ^ (_smooth(np.where(rot, -along, along), width) < 0)
        return {"swap": swap[own], "rot": rot[own]}

    return in_blocks(states, key, STRETCH, block, run, ["swap", "rot", "_fit", "_along", "_across", "n"], {"swap": "boolean", "rot": "boolean"})


def _outvoted(states: DataFrame, key: str, flag: str, vote: str, block: int) -> DataFrame:
    """Of keys with at least two long runs' frames: long runs turned in which the smoothed votes are against."""

    def run(c: dict, own: np.ndarray) -> dict:
        n, vote_, now = int(c["n"][0].as_py()), c[vote].to_numpy(zero_copy_only=False), c[flag].to_numpy(zero_copy_only=False).astype(bool)
        against = _long(_smooth(vote_, min(STRETCH, max(3, n // 4))) < 0, LONG_RUN) if n >= 2 * LONG_RUN else np.zeros(len(now), bool)
        return {flag: (now ^ against)[own]}

    return in_blocks(states, key, STRETCH + 2 * LONG_RUN, block, run, [flag, vote, "n"], {flag: "boolean"})


def _replaced(states: DataFrame, key: str, flag: str, made: DataFrame) -> DataFrame:
    return states.drop(flag).join(made.select(key, "i", flag), [key, "i"])


def detect_states(frames: DataFrame, key: str, order: list[str], block_of: Column, phase: str, amplitude: str | None = None, references: DataFrame | None = None, native: bool = True, block: int = BLOCK) -> DataFrame:
    """``frames`` with i, n, swapped and rotated.

    ``block_of`` ascends with ``order`` and cuts keys for numbering (`frames.numbered`). With ``references`` (see
    `reference`) states are absolute; keys without one, and all keys where none are given, go by the majority of their
    frames. ``native`` says that rows are consecutive frames; else only the reference judges, each frame alone, and keys
    without one stay as they are. Null and non-finite samples do not count; a key of one frame, and frames without
    samples between none, keep what their neighbours have.
    """
    return numbered_states(kept(numbered(frames, key, order, block_of)), key, phase, amplitude, references, native, block)


def numbered_states(rows: DataFrame, key: str, phase: str, amplitude: str | None = None, references: DataFrame | None = None, native: bool = True, block: int = BLOCK) -> DataFrame:
    """`detect_states` of a table that is numbered and kept already."""
    samples = rows.select(key, "i", "n", phase, *([amplitude] if amplitude else []))
    re, im = directions(phase)
    if native:
        states = relative_states(samples, key, phase, block)
    else:
        states = samples.select(key, "i", F.lit(False).alias("swap"), F.lit(False).alias("rot"))
    scalars = samples.select(key, "i", "n", re.alias("_re"), im.alias("_im"), *([amplitude] if amplitude else []))
    found = []
    if references is not None:
        # samples meet the reference before they meet the states, so that only their scalars are shuffled
        fit = profile_fit(amplitude, F.col("profile")) if amplitude else F.lit(0.0)
        known = scalars.join(references, key).select(key, "i", "n", fit.alias("_fit"), (F.col("_re") * F.col("re")).alias("_along"), (F.col("_im") * F.col("im")).alias("_across"))
        found.append(_settled(states.join(known, [key, "i"]), key, native, block))
        scalars = scalars.join(references.select(key), key, "left_anti")
    states = states.join(scalars, [key, "i"])
    if native:
        found.append(_by_majority(states, key, amplitude, block))
    else:
        found.append(states.select(key, "i", "swap", "rot"))
    done = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    return rows.join(done.select(key, "i", F.col("swap").alias("swapped"), F.col("rot").alias("rotated")), [key, "i"])


def _by_majority(states: DataFrame, key: str, amplitude: str | None, block: int) -> DataFrame:
    """Long stretches against the key's own median profile and mean direction, twice each; then what most frames have is right."""
    for _ in range(2 if amplitude else 0):
        states = kept(states)
        turned = lambda x: F.when(F.col("swap"), -x).otherwise(x)
        cells = states.where(F.col("n") >= 2 * LONG_RUN).select(key, F.posexplode(amplitude).alias("_sc", "_v"), "swap").where(_finite(F.col("_v")))
        medians = quantiles(cells.select(F.struct(key, "_sc").alias("_k"), turned(F.col("_v")).alias("_v2")), "_k", "_v2", [0.5], 0.25)
        profiles = _profiles(medians.select(F.col(f"_k.{key}").alias(key), F.col("_k._sc").alias("_sc"), F.col("q0").alias("median")), key)
        voted = states.join(profiles, key, "left").withColumn("_vote", F.when(F.col("profile").isNotNull(), turned(profile_fit(amplitude, F.col("profile")))).otherwise(0.0))
        states = _replaced(states, key, "swap", _outvoted(voted, key, "swap", "_vote", block))
    states = states.select(key, "i", "n", "swap", "rot", "_re", "_im")  # decibels are not needed any more
    for _ in range(2):
        states = kept(states)
        sign = F.when(F.col("rot"), -1.0).otherwise(1.0)
        x, y = sign * F.col("_re"), sign * F.when(F.col("swap"), -F.col("_im")).otherwise(F.col("_im"))
        mean = states.groupBy(key).agg(F.sum(x).alias("_mx"), F.sum(y).alias("_my"))
        voted = states.join(mean, key).withColumn("_vote", x * F.col("_mx") + y * F.col("_my"))
        states = _replaced(states, key, "rot", _outvoted(voted, key, "rot", "_vote", block))
    states = kept(states.select(key, "i", "swap", "rot"))
    most = states.groupBy(key).agg(*((F.avg(F.col(c).cast("int")) > 0.5).alias(f"_m{c}") for c in ("swap", "rot")))
    return states.join(most, key).select(key, "i", *((F.col(c) != F.col(f"_m{c}")).alias(c) for c in ("swap", "rot")))


def corrected_phase(phase: str) -> Column:
    """The phase of frames with ``swapped`` and ``rotated`` undone, in (-pi, pi]; null where it is absent."""
    turned = lambda x: F.when(F.col("swapped"), -x).otherwise(x) + F.when(F.col("rotated"), math.pi).otherwise(0.0)
    return F.transform(phase, lambda x: F.when(_finite(x), F.atan2(F.sin(turned(x)), F.cos(turned(x)))))


def corrected_amplitude(amplitude: str) -> Column:
    """The decibels of frames with ``swapped`` undone."""
    return F.transform(amplitude, lambda x: F.when(F.col("swapped"), -x).otherwise(x))
