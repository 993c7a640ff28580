"""Fitting of the small models: balanced logistic weights on imputed, scaled inputs, held-out groups and thresholds.

Rows stay where they are: each pass adds up gradients and curvatures task by task, for all fits at once, and a handful
of Newton steps reach the optimum's last digits, where a first-order method would read the rows some fifty times a fit.
What comes back is a ``Logistic`` of plain numbers, whose score is an expression again.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.models import Logistic
from .frames import quantiles
from .joins import confusion, kept

# Windows that a reference of labelled rows needs, low shares of a reference without labels, share of empty rows below a threshold.
LEAST_REFERENCE, LOW_SHARES, SPECIFICITY = 10, (0.05, 0.25), 0.9
#: Most passes over the rows of a fit; about eight are needed.
PASSES = 60


def _known(c: Column) -> Column:
    return F.when(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")), c.cast("double"))


def _long(df: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """keys, name, v: one row for each known value."""
    cells = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), _known(F.col(n)).alias("v")) for n in names)))
    return df.select(*keys, cells.alias("_c")).select(*keys, "_c.*").where("v IS NOT NULL")


def long_quantiles(long: DataFrame, shares: list[float]) -> DataFrame:
    """k, n, q0, q1, ...: exact quantiles of ``v`` for each ``k``, in slices of a 1,024th of the range of the k's values."""
    width = long.groupBy("k").agg(F.min("v").alias("_low"), (F.max("v") - F.min("v")).alias("_span"))
    width = width.select("k", "_low", F.when(F.col("_span") > 0, F.col("_span")).otherwise(1.0).alias("_span"))
    cut = F.floor((F.col("v") - F.col("_low")) / F.col("_span") * 1024)
    # the values themselves are ordered: scaled and scaled back, a threshold would come out beside the value it is
    return quantiles(long.join(width, "k"), "k", "v", shares, cut).drop("mean")


def _summed(rows: DataFrame, size: int, part) -> np.ndarray:
    """What ``part`` makes of batches of (x, y, models), added up by tasks and then by entry; the driver gets ``size`` numbers."""

    def sums(batches):
        total = np.zeros(size)
        for batch in batches:
            n = batch.num_rows
            if n:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
                models = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
                total += part(x, batch.column(1).to_numpy(), models)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], names=["at", "v"])

    out = np.zeros(size)
    for r in rows.mapInArrow(sums, "at bigint, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():
        out[r["at"]] = r["v"]
    return out


def fits(df: DataFrame, names: list[str], label: str, teaches: list[Column], c: float = 1.0, scaled: bool = True) -> list[Logistic]:
    """One fit for each condition in ``teaches``, of the rows that meet it; all fits share their passes over the rows.

    Of ``label`` (0 or 1; other rows do not count) both values weigh the same; the penalty on the sum of losses is
    |w|^2 / (2 c). With ``scaled``, inputs are imputed by their medians (0 of an input that is never known) and
    standardised (a deviation of 0 counts as 1). Without, rows with an unknown input do not count. Of one label alone,
    or of no rows, a fit is the constant of what there is (0.5 of no rows).
    """
    known = [_known(F.col(n)) for n in names]
    df = df.where(F.col(label).isin(0, 1))
    if not scaled:
        df = df.where(reduce(Column.__and__, (x.isNotNull() for x in known)))
    x = F.array(*(F.coalesce(v, F.lit(float("nan"))) for v in known))
    rows = kept(df.select(x.alias("x"), F.col(label).cast("double").alias("y"), F.array(*(F.coalesce(t, F.lit(False)).cast("double") for t in teaches)).alias("models")))
    g, m = len(teaches), len(names)
    fill = np.zeros((g, m))
    if scaled:
        of = F.explode(F.filter(F.sequence(F.lit(0), F.lit(g - 1)), lambda k: F.get("models", k) > 0))
        long = rows.select(of.alias("_m"), "x").select("_m", F.posexplode("x").alias("_n", "v"))
        for r in long_quantiles(long.where("NOT isnan(v)").select(F.struct("_m", "_n").alias("k"), "v"), [0.5]).collect():  # one row a fit and name
            fill[r["k"]["_m"], r["k"]["_n"]] = r["q0"]

    def moments(x, y, models):
        parts = []
        for k in range(g):
            on = models[:, k] > 0
            d = np.where(np.isnan(x[on]), 0.0, x[on] - fill[k])
            parts += [[on.sum(), y[on].sum()], d.sum(0), (d * d).sum(0)]
        return np.concatenate(parts)

    found = _summed(rows, g * (2 + 2 * m), moments).reshape(g, -1)
    n, ones = found[:, 0], found[:, 1]
    mean, scale = np.zeros((g, m)), np.ones((g, m))
    if scaled:
        per = np.maximum(n, 1)[:, None]
        away = found[:, 2 : 2 + m] / per
        mean, spread = fill + away, np.sqrt(np.maximum(found[:, 2 + m :] / per - away**2, 0))
        scale = np.where(spread > 1e-12 * np.maximum(np.abs(mean), 1e-300), spread, 1.0)
    open_ = [k for k in range(g) if 0 < ones[k] < n[k]]
    weigh = np.stack([n / (2 * np.maximum(n - ones, 1)), n / (2 * np.maximum(ones, 1))], 1)
    best = _optima(rows, fill, mean, scale, weigh, open_, c)
    out = []
    for k in range(g):
        w = best[k] if k in open_ else np.r_[0.0 if not n[k] else 40.0 if ones[k] else -40.0, np.zeros(m)]
        out.append(Logistic(tuple(names), tuple(fill[k].tolist()) if scaled else None, tuple(mean[k].tolist()), tuple(scale[k].tolist()), tuple(w[1:].tolist()), float(w[0])))
    return out


def _optima(rows: DataFrame, fill: np.ndarray, mean: np.ndarray, scale: np.ndarray, weigh: np.ndarray, fits: list[int], c: float) -> np.ndarray:
    """Weights (intercept first) of the penalised optima: Newton steps, halved where a loss would grow; each pass serves all fits still open."""
    g, m = fill.shape[0], fill.shape[1] + 1
    size, penalty = 1 + m + m * m, np.r_[0.0, np.full(m - 1, 1 / c)]
    best, step, loss = np.zeros((g, m)), np.zeros((g, m)), np.full(g, np.inf)
    left = list(fits)
    for _ in range(PASSES):
        if not left:
            return best
        trial, now = best + step, list(left)

        def curvature(x, y, models, trial=trial, now=now):
            parts = []
            for k in now:
                on = models[:, k] > 0
                z = np.c_[np.ones(on.sum()), (np.where(np.isnan(x[on]), fill[k], x[on]) - mean[k]) / scale[k]]
                at, t = z @ trial[k], y[on]
                w, p = weigh[k][t.astype(int)], 1 / (1 + np.exp(-np.clip(at, -700, 700)))
                parts += [[(w * (np.logaddexp(0, at) - t * at)).sum()], z.T @ (w * (t - p)), ((z.T * (w * p * (1 - p))) @ z).ravel()]
            return np.concatenate(parts)

        for k, v in zip(now, _summed(rows, size * len(now), curvature).reshape(len(now), size)):
            value = v[0] + (penalty * trial[k] ** 2).sum() / 2
            if value > loss[k] * (1 + 1e-12):
                step[k] /= 2
            else:
                best[k], loss[k] = trial[k], value
                step[k] = np.linalg.lstsq(v[1 + m :].reshape(m, m) + np.diag(penalty), v[1 : 1 + m] - penalty * trial[k], rcond=None)[0]
            if np.abs(step[k]).max() <= 1e-11 * max(1.0, np.abs(best[k]).max()):
                left.remove(k)
    return best


def fit_logistic(df: DataFrame, names: list[str], label: str, c: float = 1.0, scaled: bool = True) -> Logistic:
    """The one fit of all rows; see ``fits``."""
    return fits(df, names, label, [F.lit(True)], c, scaled)[0]


def held_out(df: DataFrame, group: str, groups: list, names: list[str], label: str, c: float = 1.0, unseen: list = ()) -> DataFrame:
    """``df``'s rows of ``groups`` and ``unseen`` with probability and predicted, each by a model fitted without the row's group.

    Rows of a group are scored by the fit on all other ``groups``; rows of ``unseen`` groups by the fit on all ``groups``
    and never teach. Both lists are stated by the caller, and each entry is one fit.
    """
    every, room = [*groups, *unseen], F.col(group)
    models = fits(df, names, label, [room.isin(list(groups)) & (room != g) for g in every], c)
    inputs = {n: _known(F.col(n)) for n in names}
    p = F.coalesce(*(F.when(room == g, model.probability(inputs)) for g, model in zip(every, models)))
    return df.where(room.isin(every)).withColumn("probability", p).withColumn("predicted", (F.col("probability") > 0.5).cast("int"))


def quality(scored: DataFrame, label: str, *keys: str) -> DataFrame:
    """keys, n, correct, accuracy, precision, recall, f1 of ``predicted`` against ``label``; shares without rows are null."""
    n = lambda a, b: F.count(F.when((F.col("predicted") == a) & (F.col(label) == b), 1))
    c = scored.groupBy(*keys).agg(n(1, 1).alias("_tp"), n(1, 0).alias("_fp"), n(0, 1).alias("_fn"), n(0, 0).alias("_tn"))
    tp, fp, fn, tn = (F.col(x) for x in ("_tp", "_fp", "_fn", "_tn"))
    every = tp + fp + fn + tn
    return c.select(*keys, every.alias("n"), (tp + tn).alias("correct"), F.try_divide(tp + tn, every).alias("accuracy"), F.try_divide(tp, tp + fp).alias("precision"), F.try_divide(tp, tp + fn).alias("recall"), F.when(tp > 0, F.try_divide(2 * tp, 2 * tp + fp + fn)).alias("f1"))


def normalised(df: DataFrame, key: str, names: list[str], empty: Column | None = None) -> DataFrame:
    """``df`` with z_<name>: each name against its own key's reference, null where unknown.

    With ``empty``, the reference is the median and deviation of the key's known values in empty rows, of all its rows
    where fewer than ten are empty. Without, it is the key's 5th percentile and the way from there to the 25th.
    A scale is at least 1e-30; a key without known values has null in z_<name>.
    """
    named = df if empty is None else df.withColumn("_empty", F.coalesce(empty, F.lit(False)))
    keys = [key] if empty is None else [key, "_empty"]
    long = _long(named, keys, names)
    if empty is None:
        q = long_quantiles(long.select(F.struct(key, "name").alias("k"), "v"), list(LOW_SHARES))
        found = q.select("k.*", F.col("q0").alias("_centre"), (F.col("q1") - F.col("q0")).alias("_scale"))
    else:
        of = long.select(F.explode(F.array(F.struct(key, "name", F.lit(False).alias("only")), F.when(F.col("_empty"), F.struct(key, "name", F.lit(True).alias("only"))))).alias("k"), "v").where("k IS NOT NULL")
        both = long_quantiles(of, [0.5]).join(of.groupBy("k").agg(F.stddev_pop("v").alias("_s")), "k").where(f"NOT k.only OR n >= {LEAST_REFERENCE}")
        best = both.groupBy(F.col(f"k.{key}").alias(key), F.col("k.name").alias("name")).agg(F.max_by(F.struct("q0", "_s"), F.col("k.only")).alias("_r"))
        found = best.select(key, "name", F.col("_r.q0").alias("_centre"), F.col("_r._s").alias("_scale"))
    wide = found.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("name", F.struct("_centre", "_scale")))).alias("_refs"))  # one entry a name
    z = lambda n: (_known(F.col(n)) - F.try_element_at("_refs", F.lit(n))["_centre"]) / F.greatest(F.try_element_at("_refs", F.lit(n))["_scale"], F.lit(1e-30))
    return named.join(wide, key, "left").withColumns({f"z_{n}": z(n) for n in names}).drop("_refs", "_empty")


def fit_motion(windows: DataFrame, key: str, names: list[str], label: str, labelled: bool, specificity: float = SPECIFICITY, c: float = 1.0) -> tuple[Logistic, float]:
    """Weights of windows against their own key's reference, pooled, and the threshold that ``specificity`` of the empty windows stay under.

    Windows without a label (null) count for a reference without labels only. No empty windows: the threshold is null.
    """
    return fit_normalised(kept(labelled_windows(windows, key, names, label, labelled)), names, label, specificity, c)


def labelled_windows(windows: DataFrame, key: str, names: list[str], label: str, labelled: bool) -> DataFrame:
    """key, label, names: the windows that have a label, against their own key's reference.

    Deviations add up in the order in which tasks end, so whoever fits and judges keeps these rows: measured twice, the
    window that the threshold lies on could fall on either side of it.
    """
    z = normalised(windows, key, names, (F.col(label) == 0) if labelled else None)
    return z.where(F.col(label).isin(0, 1)).select(key, label, *(F.col(f"z_{n}").alias(n) for n in names))


def fit_normalised(z: DataFrame, names: list[str], label: str, specificity: float = SPECIFICITY, c: float = 1.0) -> tuple[Logistic, float]:
    """``fit_motion`` of rows of ``labelled_windows``."""
    model = fit_logistic(z, names, label, c, scaled=False)
    logits = z.where(F.col(label) == 0).select(F.lit(0).alias("k"), model.logit({n: F.col(n) for n in names}).alias("v")).where("v IS NOT NULL")
    at = long_quantiles(logits, [specificity]).first()
    return model, at.q0 if at else None


def judged(windows: DataFrame, key: str, names: list[str], label: str, labelled: bool, model: Logistic, threshold: float) -> DataFrame:
    """key, recall, specificity, balanced of a fitted motion model over each key's windows; unknown windows are predicted 0."""
    return judged_normalised(labelled_windows(windows, key, names, label, labelled), key, names, label, model, threshold)


def judged_normalised(z: DataFrame, key: str, names: list[str], label: str, model: Logistic, threshold: float) -> DataFrame:
    """``judged`` of rows of ``labelled_windows``."""
    over = F.coalesce(model.logit({n: F.col(n) for n in names}) > threshold, F.lit(False)).cast("int")
    c = confusion(z, F.col(label), over, key)
    return c.select(key, "recall", "specificity", ((F.col("recall") + F.col("specificity")) / 2).alias("balanced"))
