"""Scoring of small models as SQL expressions, and their evaluation by group."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Logistic:
    """Impute, standardise, weigh, squash. ``fill`` None: a missing input gives a null score."""

    names: tuple[str, ...]
    fill: tuple[float, ...] | None
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    coef: tuple[float, ...]
    intercept: float

    def logit(self, inputs: dict[str, Column]) -> Column:
        z = F.lit(self.intercept)
        for k, name in enumerate(self.names):
            x = F.when(~F.isnan(inputs[name]), inputs[name])
            x = F.coalesce(x, F.lit(self.fill[k])) if self.fill else x
            z = z + self.coef[k] * (x - self.mean[k]) / self.scale[k]
        return z

    def probability(self, inputs: dict[str, Column]) -> Column:
        return 1 / (1 + F.exp(-self.logit(inputs)))

    def contributions(self, inputs: dict[str, Column]) -> dict[str, Column]:
        """What each input adds to the logit."""
        return {name: self.coef[k] * ((F.coalesce(inputs[name], F.lit(self.fill[k])) if self.fill else inputs[name]) - self.mean[k]) / self.scale[k] for k, name in enumerate(self.names)}


# The published coefficients of the one-minute presence model (ten inputs).
ONE_MINUTE = Logistic(
    ("A_slope3", "A_r025_2", "A_r5_2", "A_p90", "F_pkmax", "F_pkmed", "F_run", "F_rpm_sd", "C3_revisit", "C3xRun_diff"),
    (0.0604191, 0.8842, 1.05259, 0.03098, 0.304242, 0.097725, 1, 1.74699, 0.0461517, 0.0298995),
    (0.112305, 0.812451, 1.09822, 0.0569722, 0.321849, 0.121508, 3.56646, 1.97063, 0.127434, 0.190408),
    (0.124958, 0.199671, 0.132516, 0.0673569, 0.0993294, 0.0832089, 7.16485, 1.29628, 0.199536, 0.495036),
    (0.398483, -1.59421, 0.68567, 1.863, 0.822525, 1.89851, 0.575673, 0.127644, -2.62478, 0.577191),
    -0.224378,
)
# The published coefficients of P(occupied), seven inputs.
OCCUPIED = Logistic(
    ("log_step_norm_own", "acf_phase_p90", "acf_amp_median", "breath_run20", "breath_peak10", "breath_run", "ev_drift_p90"),
    None,
    (0.722792, 0.263424, 0.136982, 5.510497, 0.317754, 4.485083, 0.378312),
    (0.832182, 0.29003, 0.21645, 10.793192, 0.112859, 8.754102, 0.331219),
    (0.927663, 1.260349, -0.381335, 1.869359, 2.057399, 0.807373, 0.878329),
    -0.029666,
)
# The published coefficients of P(human), three inputs.
HUMAN = Logistic(
    ("breath_peak10", "lam_share_median", "delay_spread"),
    None,
    (0.398829, 0.578781, 40.938499),
    (0.103143, 0.161842, 39.289416),
    (3.496855, 2.33978, 3.62858),
    6.539183,
)


def mlp(inputs: list[Column], w1: list[list[float]], b1: list[float], w2: list[float], b2: float) -> Column:
    """One tanh layer and one output: the logit."""
    hidden = []
    for j, b in enumerate(b1):
        z = F.lit(b)
        for x, row in zip(inputs, w1):
            z = z + row[j] * x
        hidden.append(F.tanh(z))
    out = F.lit(b2)
    for h, w in zip(hidden, w2):
        out = out + w * h
    return out


def auc(df: DataFrame, key: str, score: str, label: str) -> DataFrame:
    """key, auc by ranks, ties shared. Scores are first counted by value, so a group is as large as its distinct scores."""
    by = df.groupBy(key, score).agg(F.sum((F.col(label) == 1).cast("bigint")).alias("p"), F.sum((F.col(label) == 0).cast("bigint")).alias("n"))
    below = F.coalesce(F.sum("n").over(Window.partitionBy(key).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    by = by.withColumn("w", F.col("p") * (below + F.col("n") / 2))
    return by.groupBy(key).agg(F.try_divide(F.sum("w"), F.sum("p") * F.sum("n")).alias("auc"))


def standardised(df: DataFrame, columns: list[str], *keys: str) -> DataFrame:
    """``df`` with z_<column>: medians for the missing, then minus mean over deviation, by key."""
    from ..operators.frames import medians

    of = list(keys) or ["_all"]
    rows, filled = df.withColumn("_all", F.lit(0)), df.withColumn("_all", F.lit(0))
    for c in columns:
        width = rows.agg(F.try_divide(F.max(c) - F.min(c), F.lit(1024.0))).first()[0]
        found = medians(rows, of, c, f"_m_{c}", width or 1.0)
        filled = filled.join(found if keys else F.broadcast(found), of, "left")  # one row where all rows are one group
    filled = filled.drop("_all")
    filled = filled.withColumns({c: F.coalesce(c, f"_m_{c}") for c in columns})
    stats = [f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("a", F.avg), ("s", F.stddev_pop))]
    out = filled.join(filled.groupBy(*keys).agg(*stats), list(keys)) if keys else filled.crossJoin(F.broadcast(filled.agg(*stats)))
    out = out.withColumns({f"z_{c}": F.try_divide(F.col(c) - F.col(f"_a_{c}"), F.col(f"_s_{c}")) for c in columns})
    return out.drop(*(f"_{n}_{c}" for c in columns for n in "mas"))


def leave_one_out(df: DataFrame, key: str, value: str) -> DataFrame:
    """key, others: the mean of all other keys' values, from sums alone."""
    s = df.groupBy(key).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    total = F.broadcast(s.agg(F.sum("s").alias("ts"), F.sum("n").alias("tn")))  # one row
    return s.crossJoin(total).select(key, F.try_divide(F.col("ts") - F.col("s"), F.col("tn") - F.col("n")).alias("others"))
