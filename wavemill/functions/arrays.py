"""Functions of arrays (one value a subcarrier, or one a sample): all native expressions, evaluated in place."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """body(value) with the value computed once: inside a lambda a plain expression would be computed for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def mean(x: Column) -> Column:
    return total(x) / F.size(x)


def doubles(x: Column) -> Column:
    return F.transform(x, lambda v: v.cast("double"))


def dot(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: a * b))


def centred(x: Column) -> Column:
    return let(x, lambda y: let(mean(y), lambda m: F.transform(y, lambda v: v - m)))


def line(x: Column) -> tuple[Column, Column]:
    """Slope and intercept of the least-squares line over the index."""
    n = F.size(x)
    sx = total(x)
    six = total(F.transform(x, lambda v, i: v * i))
    si, sii = n * (n - 1) / 2, n * (n - 1) * (2 * n - 1) / 6
    slope = (n * six - si * sx) / (n * sii - si * si)
    return slope, (sx - slope * si) / n


def detrend(x: Column) -> Column:
    def straight(y):
        slope, intercept = line(y)
        return let(F.struct(slope.alias("a"), intercept.alias("b")), lambda f: F.transform(y, lambda v, i: v - (f["a"] * i + f["b"])))

    return let(x, straight)


def acf(x: Column, lag: int) -> Column:
    """Biased autocorrelation at a lag of the centred values, over lag 0; 0 where that is 0."""
    def ratio(c):
        num = dot(F.slice(c, 1, F.size(c) - lag), F.slice(c, lag + 1, F.size(c) - lag))
        return F.coalesce(F.try_divide(num, dot(c, c)), F.lit(0.0))

    return let(centred(x), ratio)


def lag1_noise(x: Column) -> Column:
    """1 - mean squared step / (2 variance): near 1 for smooth series, near 0 for noise."""
    step = F.zip_with(F.slice(x, 2, F.size(x) - 1), F.slice(x, 1, F.size(x) - 1), lambda a, b: (a - b) * (a - b))
    var = let(centred(x), lambda c: dot(c, c)) / F.size(x)
    return F.when(var > 0, 1 - mean(step) / (2 * var)).otherwise(0.0)


def dft_powers(x: Column, bins, n: int) -> Column:
    """Powers of DFT bins of n values, in one pass over a basis for each bin."""
    row = lambda f, k: F.array(*(F.lit(f(2 * math.pi * k * i / n)) for i in range(n)))
    basis = F.array(*(F.struct(row(math.cos, k).alias("c"), row(math.sin, k).alias("s")) for k in bins))
    one = lambda y, b: dot(y, b["c"]) ** 2 + dot(y, b["s"]) ** 2
    return let(x, lambda y: F.transform(basis, lambda b: one(y, b)))


def unwrap(x: Column) -> Column:
    """Phases with whole turns taken out of their steps: the turns are counted first and then summed up to each place."""
    turn = 2 * math.pi
    turns = lambda y: F.transform(y, lambda v, i: F.when(i > 0, F.rint((v - F.get(y, i - 1)) / turn)).otherwise(0.0))

    def less(y, t):
        at = F.filter(F.transform(t, lambda k, i: F.struct(i.alias("i"), k.alias("k"))), lambda s: s["k"] != 0)  # few places turn
        return let(at, lambda w: F.transform(y, lambda v, i: v - turn * F.aggregate(w, F.lit(0.0), lambda a, s: a + F.when(s["i"] <= i, s["k"]).otherwise(0.0))))

    return let(x, lambda y: let(turns(y), lambda t: less(y, t)))


def box_mean(x: Column, k: int) -> Column:
    """Means of k (odd) neighbours; near the ends the window is shifted, not shortened."""
    k = k + 1 - k % 2
    n = F.size(x)
    start = lambda i: F.greatest(F.lit(0), F.least(i - k // 2, n - k))
    return F.transform(x, lambda v, i: mean(F.slice(x, start(i) + 1, F.lit(k))))


def step_ratio(a: Column, b: Column) -> Column:
    """Relative steps (b - a) / (|a| + |b|), null where both are zero."""
    return F.zip_with(a, b, lambda p, q: F.when(F.abs(p) + F.abs(q) > 0, (q - p) / (F.abs(p) + F.abs(q))))


def decibels(x: Column, floor: float = 1e-6) -> Column:
    return 20 * F.log10(F.greatest(x, F.lit(floor)))


def group_means(x: Column, w: Column, n: int, groups: int) -> Column:
    """Weighted means of ``groups`` contiguous parts of n values."""
    edges = [n * g // groups for g in range(groups + 1)]
    part = lambda y, a, b: F.slice(y, a + 1, b - a)
    return F.array(*(dot(part(x, a, b), part(w, a, b)) / total(part(w, a, b)) for a, b in zip(edges, edges[1:])))


def hampel(x: Column, half: int, nsig: float) -> Column:
    """Values further than nsig robust deviations from the median of 2 * half + 1 neighbours become that median."""
    def median(y):
        return let(F.array_sort(y), lambda s: (F.get(s, F.floor((F.size(s) - 1) / 2).cast("int")) + F.get(s, F.floor(F.size(s) / 2).cast("int"))) / 2)

    def one(v, near, mid):
        spread = median(F.transform(near, lambda y: F.abs(y - mid)))
        return F.when(F.abs(v - mid) > nsig * 1.4826 * spread, mid).otherwise(v)

    def around(y, i):
        return F.transform(F.sequence(i - half, i + half), lambda j: F.get(y, F.greatest(F.lit(0), F.least(j, F.size(y) - 1))))

    # neighbours and their median are bound: the lambda of the spread would compute them for each neighbour
    return let(x, lambda y: F.transform(y, lambda v, i: let(around(y, i), lambda near: let(median(near), lambda mid: one(v, near, mid)))))


def db_to_unit(db: Column) -> Column:
    """tanh(dB ln 10 / 40): a step in dB as a relative step."""
    return F.tanh(db * (math.log(10) / 40))


def unit_to_db(d: Column) -> Column:
    return F.atanh(F.greatest(F.lit(-1 + 1e-12), F.least(F.lit(1 - 1e-12), d))) * (40 / math.log(10))


def finite(x: Column) -> Column:
    """Null for NaN and infinities."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)
