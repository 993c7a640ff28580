"""Functions of complex series kept as two arrays (real and imaginary part), native and evaluated in place.

A series is one subcarrier's samples in one window or unit, which bounds its length.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import centred, detrend, dot, let, total


def lits(values) -> Column:
    """An array of constants."""
    return F.array(*(F.lit(float(v)) for v in values))


def table(rows) -> Column:
    """An array of arrays of constants."""
    return F.array(*(lits(r) for r in rows))


def bound(re: Column, im: Column, body) -> Column:
    """body(re, im) with both computed once."""
    return let(F.struct(re.alias("re"), im.alias("im")), lambda z: body(z["re"], z["im"]))


def power(re: Column, im: Column) -> Column:
    return dot(re, re) + dot(im, im)


def divide(a: Column, b: Column, c: Column, d: Column) -> tuple[Column, Column]:
    """(a + ib) / (c + id), null where the divisor is zero."""
    size = F.nullif(c * c + d * d, F.lit(0.0))
    return (a * c + b * d) / size, (b * c - a * d) / size


def lag1(re: Column, im: Column) -> Column:
    """1 - mean |step|^2 / (2 variance) of a complex series; 0 for a silent one."""
    step = lambda x: F.zip_with(F.slice(x, 2, F.size(x) - 1), F.slice(x, 1, F.size(x) - 1), lambda a, b: a - b)
    var = bound(centred(re), centred(im), power) / F.size(re)
    moved = bound(step(re), step(im), power) / (F.size(re) - 1)
    return F.coalesce(F.try_divide(-moved, 2 * var) + 1, F.lit(0.0))


def dft_basis(bins, n: int, size: int | None = None, taper=None) -> tuple[Column, Column]:
    """Cosines and sines of the given bins of a ``size``-point transform over n samples, tapered."""
    t, w = np.arange(n), np.ones(n) if taper is None else np.asarray(taper)
    angle = 2 * np.pi * np.outer(list(bins), t) / (size or n)
    return table(np.cos(angle) * w), table(np.sin(angle) * w)


def dft(re: Column, im: Column, bins, n: int, size: int | None = None, taper=None) -> Column:
    """(re, im) of the given bins, in their order."""
    cos, sin = dft_basis(bins, n, size, taper)
    return bound(re, im, lambda x, y: F.zip_with(cos, sin, lambda c, s: F.struct((dot(x, c) + dot(y, s)).alias("re"), (dot(y, c) - dot(x, s)).alias("im"))))


def hann(n: int) -> np.ndarray:
    return np.hanning(n)


def blackman_harris(n: int) -> np.ndarray:
    """The four-term window; its coefficients are fixed values."""
    x = 2 * np.pi * np.arange(n) / (n - 1)
    return 0.35875 - 0.48829 * np.cos(x) + 0.14128 * np.cos(2 * x) - 0.01168 * np.cos(3 * x)


def impulse_response(re: Column, im: Column, n: int) -> Column:
    """Magnitudes of the inverse transform across n subcarriers (null counts as 0), the zero delay in the middle."""
    zero = lambda x: F.transform(x, lambda v: F.coalesce(v, F.lit(0.0)))
    cos, sin = dft_basis([(p - n // 2) % n for p in range(n)], n)
    return bound(zero(re), zero(im), lambda x, y: F.zip_with(cos, sin, lambda c, s: F.sqrt((dot(x, c) - dot(y, s)) ** 2 + (dot(x, s) + dot(y, c)) ** 2) / n))


def lag_sums(re: Column, im: Column, most: int) -> Column:
    """Re sum x(t) conj x(t + lag) for each lag up to ``most``."""
    part = lambda x, k: dot(F.slice(x, F.lit(1), F.size(x) - k), F.slice(x, k + 1, F.size(x) - k))
    return bound(re, im, lambda x, y: F.transform(F.sequence(F.lit(0), F.lit(most)), lambda k: part(x, k) + part(y, k)))


def without_line(re: Column, im: Column) -> tuple[Column, Column]:
    return detrend(re), detrend(im)


def extrema(c: Column, first: int, sign: int) -> Column:
    """(i, at, height) of the interior local maxima (sign 1) or minima (-1) from ``first`` on, refined by a parabola."""
    return let(c, lambda y: _extrema(y, first, sign))


def _extrema(c: Column, first: int, sign: int) -> Column:
    at = lambda i: F.get(c, i)
    inside = F.filter(F.sequence(F.lit(max(first, 1)), F.size(c) - 2), lambda i: (sign * at(i) > sign * at(i - 1)) & (sign * at(i) >= sign * at(i + 1)))

    def refined(i):
        shift = F.coalesce(F.greatest(F.lit(-0.5), F.least(F.lit(0.5), F.try_divide(0.5 * (at(i - 1) - at(i + 1)), at(i - 1) - 2 * at(i) + at(i + 1)))), F.lit(0.0))
        return F.struct(i.alias("i"), (i + shift).alias("at"), (at(i) - 0.25 * (at(i - 1) - at(i + 1)) * shift).alias("height"))

    return F.transform(inside, refined)


def first_peak(r: Column, low: int, high: int) -> Column:
    """(lag, lag_refined, height) of the first local maximum with low <= lag <= high; refined without the biased taper."""
    return let(r, lambda y: _first_peak(y, low, high))


def _first_peak(r: Column, low: int, high: int) -> Column:
    n, at = F.size(r), lambda i: F.get(r, i)
    hit = F.get(F.filter(F.sequence(F.lit(low), F.lit(high)), lambda k: (at(k) > at(k - 1)) & (at(k) >= at(k + 1))), F.lit(0))
    flat = lambda k: at(k) / (1 - k / n)
    a, b, c = flat(hit - 1), flat(hit), flat(hit + 1)
    bend = a - 2 * b + c
    refined = hit + F.when(bend < 0, 0.5 * (a - c) / bend).otherwise(0.0)
    return F.struct(hit.alias("lag"), refined.alias("lag_refined"), at(hit).alias("height"))


def fit_weights(window: int, order: int) -> np.ndarray:
    """Row p: the weights that give, at place p, the polynomial fitted to ``window`` samples."""
    v = np.vander(np.arange(window, dtype=float) - window // 2, order + 1, increasing=True)
    return v @ np.linalg.pinv(v)


def savgol(x: Column, window: int, order: int) -> Column:
    """Savitzky-Golay smoothing; the ends take the polynomial of the first and the last window. Shorter series stay."""
    rows, half = table(fit_weights(window, order)), window // 2
    start = lambda y, i: F.greatest(F.lit(0), F.least(i - half, F.size(y) - window))
    smooth = lambda y: F.transform(y, lambda v, i: dot(F.slice(y, start(y, i) + 1, F.lit(window)), F.get(rows, i - start(y, i))))
    return let(x, lambda y: F.when(F.size(y) >= window, smooth(y)).otherwise(y))


def projected(re: Column, im: Column, bins, n: int, size: int, angles: int) -> Column:
    """(bnr, k): of ``angles`` directions in half a turn, the one whose largest in-band bin holds most of the one-sided energy."""
    return bound(centred(re), centred(im), lambda x, y: _projected(x, y, bins, n, size, angles))


def _projected(x: Column, y: Column, bins, n: int, size: int, angles: int) -> Column:
    zero = F.transform(x, lambda v: v * 0)
    f = F.zip_with(dft(x, zero, bins, n, size), dft(y, zero, bins, n, size), lambda a, b: F.struct((a["re"] ** 2 + a["im"] ** 2).alias("aa"), (b["re"] ** 2 + b["im"] ** 2).alias("bb"), (a["re"] * b["re"] + a["im"] * b["im"]).alias("ab")))
    turns = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(math.cos(math.pi * k / angles)).alias("c"), F.lit(math.sin(math.pi * k / angles)).alias("s")) for k in range(angles)))

    def share(z, t):
        c, s = t["c"], t["s"]
        peak = F.array_max(F.transform(z["f"], lambda e: e["aa"] * c * c + e["bb"] * s * s + 2 * e["ab"] * c * s))
        return F.struct(F.coalesce(F.try_divide(peak, size * (z["xx"] * c * c + z["yy"] * s * s + 2 * z["xy"] * c * s) / 2), F.lit(0.0)).alias("bnr"), (-t["k"]).alias("minus"))

    known = F.struct(f.alias("f"), dot(x, x).alias("xx"), dot(y, y).alias("yy"), dot(x, y).alias("xy"))
    best = let(known, lambda z: F.array_max(F.transform(turns, lambda t: share(z, t))))
    return let(best, lambda b: F.struct(b["bnr"].alias("bnr"), (-b["minus"]).alias("k")))


def along(re: Column, im: Column, angle: Column) -> Column:
    """The centred series seen from a direction."""
    return F.zip_with(centred(re), centred(im), lambda a, b: a * F.cos(angle) + b * F.sin(angle))


def relative_steps(a_re: Column, a_im: Column, b_re: Column, b_im: Column) -> Column:
    """|a - b| / (|a| + |b|) of complex values."""
    size = lambda x, y: F.sqrt(x * x + y * y)
    return F.try_divide(size(a_re - b_re, a_im - b_im), size(a_re, a_im) + size(b_re, b_im))


def cubic_middle(x: Column, i: int) -> Column:
    """The cubic through the two neighbours on either side, half-way: what stands in for a pilot."""
    p, q, r, s = (F.get(x, F.lit(i + k)) for k in (-2, -1, 1, 2))
    a0 = s - r - p + q
    return a0 * 0.125 + (p - q - a0) * 0.25 + (r - p) * 0.5 + q


def layer_norm(x: Column, eps: float = 1e-5) -> Column:
    """Values minus their mean over their deviation."""
    return let(centred(x), lambda c: let(F.sqrt(dot(c, c) / F.size(c) + eps), lambda d: F.transform(c, lambda v: v / d)))


def mean_of(x: Column) -> Column:
    """The mean, null for none."""
    return let(x, lambda y: F.when(F.size(y) > 0, total(y) / F.size(y)))
