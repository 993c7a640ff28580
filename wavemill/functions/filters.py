"""Zero-phase Butterworth filters of series, in Arrow functions: a recursion over samples, for all series of a batch at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def butterworth(order: int, low: float | None, high: float | None, fs: float) -> tuple[np.ndarray, np.ndarray]:
    """Numerator and denominator of the digital filter that passes frequencies from ``low`` to ``high`` (None: open)."""
    warp = lambda f: 2 * np.tan(np.pi * f / fs)
    poles = np.exp(1j * np.pi * (2 * np.arange(order) + order + 1) / (2 * order))
    if low and high:
        width, middle = warp(high) - warp(low), warp(high) * warp(low)
        half = poles * width / 2
        root = np.sqrt(half**2 - middle)
        zeros, poles, gain = np.zeros(order), np.concatenate([half + root, half - root]), width**order
    elif low:
        zeros, poles, gain = np.zeros(order), warp(low) / poles, 1.0
    else:
        zeros, poles, gain = np.zeros(0), poles * warp(high), warp(high) ** order
    gain = gain * np.real(np.prod(2 - zeros) / np.prod(2 - poles))
    zeros = np.concatenate([(2 + zeros) / (2 - zeros), -np.ones(len(poles) - len(zeros))])
    return np.real(gain * np.poly(zeros)), np.real(np.poly((2 + poles) / (2 - poles)))


def settled(b: np.ndarray, a: np.ndarray) -> np.ndarray:
    """The state of the filter after a long run of ones."""
    k = len(a) - 1
    step = np.eye(k) - np.column_stack([-a[1:], np.eye(k)[:, : k - 1]])
    return np.linalg.solve(step, b[1:] - a[1:] * b[0])


def _run(b: np.ndarray, a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Filtered rows, starting from the settled state of each row's first value."""
    z = settled(b, a)[:, None] * x[:, 0]
    out = np.empty_like(x)
    for t in range(x.shape[1]):
        out[:, t] = b[0] * x[:, t] + z[0]
        z = np.vstack([z[1:], np.zeros((1, len(x)))]) + b[1:, None] * x[:, t] - a[1:, None] * out[:, t]
    return out


def filtered(x: np.ndarray, b: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Rows filtered forwards and backwards with odd extensions; rows no longer than the extension stay."""
    pad = 3 * max(len(a), len(b))
    if x.shape[1] <= pad:
        return x
    wide = np.concatenate([2 * x[:, :1] - x[:, pad:0:-1], x, 2 * x[:, -1:] - x[:, -2 : -pad - 2 : -1]], axis=1)
    return _run(b, a, _run(b, a, wide)[:, ::-1])[:, ::-1][:, pad:-pad]


def zero_phase(series: Column, b: np.ndarray, a: np.ndarray) -> Column:
    """A column of arrays filtered forwards and backwards; null stays null."""

    @F.pandas_udf("array<double>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            out, lengths = pd.Series([None] * len(part), part.index, dtype=object), part.map(lambda v: -1 if v is None else len(v))
            for n in lengths.unique():
                if n >= 0:
                    at = lengths.index[lengths == n]
                    rows = filtered(np.stack(part[at].tolist()).astype(float).reshape(len(at), n), b, a)
                    for k, row in zip(at, rows):
                        out.at[k] = row
            yield out

    return run(series)
