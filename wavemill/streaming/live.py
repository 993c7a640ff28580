"""Live operators: appended capture tables, and the self-ratio of motion as a stateful stream.

The self-ratio compares the median step over half a second with that over one frame, every quarter second. Its state
holds the last seconds of a source, so results do not depend on how the stream is cut into batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

WINDOW, HOP, LAG, GAP = 0.5, 0.25, 0.5, 5.0
OUT = "source string, t double, ratio double"
STATE = "t array<double>, v array<double>, hop double"


def follow(spark: SparkSession, folder: str, schema, files_per_batch: int = 16) -> DataFrame:
    """Segments of a growing folder, in order of arrival."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def windowed_rates(stream: DataFrame, late: str = "10 seconds", width: str = "1 second") -> DataFrame:
    """Frames and mean value of each source and second; rows later than ``late`` are left out."""
    return stream.withWatermark("ts", late).groupBy("source", F.window("ts", width)).agg(F.count("*").alias("n"), F.avg("value").alias("mean"))


def ratio_at(t: np.ndarray, v: np.ndarray, at: float) -> float:
    """Median half-second step over median one-frame step in the window that ends at ``at``; NaN when it is too thin."""
    inside = np.flatnonzero((t > at - WINDOW) & (t <= at))
    if len(inside) < 3:
        return float("nan")
    dt = np.median(np.diff(t[inside]))
    if len(inside) < 0.5 * WINDOW / max(dt, 1e-9):
        return float("nan")
    one = inside[inside > 0]
    step1 = np.abs(v[one] - v[one - 1])[t[one] - t[one - 1] <= 2.5 * dt]
    back = np.searchsorted(t, t[inside] - LAG, "right") - 1
    ok = (back >= 0) & (t[inside] - t[np.maximum(back, 0)] <= 1.5 * LAG + dt)
    step2 = np.abs(v[inside[ok]] - v[back[ok]])
    if not len(step1) or not len(step2) or np.median(step1) == 0:
        return float("nan")
    return float(np.median(step2) / np.median(step1))


def advance(t: np.ndarray, v: np.ndarray, hop: float | None, ratio=ratio_at, reach: float = WINDOW + 2 * LAG) -> tuple[list[tuple[float, float]], np.ndarray, np.ndarray, float]:
    """Hops that the rows so far complete, the rows still needed, and the next hop. A pause over GAP starts anew behind it."""
    out: list[tuple[float, float]] = []
    if hop is None:
        hop = np.ceil(t[0] / HOP) * HOP + HOP
    while hop < t[-1]:
        k = int(np.searchsorted(t, hop, "right"))
        if k and k < len(t) and t[k] - t[k - 1] > GAP:
            out.append((float(hop), float("nan")))
            t, v = t[k:], v[k:]
            hop = np.ceil(t[0] / HOP) * HOP + HOP
            continue
        out.append((float(hop), ratio(t, v, hop)))
        hop += HOP
    keep = t > hop - reach
    return out, t[keep], v[keep], float(hop)


def self_ratio(stream: DataFrame) -> DataFrame:
    """source, t, ratio of a stream of (source, t, value) in which each source's rows arrive in time order."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        t, v, hop = (np.array(state.get[0]), np.array(state.get[1]), state.get[2]) if state.exists else (np.zeros(0), np.zeros(0), None)
        new = pd.concat(list(batches)).sort_values("t", kind="stable")
        nt, nv = new["t"].to_numpy(float), new["value"].to_numpy(float)
        if len(t) and len(nt) and nt[0] < t[-1]:  # time ran backwards: start over
            t, v, hop = np.zeros(0), np.zeros(0), None
        t, v = np.concatenate([t, nt]), np.concatenate([v, nv])
        out, t, v, hop = advance(t, v, hop) if len(t) else ([], t, v, hop)
        state.update((t.tolist(), v.tolist(), hop))
        yield pd.DataFrame({"source": [key[0]] * len(out), "t": [x[0] for x in out], "ratio": [x[1] for x in out]})

    return stream.groupBy("source").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
