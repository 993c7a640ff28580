"""Stateful streams whose state ends: byte chunks to whole records, and the self-ratio of complex channel ratios.

Both use Spark's stateful processors with timers, which need the RocksDB state store
(``spark.sql.streaming.stateStore.providerClass``). What they give does not depend on how a stream is cut into batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..sources.ranges import Walk, first_record
from . import live

RECORDS = "source string, seq bigint, record binary"
RATIOS = "source string, t double, ratio double"


def boundaries(data: bytes) -> tuple[list[bytes], bytes, bool]:
    """Whole records of format B at the front of the data, the rest, and whether the rest is no record's beginning."""
    walk = Walk(data, 0, "B")
    starts = [0, *walk.ends]
    return [data[a:b] for a, b in zip(starts, walk.ends)], data[walk.at :], walk.broken


class _Records(StatefulProcessor):
    """State: bytes of a record that is not whole yet, the next chunk and record number, whether bytes are out of step, and the newest time; and chunks that came too early."""

    def __init__(self, wait: float, forget: float):
        self.wait_ms, self.forget_ms = int(wait * 1000), int(forget * 1000)

    def init(self, handle):
        self.handle = handle
        self.state = handle.getValueState("state", "rest binary, chunk bigint, record bigint, lost boolean, newest bigint")
        self.early = handle.getMapState("early", "seq bigint", "chunk binary")

    def _load(self):
        return self.state.get() if self.state.exists() else (b"", 0, 0, False, 0)

    def _run(self, source: str, newest: int, skip: bool, watermark: int) -> pd.DataFrame:
        """Records of the chunks that are next in turn; with ``skip`` a missing chunk is given up."""
        rest, chunk, record, lost, _ = self._load()
        rest, out = bytes(rest), []
        pending = {k[0]: bytes(v[0]) for k, v in self.early.iterator()}
        if skip and pending and chunk not in pending:
            rest, chunk, lost = b"", min(pending), True
        while chunk in pending:
            rest, chunk = rest + pending.pop(chunk), chunk + 1
            self.early.removeKey((chunk - 1,))
            if lost:
                at, format = first_record(rest)
                if format != "B":
                    rest = rest[-3 * (3 + 0xFFFF) :]  # three records of the greatest length
                    continue
                rest, lost = rest[at:], False
            found, rest, lost = boundaries(rest)
            out += found
            rest = rest[1:] if lost else rest
        self.state.update((rest, chunk, record + len(out), lost, newest))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(max(newest + (self.wait_ms if pending else self.forget_ms), watermark + 1))
        return pd.DataFrame({"source": pd.Series([source] * len(out), dtype=object), "seq": range(record, record + len(out)), "record": pd.Series(out, dtype=object)})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        _, chunk, _, _, newest = self._load()
        for part in rows:
            newest = max(newest, int(part["ms"].max()))
            for seq, data in zip(part["seq"], part["chunk"]):
                if seq >= chunk:  # else it came again
                    self.early.updateValue((int(seq),), (bytes(data),))
        yield self._run(key[0], newest, False, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        newest = self._load()[4]
        if any(True for _ in self.early.iterator()):
            yield self._run(key[0], newest, True, timerValues.getCurrentWatermarkInMs())
        else:
            self.state.clear()

    def close(self):
        pass


def whole_records(chunks: DataFrame, late: str = "10 seconds", wait: float = 30.0, forget: float = 3600.0) -> DataFrame:
    """source, seq, record of a stream of (source, ts timestamp, seq, chunk): format-B records from chunks that are cut anywhere.

    Chunks are numbered from 0 by source; they may come out of order (up to ``late`` behind the newest time) and more
    than once. One that is missing when the watermark is ``wait`` seconds behind its source's newest chunk is given up,
    and records start again where two follow one another. A source that is silent for ``forget`` seconds of event time
    loses its state.
    """
    rows = chunks.withWatermark("ts", late).select("source", "ts", F.unix_millis("ts").alias("ms"), "seq", "chunk")
    return rows.groupBy("source").transformWithStateInPandas(_Records(wait, forget), RECORDS, "append", "eventTime")


# Self-ratio ----------------------------------------------------------------------------------------------------------


def _steps(r: np.ndarray, t: np.ndarray, at: np.ndarray, lag: int, most: float) -> np.ndarray:
    """Median relative step of each frame ``at`` from the frame ``lag`` before it; NaN where there is none or a pause lies between."""
    out = np.full(len(at), np.nan)
    ok = at >= lag
    ok[ok] = t[at[ok]] - t[at[ok] - lag] <= most
    if ok.any():
        a, b = r[at[ok]], r[at[ok] - lag]
        with np.errstate(all="ignore"):
            x = np.abs(a - b) / (np.abs(a) + np.abs(b))
        some = np.isfinite(x).any(1)
        out[np.flatnonzero(ok)[some]] = np.nanmedian(np.where(np.isfinite(x[some]), x[some], np.nan), axis=1)
    return out


def vector_ratio_at(t: np.ndarray, r: np.ndarray, at: float) -> float:
    """Median step over half a second by median step over one frame, of complex rows, in the window that ends at ``at``; NaN where it is too thin."""
    inside = np.flatnonzero((t > at - live.WINDOW) & (t <= at))
    if len(inside) < 3:
        return float("nan")
    dt = float(np.median(np.diff(t[inside])))
    if dt <= 0:
        return float("nan")
    need, lag = max(2, int(0.5 * live.WINDOW / dt)), max(1, round(live.LAG / dt))
    one = _steps(r, t, inside, 1, 2.5 * dt)
    far = _steps(r, t, inside, lag, 1.5 * live.LAG + dt)
    one, far = one[np.isfinite(one)], far[np.isfinite(far)]
    if len(inside) < need or len(one) < need or len(far) < need or np.median(one) == 0:
        return float("nan")
    return float(np.median(far) / np.median(one))


class _SelfRatio(StatefulProcessor):
    """State: frames that later windows need, and frames that the watermark has not passed. A timer ends both."""

    def __init__(self, forget: float):
        self.forget = forget

    def init(self, handle):
        self.handle = handle
        self.state = handle.getValueState("state", "t binary, r binary, hop double, early_t binary, early_r binary")

    def _load(self):
        if not self.state.exists():
            return np.zeros(0), [], None, np.zeros(0), []
        t, r, hop, et, er = self.state.get()
        rows = lambda n, b: list(np.frombuffer(bytes(b), complex).reshape(n, -1)) if n else []
        t, et = np.frombuffer(bytes(t)), np.frombuffer(bytes(et))
        # early frames may differ in width: each has its width in front
        flat, early = np.frombuffer(bytes(er), complex), []
        while len(flat):
            n = int(flat[0].real)
            early.append(flat[1 : n + 1])
            flat = flat[n + 1 :]
        return t, rows(len(t), r), None if hop != hop else hop, et, early

    def _advance(self, key, t, r, hop, et, er, until: float, last: bool) -> pd.DataFrame:
        order = np.argsort(et, kind="stable")
        ready = [k for k in order if et[k] <= until]
        left = [k for k in order if et[k] > until]
        out = []
        for k in ready:
            if len(t) and (et[k] < t[-1] or len(er[k]) != len(r[-1])):  # a frame of another width: start over
                t, r, hop = np.zeros(0), [], None
            t, r = np.append(t, et[k]), [*r, er[k]]
            if k == ready[-1] or len(er[k]) != len(er[ready[ready.index(k) + 1]]):
                found, t, kept, hop = live.advance(t, np.stack(r), hop, vector_ratio_at, 2 * live.WINDOW + 1.5 * live.LAG)
                r, out = list(kept), out + found
        if last and not left:
            self.state.clear()
        else:
            early = np.concatenate([np.concatenate([[len(er[k])], er[k]]) for k in left]) if left else np.zeros(0, complex)
            self.state.update((t.tobytes(), (np.stack(r) if r else np.zeros(0, complex)).tobytes(), float("nan") if hop is None else float(hop), et[left].tobytes(), early.astype(complex).tobytes()))
        return pd.DataFrame({"source": pd.Series([key[0]] * len(out), dtype=object), "t": [float(x[0]) for x in out], "ratio": [float(x[1]) for x in out]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        t, r, hop, et, er = self._load()
        for part in rows:
            et = np.append(et, part["t"].to_numpy(float))
            er += [np.array(a, float) + 1j * np.array(b, float) for a, b in zip(part["re"], part["im"])]
        newest = max([*et, *t[-1:]])
        until = timerValues.getCurrentWatermarkInMs() / 1000
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(max(int((newest + self.forget) * 1000), timerValues.getCurrentWatermarkInMs() + 1))
        yield self._advance(key, t, r, hop, et, er, until, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._advance(key, *self._load(), float("inf"), True)

    def close(self):
        pass


def vector_self_ratio(frames: DataFrame, late: str = "2 seconds", forget: float = 10.0) -> DataFrame:
    """source, t, ratio of a stream of (source, ts timestamp, re, im arrays): the self-ratio of complex frames every quarter second.

    Frames may come out of order up to ``late``; later ones are left out. Frames of another width, or behind a pause,
    start over. ``forget`` seconds of event time after a source's last frame its last values come and its state goes.
    """
    rows = frames.withWatermark("ts", late).select("source", "ts", F.unix_micros("ts").cast("double").alias("us"), "re", "im")
    rows = rows.select("source", "ts", (F.col("us") / 1e6).alias("t"), "re", "im")
    return rows.groupBy("source").transformWithStateInPandas(_SelfRatio(forget), RATIOS, "append", "eventTime")
