"""Orientation of ratios against loops over frames, and planted damage in a key with many blocks."""

import cmath
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavemill.operators import orientation as O


def fit(frame, other, weight):
    keep = sum(a * b.conjugate() for a, b in zip(frame, other))
    turn = sum(a.conjugate() * b.conjugate() for a, b in zip(frame, other))
    swapped = abs(turn) > abs(keep)
    best = turn if swapped else keep
    return swapped, abs(cmath.phase(best)) > math.pi / 2, abs(best) / weight if weight else 0.0


def corrected(z, s, r):
    return [[(-1 if r[k] else 1) * (x.conjugate() if s[k] else x) for x in row] for k, row in enumerate(z)]


def parity(toggles):
    out, now = [], False
    for t in toggles:
        now ^= t
        out.append(now)
    return out


def loop_steps(z):
    ts, tr, last = [], [], None
    for row in z:
        a = b = False
        if any(row):
            if last is not None:
                shared = sum(bool(x) and bool(y) for x, y in zip(row, last))
                swapped, half, q = fit(row, last, shared)
                if q >= 0.7:
                    a, b = swapped, half
            last = row
        ts.append(a)
        tr.append(b)
    return parity(ts), parity(tr)


def loop_states(phase):
    z = [[cmath.exp(1j * x) if np.isfinite(x) else 0j for x in row] for row in phase]
    n, width = len(z), len(z[0])
    s, r = loop_steps(z)
    for _ in range(2):
        w = min(8, (n - 1) // 2)
        for _ in range(2):
            own, ns, nr = corrected(z, s, r), list(s), list(r)
            for k in range(n):
                near = [j for j in range(max(0, k - w), min(n, k + w + 1)) if j != k]
                ref = [sum(own[j][c] for j in near) for c in range(width)]
                weight, usable = sum(map(abs, ref)), sum(any(z[j]) for j in near)
                if any(z[k]) and weight / max(usable, 1) / width >= 0.7:
                    ns[k], nr[k], _ = fit(z[k], ref, weight)
            s, r = ns, nr
        w = min(8, n // 2)
        own, places = corrected(z, s, r), []
        for k in range(w, n - w):
            before = [sum(own[j][c] for j in range(k - w, k)) for c in range(width)]
            behind = [sum(own[j][c] for j in range(k, k + w)) for c in range(width)]
            swapped, half, q = fit(behind, before, sum(abs(a) * abs(b) for a, b in zip(before, behind)))
            if (swapped or half) and q >= 0.7:
                places.append((-q, k, swapped, half))
        ts, tr, used = [False] * n, [False] * n, []
        for _, k, swapped, half in sorted(places):
            if all(abs(k - u) > w for u in used):
                ts[k], tr[k] = swapped, half
                used.append(k)
        s, r = [a ^ b for a, b in zip(s, parity(ts))], [a ^ b for a, b in zip(r, parity(tr))]
        again = loop_steps(corrected(z, s, r))
        s, r = [a ^ b for a, b in zip(s, again[0])], [a ^ b for a, b in zip(r, again[1])]
    return s, r


def drifting(rng, n, width=12, noise=0.15, damage=0.05, stretch=0.01):
    """Wrapped ratio phases of a slowly drifting channel, with single frames and whole stretches damaged."""
    base = 1.2 * np.sin(np.arange(width) * 0.6) + 0.5
    phase = base + np.cumsum(rng.normal(0, 0.01, (n, 1)), axis=0) + rng.normal(0, noise, (n, width))
    swap = (np.cumsum(rng.random(n) < stretch) % 2 == 1) ^ (rng.random(n) < damage)
    rot = (np.cumsum(rng.random(n) < stretch) % 2 == 1) ^ (rng.random(n) < damage)
    level = 5 * np.sin(np.arange(width) * 0.9) + rng.normal(0, 1, (n, width))
    seen = np.where(swap[:, None], -phase, phase) + np.pi * rot[:, None]
    return np.angle(np.exp(1j * seen)), np.where(swap[:, None], -level, level), swap, rot, np.angle(np.exp(1j * phase)), level


@pytest.mark.parametrize("noise", [0.1, 0.6, 1.0, 3.0])
def test_local_states_against_loops(noise):
    rng = np.random.default_rng(int(noise * 10))
    for n in (1, 2, 3, 5, 17, 150):
        phase = drifting(rng, n, noise=noise, stretch=0.05)[0]
        phase[rng.random(phase.shape) < 0.05] = np.nan
        phase[rng.random(n) < 0.05] = np.nan
        got = O.local_states(phase)
        want = loop_states(phase) if n > 1 else ([False] * n, [False] * n)
        assert got[0].tolist() == want[0] and got[1].tolist() == want[1]


def frames_of(spark, keyed):
    rows = [(k, i, row, lev) for k, (phase, level) in keyed.items() for i, (row, lev) in enumerate(zip(phase.tolist(), level.tolist()))]
    return spark.createDataFrame(rows, "key string, at bigint, phase array<double>, level array<double>").repartition(5)


def found(df):
    out: dict = {}
    for r in sorted(df.collect(), key=lambda r: (r["key"], r["at"])):
        out.setdefault(r["key"], []).append((r["swapped"], r["rotated"]))
    return {k: np.array(v).T for k, v in out.items()}


def test_blocks_are_put_in_line(spark):
    """The states of a whole key, cut into many blocks, are those of one piece, up to where the key starts."""
    rng = np.random.default_rng(4)
    phase, level, *_ = drifting(rng, 3000, noise=0.3, stretch=0.02)
    frames = O.numbered(frames_of(spark, {"hot": (phase, level), "small": (phase[:40], level[:40])}), "key", ["at"], F.floor(F.col("at") / 100))
    got = {}
    for r in O.relative_states(frames, "key", "phase", block=256, margin=128).collect():
        got[r["key"], r["i"]] = r["swap"], r["rot"]
    for key, n in (("hot", 3000), ("small", 40)):
        swap, rot = O.local_states(phase[:n])
        assert [got[key, i] for i in range(n)] == list(zip(swap.tolist(), rot.tolist()))


def test_planted_damage_with_a_reference(spark):
    """Most frames are right, so the reference is absolute: every frame of the hot key and of small ones comes out as it was."""
    rng = np.random.default_rng(9)
    planted = {"hot": drifting(rng, 2500, stretch=0.004, damage=0.02), **{f"k{j}": drifting(rng, 60, stretch=0.0, damage=0.1) for j in range(4)}, "one": drifting(rng, 1, damage=1.0)}
    # long stretches of damage in the minority
    frames = frames_of(spark, {k: v[:2] for k, v in planted.items()})
    numbered = O.numbered(frames, "key", ["at"], F.floor(F.col("at") / 100))
    refs = O.reference(numbered, "key", "phase", "level")
    keys = {r["key"] for r in refs.collect()}
    done = O.detect_states(frames, "key", ["at"], F.floor(F.col("at") / 100), "phase", "level", refs, block=300)
    states = found(done)
    for k, (_, _, swap, rot, clean, level) in planted.items():
        if k == "one":
            assert states[k].tolist() == [[False], [False]]
            continue
        assert k in keys
        majority = [np.mean(x) > 0.5 for x in (swap, rot)]
        assert (states[k][0] == (swap ^ majority[0])).all() and (states[k][1] == (rot ^ majority[1])).all()
        if not any(majority):
            rows = sorted((r for r in done.select("key", "at", O.corrected_phase("phase").alias("p"), O.corrected_amplitude("level").alias("l")).where(F.col("key") == k).collect()), key=lambda r: r["at"])
            assert np.allclose([r["p"] for r in rows], clean, atol=1e-9) and np.allclose([r["l"] for r in rows], level)


def test_a_reference_counts_all_frames(spark):
    """Every third frame of a long key is damaged, evenly spread ones among them all: the other two thirds decide."""
    rng = np.random.default_rng(21)
    n = 3 * 4095 + 1
    shape, turn = 4 * np.sin(np.arange(6)), rng.uniform(-1, 1, 6)
    level, phase = shape + rng.normal(0, 0.2, (n, 6)), turn + rng.normal(0, 0.05, (n, 6))
    bad = np.arange(n) % 3 == 0
    level[bad] *= -1
    phase[bad] = np.angle(np.exp(1j * (-phase[bad] + np.pi)))
    frames = frames_of(spark, {"a": (phase, level)})
    refs = O.reference(O.numbered(frames, "key", ["at"], F.floor(F.col("at") / 500)), "key", "phase", "level")
    (ref,) = refs.collect()
    middle = np.median(level, axis=0)
    v = np.exp(1j * phase).mean(1).sum()
    assert np.allclose(ref.profile, middle - middle.mean(), atol=1e-12) and np.isclose(complex(ref.re, ref.im), v / abs(v))
    states = found(O.detect_states(frames, "key", ["at"], F.floor(F.col("at") / 500), "phase", "level", refs, native=False))["a"]
    assert (states[0] == bad).all() and (states[1] == bad).all()


def test_band_medians_of_parts(spark):
    """Ties, one value throughout, order in time, gaps, infinities and short arrays, against one sort of each place."""
    rng = np.random.default_rng(22)
    keyed = {}
    for key, n in (("hot", 1501), ("even", 400), ("small", 7), ("one", 1)):
        x = rng.normal(0, 3, (n, 6))
        x[:, 1] = np.round(x[:, 1])  # ties
        x[:, 2] = 2.5
        x[:, 3] = np.sort(x[:, 3])
        x[rng.random(n) < 0.4, 4] = np.nan
        x[rng.random(n) < 0.1, 0] = np.inf
        keyed[key] = x
    rows = [(k, i, [None if np.isnan(v) and i % 2 else v for v in r.tolist()][: 5 if i % 5 else 6]) for k, x in keyed.items() for i, r in enumerate(x)]
    rows += [("hot", 1501, None), ("hot", 1502, []), ("void", 0, [None, float("nan")])]
    frames = spark.createDataFrame(rows, "key string, at bigint, level array<double>").repartition(5)
    values: dict = {}
    for key, _, r in rows:
        for k, v in enumerate(r or []):
            if v is not None and np.isfinite(v):
                values.setdefault((key, k), []).append(v)
    for part in (O.PART, 100, 7):
        got = O.band_medians(O.numbered(frames, "key", ["at"], F.lit(0)), "key", "level", part).collect()
        assert len(got) == len(values) and all(np.isclose(r["median"], np.median(values[r.key, r._sc]), atol=1e-12) for r in got)


def test_strided_views_use_the_reference_alone(spark):
    rng = np.random.default_rng(6)
    phase, level, swap, rot, *_ = drifting(rng, 900, stretch=0.0, damage=0.2)
    frames = frames_of(spark, {"a": (phase, level)})
    refs = O.reference(O.numbered(frames, "key", ["at"], F.lit(0)), "key", "phase", "level")
    states = found(O.detect_states(frames.where("at % 7 = 0"), "key", ["at"], F.lit(0), "phase", "level", refs, native=False))["a"]
    assert (states[0] == swap[::7]).all() and (states[1] == rot[::7]).all()
    alone = found(O.detect_states(frames.where("at % 7 = 0"), "key", ["at"], F.lit(0), "phase", "level", None, native=False))["a"]
    assert not alone.any()


def loop_majority(phase, level, swap, rot):
    """Long stretches against the batch's own profile and direction, frame by frame."""
    n = len(swap)
    swap, rot = np.array(swap), np.array(rot)
    w = min(201, max(3, n // 4))

    def against(votes):
        low = []
        for k in range(n):
            a, b = k + (w - 1) // 2 - (w - 1), k + (w - 1) // 2
            low.append(sum(votes[max(0, a) : min(n, b + 1)]) < 0)
        out, k = np.zeros(n, bool), 0
        while k < n:
            e = k
            while e < n and low[e] == low[k]:
                e += 1
            if low[k] and e - k >= 200:
                out[k:e] = True
            k = e
        return out

    if n >= 400:
        for _ in range(2):
            turned = np.where(swap[:, None], -level, level)
            profile = np.median(turned, axis=0) - np.median(turned, axis=0).mean()
            if profile.std() < 0.5:
                break
            swap = swap ^ against(((turned - turned.mean(1, keepdims=True)) * profile).sum(1))
        for _ in range(2):
            p = np.where(swap[:, None], -phase, phase) + np.pi * rot[:, None]
            v = np.exp(1j * p).mean(1)
            rot = rot ^ against((v * np.conj(v.sum() / abs(v.sum()))).real)
    return swap ^ (swap.mean() > 0.5), rot ^ (rot.mean() > 0.5)


def test_majority_without_a_reference(spark):
    """Stretches that the local comparisons cannot join are turned by the key's own majority."""
    rng = np.random.default_rng(12)
    phase, level, swap, rot, clean, _ = drifting(rng, 1600, stretch=0.0, damage=0.02)
    noise = rng.uniform(-np.pi, np.pi, (20, phase.shape[1]))
    phase[500:520] = noise  # nothing lines up across this gap
    phase[520:900] = np.angle(np.exp(1j * (-phase[520:900] + np.pi)))
    level[520:900] *= -1
    short, short_level, *_ = drifting(rng, 120, stretch=0.05)
    frames = frames_of(spark, {"a": (phase, level), "b": (short, short_level)})
    states = found(O.detect_states(frames, "key", ["at"], F.floor(F.col("at") / 100), "phase", "level", None, block=300))
    for key, p, l in (("a", phase, level), ("b", short, short_level)):
        want = loop_majority(p, l, *O.local_states(p))
        assert (states[key][0] == want[0]).all() and (states[key][1] == want[1]).all()
    inside = np.r_[0:495, 530:890, 905:1600]
    expected = swap.copy()
    expected[520:900] ^= True
    assert (states["a"][0][inside] == expected[inside]).mean() > 0.99


def test_odd_frames(spark):
    """Null and empty samples, keys of one frame, an empty table."""
    rows = [("a", 0, None, None), ("a", 1, [0.1, None, float("nan")], [1.0, None, 2.0]), ("a", 2, [], []), ("b", 0, [0.3, 0.1, 0.2], [1.0, 2.0, 3.0])]
    frames = spark.createDataFrame(rows, "key string, at bigint, phase array<double>, level array<double>")
    refs = O.reference(O.numbered(frames, "key", ["at"], F.lit(0)), "key", "phase", "level")
    for r in (refs, None):
        done = O.detect_states(frames, "key", ["at"], F.lit(0), "phase", "level", r)
        assert {(x["key"], x["at"]) for x in done.collect()} == {(x[0], x[1]) for x in rows}
        assert done.where("key = 'b' AND (swapped OR rotated)").count() == 0
    assert O.detect_states(frames.limit(0), "key", ["at"], F.lit(0), "phase", "level", None).collect() == []


def test_a_profile_fit_takes_one_mean(spark):
    """The mean of a frame's decibels is bound, not taken anew for each sample."""
    df = spark.createDataFrame([([1.0, None, 4.0, float("nan")], [1.0, 2.0, 3.0]), ([None], [1.0]), (None, [1.0])], "a array<double>, p array<double>")
    done = df.select(O.profile_fit("a", F.col("p")).alias("y"))
    assert [r.y for r in done.collect()] == [3.0, 0.0, 0.0]
    plan = done._jdf.queryExecution().analyzed().toString()
    assert plan.index("filter(a") < plan.index("zip_with(a")


def test_no_decibels_in_the_rounds_of_turns(spark, monkeypatch):
    """What most frames agree on without a reference: the rounds that settle turns keep no arrays."""
    held = []
    monkeypatch.setattr(O, "kept", lambda df: held.append(df.dtypes) or df.localCheckpoint())
    rows = [("a", i, [0.1, 0.4], [3.0, -3.0]) for i in range(30)]
    df = spark.createDataFrame(rows, "key string, at bigint, phase array<double>, level array<double>")
    done = O.detect_states(df, "key", ["at"], F.lit(0), "phase", "level")
    assert {(r["swapped"], r["rotated"]) for r in done.collect()} == {(False, False)}
    assert len(held) > 5 and not any("array" in kind for columns in held[-3:] for _, kind in columns)
