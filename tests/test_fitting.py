"""Fits against a Newton loop in NumPy, references of motion windows against NumPy, and what is missing."""

import numpy as np
from pyspark.sql import functions as F

from wavemill.functions.models import Logistic
from wavemill.operators import fitting


def newton(x, y, c=1.0, scaled=True):
    """The penalised optimum of balanced losses in a loop, and the scaling it was found in."""
    fill = np.nanmedian(np.where(np.isfinite(x), x, np.nan), axis=0)
    x = np.where(np.isfinite(x), x, fill)
    mean, scale = (x.mean(0), np.where(x.std(0) > 0, x.std(0), 1)) if scaled else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    z = np.c_[np.ones(len(x)), (x - mean) / scale]
    w, b, ridge = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())), np.zeros(z.shape[1]), np.r_[0, np.full(x.shape[1], 1 / c)]
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ b))
        b += np.linalg.solve((z.T * (w * p * (1 - p))) @ z + np.diag(ridge), z.T @ (w * (y - p)) - ridge * b)
    return b, fill, mean, scale


def rows_of(seed, n, missing=0.1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)) * [1, 5, 0.01] + [0, 100, 2]
    y = (x[:, 0] + (x[:, 1] - 100) / 5 + rng.normal(size=n) > 0.8).astype(int)
    x[rng.random((n, 3)) < missing] = np.nan
    return x, y


def frame(spark, x, y, room):
    rows = [(int(k), str(r), *(None if np.isnan(v) and k % 2 else float(v) for v in row), int(t)) for k, (row, t, r) in enumerate(zip(x, y, room))]
    return spark.createDataFrame(rows, "id int, room string, a double, b double, c double, y int").repartition(5)


def test_fit_against_a_loop(spark):
    x, y = rows_of(1, 600)
    x[3, 0] = np.inf  # counts as missing
    for c in (1.0, 0.1):
        m = fitting.fit_logistic(frame(spark, x, y, ["r"] * 600), ["a", "b", "c"], "y", c)
        b, fill, mean, scale = newton(x, y, c)
        assert np.allclose([m.intercept, *m.coef], b, atol=1e-9) and np.allclose(m.fill, fill) and np.allclose(m.mean, mean) and np.allclose(m.scale, scale)


def test_rooms_held_out(spark):
    x, y = rows_of(2, 800)
    room = np.array(["big"] * 500 + ["one"] * 120 + ["two"] * 100 + ["new"] * 80)
    got = {r["id"]: r for r in fitting.held_out(frame(spark, x, y, room), "room", ["big", "one", "two"], ["a", "b", "c"], "y", unseen=["new"]).collect()}
    assert len(got) == 800
    for g in ("big", "one", "two", "new"):
        teach = (room != g) & (room != "new")
        b, fill, mean, scale = newton(x[teach], y[teach])
        mine = np.flatnonzero(room == g)
        z = np.c_[np.ones(len(mine)), (np.where(np.isfinite(x[mine]), x[mine], fill) - mean) / scale]
        p = 1 / (1 + np.exp(-z @ b))
        assert max(abs(got[k].probability - v) for k, v in zip(mine, p)) < 1e-8
        assert all(got[k].predicted == int(v > 0.5) for k, v in zip(mine, p))


def test_fits_without_a_choice(spark):
    """No rows, one label, null labels, an input that is never known, an input that never changes."""
    x, y = rows_of(3, 60, 0)
    df = frame(spark, x, y, ["r"] * 60)
    one = {n: F.lit(0.0) for n in "abc"}
    score = lambda m: spark.range(1).select(m.probability(one)).first()[0]
    assert score(fitting.fit_logistic(df.limit(0), ["a", "b", "c"], "y")) == 0.5
    assert score(fitting.fit_logistic(df.where("y = 1"), ["a"], "y")) > 0.999 and score(fitting.fit_logistic(df.where("y = 0"), ["a"], "y")) < 0.001
    odd = df.union(df.withColumn("y", F.lit(None).cast("int"))).withColumns({"b": F.lit(None).cast("double"), "c": F.lit(7.0)})
    m = fitting.fit_logistic(odd, ["a", "b", "c"], "y")
    want = newton(x[:, :1], y)[0]
    assert np.allclose([m.intercept, m.coef[0]], want, atol=1e-9) and np.allclose(m.coef[1:], 0, atol=1e-9) and m.scale[1:] == (1.0, 1.0)


def test_quality_of_held_out_rows(spark):
    rows = [("r", p, y) for p, y, n in ((1, 1, 5), (1, 0, 2), (0, 1, 3), (0, 0, 10)) for _ in range(n)] + [("e", 0, 0)]
    got = {r["room"]: r for r in fitting.quality(spark.createDataFrame(rows, "room string, predicted int, y int"), "y", "room").collect()}
    assert (got["r"].n, got["r"].correct) == (20, 15) and np.allclose([got["r"].accuracy, got["r"].precision, got["r"].recall, got["r"].f1], [0.75, 5 / 7, 5 / 8, 10 / 15])
    assert got["e"].accuracy == 1 and got["e"].precision is None and got["e"].recall is None and got["e"].f1 is None


def test_motion_windows(spark):
    """Captures with labels, with too few empty windows, without any label, and one whose second measurement is never known."""
    rng, rows = np.random.default_rng(5), []
    for key, n, share in (("hot", 400, 0.6), ("few", 40, 0.1), ("dark", 30, None), ("half", 50, 0.5)):
        for _ in range(n):
            y = None if share is None or rng.random() < 0.1 else int(rng.random() > share)
            rows.append((key, float(rng.gamma(2) * 10 ** (y or 0)), None if key == "half" else float(rng.normal() + (y or 0)), y))
    df = spark.createDataFrame(rows, "key string, v double, l double, y int").repartition(4)
    pick = lambda key, col, keep=lambda y: True: np.array([r[col] for r in rows if r[0] == key and r[col] is not None and keep(r[3])])

    def reference(key, col, labelled):
        every, empty = pick(key, col), pick(key, col, lambda y: y == 0)
        if not len(every):
            return None
        if labelled:
            pool = empty if len(empty) >= 10 else every
            return np.median(pool), pool.std()
        low, high = np.percentile(every, [5, 25])
        return low, high - low

    for labelled in (True, False):
        z = fitting.normalised(df, "key", ["v", "l"], (F.col("y") == 0) if labelled else None).collect()
        assert len(z) == len(rows)
        for r in z:
            for col, name in ((1, "v"), (2, "l")):
                ref = reference(r["key"], col, labelled)
                if r[name] is None or ref is None:
                    assert r[f"z_{name}"] is None
                else:
                    assert abs(r[f"z_{name}"] - (r[name] - ref[0]) / ref[1]) < 1e-9 * max(1, abs(r[f"z_{name}"]))
        ready = [(r["key"], r["y"], r["z_v"], r["z_l"]) for r in z]
        x, y = (np.array(t) for t in zip(*(((a, b), t) for _, t, a, b in ready if t is not None and a is not None and b is not None)))
        b = newton(x, y, scaled=False)[0]
        model, threshold = fitting.fit_motion(df, "key", ["v", "l"], "y", labelled)
        assert isinstance(model, Logistic) and np.allclose([model.intercept, *model.coef], b, atol=1e-7)
        assert abs(threshold - np.percentile((np.c_[np.ones(len(x)), x] @ b)[y == 0], 90)) < 1e-7
        got = {r["key"]: r for r in fitting.judged(df, "key", ["v", "l"], "y", labelled, model, threshold).collect()}
        for key in got:
            over = [(t, a is not None and c is not None and b @ [1, a, c] > threshold) for k, t, a, c in ready if k == key and t is not None]
            assert abs(got[key].recall - np.mean([o for t, o in over if t == 1])) < 1e-9 and abs(got[key].specificity - np.mean([not o for t, o in over if t == 0])) < 1e-9
        assert got.keys() == {"hot", "few", "half"} and got["half"].recall == 0


def test_quantiles_are_values(spark):
    """Where a rank is a whole number its value comes back to the last bit: a threshold may not fall beside its own row."""
    rng = np.random.default_rng(9)
    x = np.sort(rng.normal(size=(100, 11)) * 7 + 3, axis=1)
    df = spark.createDataFrame([(k, float(v)) for k, row in enumerate(x) for v in row], "k int, v double").repartition(5)
    got = {r.k: r.q0 for r in fitting.long_quantiles(df, [0.9]).collect()}
    assert [got[k] for k in range(100)] == x[:, 9].tolist()
