"""Curves are the best of those with the trend."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators.piecewise import PiecewiseBinner, _joints, _solve, nonnegative_least_squares, trend_rows

SPLITS = [-0.4, 0.1, 0.5]
TRENDS = ["ascending", "descending", "peak", "valley", "convex", "concave"]


def sums(seed, degree):
    r = np.random.default_rng(seed)
    x, out = r.uniform(-1, 1, 400), []
    t = np.sin(4 * x + seed) + r.normal(0, 0.2, 400)
    at = np.searchsorted(SPLITS, x, side="right")
    for i in range(4):
        z = x[at == i]
        out.append((np.array([(z**p).sum() for p in range(2 * degree + 1)]), np.array([(t[at == i] * z**p).sum() for p in range(degree + 1)])))
    return out


def loss(parts, c):
    k = len(c[0])
    return sum(v @ np.array([[m[p + q] for q in range(k)] for p in range(k)]) @ v / 2 - cross[:k] @ v for v, (m, cross) in zip(c, parts, strict=True))


@pytest.mark.parametrize("seed", range(5))
def test_nonnegative_least_squares(seed):
    r = np.random.default_rng(seed)
    a, b = r.normal(size=(9, 6)), r.normal(size=9)
    x = nonnegative_least_squares(a, b)
    gain = a.T @ (b - a @ x)
    assert (x >= 0).all() and (gain <= 1e-8).all() and np.abs(gain[x > 0]).max(initial=0) < 1e-8


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("degree, continuous", [(0, False), (1, True), (1, False), (2, True), (3, True)])
@pytest.mark.parametrize("trend", TRENDS)
def test_curves_have_the_trend_and_none_near_is_better(trend, degree, continuous, seed):
    if trend in ("convex", "concave") and degree > 1:
        return
    parts = sums(seed, degree)
    best = _solve(parts, SPLITS, degree, continuous, True, np.zeros(4 * (degree + 1)), trend)
    x = np.concatenate(best)
    sides = [trend_rows(SPLITS, degree, trend, t) for t in (range(5) if trend in ("peak", "valley") else [0])]
    assert any((s @ x >= -1e-6).all() for s in sides)
    equal = np.concatenate([_joints(SPLITS, degree, d) for d in range(min(2, degree) if continuous else 0)] or [np.zeros((0, len(x)))])
    assert np.abs(equal @ x).max(initial=0) < 1e-7
    free = np.eye(len(x)) if not len(equal) else np.linalg.svd(equal)[2][np.linalg.matrix_rank(equal) :].T
    r, low = np.random.default_rng(seed), loss(parts, best)
    for step in (1.0, 0.1, 0.01, 0.001):
        for _ in range(300):
            y = x + free @ r.normal(0, step, free.shape[1])
            if any((s @ y >= 0).all() for s in sides):
                assert loss(parts, y.reshape(4, -1)) >= low - 1e-6


def test_fits_with_a_turn_and_their_analysis(spark):
    df = spark.range(4000).select((F.col("id") % 400 / 20.0).alias("x"), F.col("id")).withColumn("y", -((F.col("x") - 8) ** 2) + F.col("id") % 7)
    shapes = {"peak": lambda v: all(b >= a - 1e-6 for a, b in zip(v[: np.argmax(v)], v[1 : np.argmax(v) + 1])) and all(b <= a + 1e-6 for a, b in zip(v[np.argmax(v) :], v[np.argmax(v) + 1 :])),
              "concave": lambda v: (np.diff(v, 2) <= 1e-6).all()}
    for trend, holds in shapes.items():
        model = PiecewiseBinner(kind="continuous", monotonic_trend=trend).fit(df, "x", "y")
        rows = model.transform(df.select("x").distinct(), "x", "v").toPandas().sort_values("x")
        assert holds(rows["v"].to_numpy())
    out, tests = model.analysis(df, "x", "y")
    assert {"iv", "hhi", "quality_score", "trend", "mae", "r2"} <= set(out) and len(tests) == model.model.n_bins - 1
    e = df.withColumn("e", (F.pmod(F.xxhash64("id"), F.lit(100)) < F.col("x") * 4).cast("int"))
    model = PiecewiseBinner(monotonic_trend="ascending").fit(e, "x", "e")
    out, tests = model.analysis(e, "x", "e", "fisher")
    assert {"iv", "js", "hellinger", "triangular", "auc", "gini", "ks", "quality_score", "hhi_norm"} <= set(out) and (tests["p_value"] <= 1).all()
    with pytest.raises(ValueError):
        model.analysis(e, "x", "e", "t")
