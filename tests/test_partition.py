"""The partition solver against enumeration of all partitions."""

import itertools
import time

import numpy as np
import pytest

from tessera.functions import stats
from tessera.operators.binning import BinaryBinner
from tessera.plans import grid
from tessera.plans.partition import SCALE, enumerate_partitions


def bins(seed, n=7):
    r = np.random.default_rng(seed)
    return {"n0": r.integers(5, 100, n).astype(float), "n1": r.integers(5, 100, n).astype(float)}


def valid(rates, ends, trend, turn=None):
    d = np.diff(rates)
    if trend in ("peak_heuristic", "valley_heuristic"):  # bins that end before the turn rise, those that end at it or later fall
        s = d if trend == "peak_heuristic" else -d
        return all((b >= turn or x >= 0) and (a < turn or x <= 0) for x, (a, b) in zip(s, itertools.pairwise(ends), strict=True))
    if trend == "ascending":
        return (d >= 0).all()
    if trend == "descending":
        return (d <= 0).all()
    if trend in ("peak", "valley"):
        s = d if trend == "peak" else -d
        m = len(rates)
        return any(all(s[i] >= 0 for i in range(t - 1)) and all(s[i] <= 0 for i in range(t, m - 1)) for t in range(m + 1))
    if trend in ("concave", "convex"):
        g = 1 if trend == "concave" else -1
        return all(g * (2 * rates[j] - rates[i] - rates[k]) >= 0 for i, j, k in itertools.combinations(range(len(rates)), 3))
    return True


@pytest.mark.parametrize("trend", [None, "ascending", "descending", "peak", "valley", "peak_heuristic", "valley_heuristic", "concave", "convex"])
@pytest.mark.parametrize("options", [{}, {"max_n_bins": 3}, {"min_n_bins": 3}, {"min_bin_size": 0.2}, {"gamma": 0.5}, {"max_pvalue": 0.05}, {"max_pvalue": 0.05, "max_pvalue_policy": "all"}, {"min_event_rate_diff": 0.05}])
@pytest.mark.parametrize("seed", range(4))
def test_best_of_all_partitions(trend, options, seed):
    b = bins(seed)
    n0, n1 = b["n0"], b["n1"]
    total = n0.sum() + n1.sum()
    binner = BinaryBinner(monotonic_trend=trend, **options)
    problem = binner._problem(b, total)
    binner._problem = lambda *_: problem  # the options that are set later are then seen here
    got, _ = binner._optimise(b, total, None)
    best = None
    for ends in enumerate_partitions(len(n0)):
        starts = [0, *[e + 1 for e in ends[:-1]]]
        groups = list(zip(starts, ends, strict=True))
        rates = [int(problem.rates[0][e][s]) for s, e in groups]
        sizes = [float(problem.size[e][s]) for s, e in groups]
        if len(groups) > (options.get("max_n_bins") or 99) or len(groups) < (options.get("min_n_bins") or 1):
            continue
        if not valid(np.array(rates), ends, trend, problem.changes[0]) or any(z < np.ceil(options.get("min_bin_size", 0) * total) for z in sizes):
            continue
        if problem.min_diff and any(abs(x - y) < problem.min_diff for x, y in itertools.pairwise(rates)):
            continue
        if problem.conflict:
            pairs = itertools.combinations(groups, 2) if problem.all_pairs else itertools.pairwise(groups)
            if any(problem.conflict(*x, *y) for x, y in pairs):
                continue
        value = sum(int(problem.value[e][s]) for s, e in groups) - problem.gamma * int(max(sizes) - min(sizes))
        key = (value, -len(ends), tuple(-e for e in ends))
        best = key if best is None or key > best else best
    if best is None:
        assert got.status == "INFEASIBLE" and got.ends == [len(n0) - 1]
    else:
        assert got.status == "OPTIMAL" and (got.value, got.ends) == (best[0], [-e for e in best[2]])


@pytest.mark.parametrize("options", [{"monotonic_trend": "convex"}, {"monotonic_trend": "ascending", "max_pvalue": 0.05, "max_pvalue_policy": "all"}, {"monotonic_trend": "peak", "gamma": 0.5}, {"monotonic_trend": None, "gamma": 1.0}])
def test_long_searches_end_in_time_with_an_honest_status(options):
    b = bins(3, 100)
    began = time.monotonic()
    got, _ = BinaryBinner(time_limit=2, **options)._optimise(b, b["n0"].sum() + b["n1"].sum(), None)
    assert time.monotonic() - began < 20
    assert got.status in ("OPTIMAL", "FEASIBLE", "UNKNOWN") and got.ends[-1] == 99


def test_fixed_ends_are_kept():
    b = bins(1)
    got, _ = BinaryBinner(monotonic_trend=None, max_n_bins=3, user_splits=list(range(6)), user_splits_fixed=[False, True, False, True, False, False])._optimise(b, 1000, np.array([False, True, False, True, False, False]))
    assert {1, 3} <= set(got.ends)


@pytest.mark.parametrize("seed", range(5))
def test_grid_cover_is_the_best(seed):
    r = np.random.default_rng(seed)
    m = n = 3
    e, ne = r.integers(3, 50, (m, n)), r.integers(3, 50, (m, n))
    pe, pn = grid.prefix_sums(e), grid.prefix_sums(ne)
    rectangles = []
    for s in grid.all_rectangles(m, n):
        a, b = grid.rectangle_sum(pe, *s), grid.rectangle_sum(pn, *s)
        rectangles.append(grid.Rectangle(*s, int(SCALE * stats.jeffrey(a / e.sum(), b / ne.sum())), int(SCALE * a / (a + b)), a + b))
    chosen, status = grid.solve(rectangles, m, n, "ascending", None)
    best = [-1]

    def touching_fit(cover):
        own = np.zeros((m, n), int)
        for k, i in enumerate(cover):
            own[rectangles[i].cells()] = k
        return all(own[y, x] == own[y, x + 1] or rectangles[cover[own[y, x]]].rate <= rectangles[cover[own[y, x + 1]]].rate for y in range(m) for x in range(n - 1))

    def go(taken, cover):
        free = np.argwhere(~taken)
        if not len(free):
            if touching_fit(cover):
                best[0] = max(best[0], sum(rectangles[i].value for i in cover))
            return
        y, x = free[0]
        for i, q in enumerate(rectangles):
            if (q.top, q.left) == (y, x) and not taken[q.cells()].any():
                t = taken.copy()
                t[q.cells()] = True
                go(t, [*cover, i])

    go(np.zeros((m, n), bool), [])
    assert status == "OPTIMAL" and sum(rectangles[i].value for i in chosen) == best[0]
