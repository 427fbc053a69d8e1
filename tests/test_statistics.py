"""Statistics against printed counts, closed forms and brute force."""

import math

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from tessera.functions import stats
from tessera.functions.special import beta_inc, beta_inc_inverse, chi2_sf, chi2_test, fisher_exact, gamma_upper, probability_greater, student_two_sided, welch
from tessera.operators.tables import BinaryTable, ContinuousTable, MulticlassTable, interval_labels
from tessera.plans import trend

NONEVENT = [3, 3, 7, 10, 28, 44, 117, 0, 0]
EVENT = [115, 76, 61, 39, 55, 10, 1, 0, 0]


def table():
    return BinaryTable([str(i) for i in range(9)], np.array(NONEVENT), np.array(EVENT), 7)


def test_metrics_of_printed_counts():
    m = table().metrics()
    want = {"iv": 5.04392547, "js": 0.39378376, "hellinger": 0.47248971, "triangular": 1.25592041, "gini": 0.87541620, "ks": 0.72862164, "hhi": 0.15727342, "hhi_norm": 0.05193260, "cramer_v": 0.80066760}
    for k, v in want.items():
        assert m[k] == pytest.approx(v, abs=5e-9)


def test_p_values_of_printed_counts():
    _, tests = table().analysis()
    assert tests["statistic"].tolist() == pytest.approx([0.252432, 2.432829, 2.345804, 2.669235, 29.910964, 19.324617], abs=1e-6)
    assert tests["p_value"].iloc[4] == pytest.approx(4.523477e-08, rel=1e-6)


def test_empty_table_rows_have_no_weight():
    t = table().build()
    assert t["woe"].iloc[7] == 0 and t["iv"].iloc[8] == 0 and t["count"].iloc[-1] == sum(NONEVENT) + sum(EVENT)


def test_special_functions():
    assert chi2_sf(3.841458820694124, 1) == pytest.approx(0.05)
    assert chi2_sf(5.991464547107979, 2) == pytest.approx(0.05)
    assert gamma_upper(3, 2) == pytest.approx(5 * math.exp(-2))
    assert beta_inc(2, 3, 0.4) == pytest.approx(0.5248)
    assert student_two_sided(2.2281388519649385, 10) == pytest.approx(0.05)
    assert fisher_exact(3, 1, 1, 3)[1] == pytest.approx(0.4857142857)
    assert probability_greater(10, 10, 10, 10) == pytest.approx(0.5, abs=0.01)
    assert all(math.isnan(v) for v in welch(3, 1, 0, 4, 1, 0))
    assert math.isnan(chi2_test([[0, 0], [1, 2]])[0])


@given(st.floats(0.5, 20), st.floats(0.5, 20), st.floats(0.01, 0.99))
def test_beta_inverse(a, b, p):
    assert beta_inc(a, b, beta_inc_inverse(a, b, p)) == pytest.approx(p, abs=1e-6)


@given(st.lists(st.tuples(st.integers(0, 50), st.integers(0, 50)), min_size=2, max_size=8))
def test_gini_is_that_of_all_pairs(counts):
    e, ne = np.array([c[0] for c in counts], float), np.array([c[1] for c in counts], float)
    if not e.sum() or not ne.sum() or ((e + ne) > 0).sum() < 2:
        assert stats.gini(e, ne) == 0
        return
    used = e + ne > 0
    rate = ne[used] / (e + ne)[used]
    order = np.argsort(rate, kind="stable")
    ee, nn = e[used][order], ne[used][order]
    wins = sum(ee[i] * nn[j] * (1 if j > i else 0.5 if i == j else 0) for i in range(len(ee)) for j in range(len(ee)))
    assert stats.gini(e, ne) == pytest.approx(2 * wins / (e.sum() * ne.sum()) - 1, abs=1e-9)


@given(st.lists(st.floats(0.01, 1), min_size=2, max_size=6))
def test_divergences_are_zero_for_equal_and_symmetric(p):
    p = np.array(p) / sum(p)
    q = p[::-1]
    for f in stats.DIVERGENCES.values():
        assert f(p, p).sum() == pytest.approx(0, abs=1e-12)
        assert f(p, q).sum() == pytest.approx(f(q, p).sum())


def test_trend_labels():
    for y, want in (([1], "undefined"), ([1, 2, 3], "ascending"), ([3, 2], "descending"), ([1, 3, 1], "peak (concave)"), ([0, 1, 9, 1, 0.5], "peak"), ([3, 1, 3], "valley (convex)"), ([1, 3, 1, 3], "no monotonic")):
        assert trend.label(y) == want


def test_trend_choice_of_clear_courses():
    n = np.full(10, 100)
    up = np.linspace(0.1, 0.9, 10)
    assert trend.choose("auto", up, n) == "ascending"
    assert trend.choose("auto", up[::-1], n) == "descending"
    hill = np.concatenate([np.linspace(0.1, 0.9, 5), np.linspace(0.85, 0.1, 5)])
    assert trend.choose("auto", hill, n) == "peak"
    assert trend.choose("auto_heuristic", hill, n) == "peak_heuristic"
    assert trend.choose("auto", -hill + 1, n) == "valley"
    assert trend.choose("auto_asc_desc", up, n) in ("ascending", "descending")


def test_labels():
    assert interval_labels([1, 2.5], 1) == ["(-inf, 1.0)", "[1.0, 2.5)", "[2.5, inf)"]
    assert interval_labels([]) == ["(-inf, inf)"]


def test_continuous_and_multiclass_tables():
    c = ContinuousTable(["a", "b", "m"], {"n": np.array([2.0, 2, 0]), "s": np.array([2.0, 6, 0]), "ss": np.array([2.0, 20, 0]), "min": np.array([1.0, 2, np.inf]), "max": np.array([1.0, 4, -np.inf]), "zeros": np.zeros(3)}, 2).build()
    assert c["std"].tolist()[:2] == [0, 1] and c["woe"].tolist() == [-1, 1, 0, 2]
    m = MulticlassTable(["a", "b"], np.array([[1, 2, 3], [4, 5, 6]]), ["x", "y", "z"], 2)
    assert m.build()["count"].tolist() == [6, 15, 21] and m.analysis()[0]["js"] >= 0
