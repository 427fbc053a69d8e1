"""Special functions and tail probabilities, in plain Python."""

from __future__ import annotations

import math
from statistics import NormalDist


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function Q(a, x)."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:  # series of the lower function
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return 1.0 - front * total
    # continued fraction, modified Lentz
    b, c = x + 1 - a, 1e300
    d = h = 1.0 / b
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1.0 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return front * h


def chi2_sf(t: float, dof: int) -> float:
    if dof == 1:
        return math.erfc(math.sqrt(max(t, 0.0) / 2))
    return gamma_upper(dof / 2, t / 2)


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function I_x(a, b)."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1.0 / ((1 - (a + b) * x / (a + 1)) or 1e-300)
    h = d
    for m in range(1, 10_000):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 / ((1 + top * d) or 1e-300)
            c = (1 + top / c) or 1e-300
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * h


def beta_inc_inverse(a: float, b: float, p: float) -> float:
    low, high = 0.0, 1.0
    for _ in range(200):
        middle = (low + high) / 2
        if beta_inc(a, b, middle) < p:
            low = middle
        else:
            high = middle
        if high - low < 1e-15:
            break
    return (low + high) / 2


def student_two_sided(t: float, dof: float) -> float:
    if math.isnan(t) or math.isnan(dof) or dof <= 0:
        return math.nan
    return beta_inc(dof / 2, 0.5, dof / (dof + t * t))


def welch(n1: float, m1: float, s1: float, n2: float, m2: float, s2: float) -> tuple[float, float]:
    """(t, two-sided p) of Welch's test from counts, means and standard deviations."""
    v1, v2 = s1 * s1 / n1, s2 * s2 / n2
    if v1 + v2 == 0:
        return math.nan, math.nan
    t = (m1 - m2) / math.sqrt(v1 + v2)
    if n1 <= 1 or n2 <= 1:
        return t, math.nan
    dof = (v1 + v2) ** 2 / (v1 * v1 / (n1 - 1) + v2 * v2 / (n2 - 1))
    return t, student_two_sided(t, dof)


def chi2_test(table: list[list[float]]) -> tuple[float, float]:
    """(statistic, p) of Pearson's test without correction; empty rows and columns give nan."""
    rows, columns = [sum(r) for r in table], [sum(c) for c in zip(*table, strict=True)]
    n = sum(rows)
    if not n or 0 in rows or 0 in columns:
        return math.nan, math.nan
    t = sum((x - r * c / n) ** 2 / (r * c / n) for row, r in zip(table, rows, strict=True) for x, c in zip(row, columns, strict=True))
    return t, chi2_sf(t, (len(rows) - 1) * (len(columns) - 1))


def fisher_exact(a: int, b: int, c: int, d: int) -> tuple[float, float]:
    """(odds ratio, two-sided p) of Fisher's exact test on [[a, b], [c, d]]."""
    row, column, n = a + b, a + c, a + b + c + d
    choose = lambda m, k: math.lgamma(m + 1) - math.lgamma(k + 1) - math.lgamma(m - k + 1)
    log_p = lambda x: choose(column, x) + choose(n - column, row - x) - choose(n, row)
    own = log_p(a)
    low, high = max(0, row + column - n), min(row, column)
    p = sum(math.exp(q) for x in range(low, high + 1) if (q := log_p(x)) <= own + 1e-7)
    odds = math.inf if b * c == 0 and a * d > 0 else a * d / (b * c) if b * c else math.nan
    return odds, min(1.0, p)


def probability_greater(e1: float, n1: float, e2: float, n2: float, samples: int = 100) -> float:
    """P[A > B] of two beta posteriors with uniform priors, by stratified points of A."""
    a, b, c, d = e1 + 1, n1 + 1, e2 + 1, n2 + 1
    return sum(beta_inc(c, d, beta_inc_inverse(a, b, (i + 0.5) / samples)) for i in range(samples)) / samples
