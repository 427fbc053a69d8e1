"""Divergences, concentration and association measures on small arrays of counts."""

from __future__ import annotations

import math

import numpy as np

from .special import chi2_test

#: IV at which the quality score of a binary table has its maximum factor (fixed value).
BEST_IV = 0.39573882


def _log_terms(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """x ln(x / y), 0 where x is 0."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(x > 0, x * np.log(x / y), 0.0)


def entropy(p) -> float:
    p = np.asarray(p, float)
    return float(-_log_terms(p, np.ones_like(p)).sum())


def kullback_leibler(x, y) -> np.ndarray:
    return _log_terms(np.asarray(x, float), np.asarray(y, float))


def jeffrey(x, y) -> np.ndarray:
    """Terms of the information value."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    return kullback_leibler(x, y) + kullback_leibler(y, x)


def jensen_shannon(x, y) -> np.ndarray:
    x, y = np.asarray(x, float), np.asarray(y, float)
    middle = (x + y) / 2
    return (kullback_leibler(x, middle) + kullback_leibler(y, middle)) / 2


def hellinger(x, y) -> np.ndarray:
    return 0.5 * (np.sqrt(np.asarray(x, float)) - np.sqrt(np.asarray(y, float))) ** 2


def triangular(x, y) -> np.ndarray:
    x, y = np.asarray(x, float), np.asarray(y, float)
    total = x + y
    return np.divide((x - y) ** 2, total, out=np.zeros_like(total), where=total > 0)


DIVERGENCES = {"iv": jeffrey, "js": jensen_shannon, "hellinger": hellinger, "triangular": triangular}


def jensen_shannon_multivariate(columns: np.ndarray, weights=None) -> float:
    """Of distributions in columns: the entropy of their mixture less their mean entropy."""
    columns = np.asarray(columns, float)
    weights = np.full(columns.shape[1], 1 / columns.shape[1]) if weights is None else np.asarray(weights, float)
    return entropy(columns @ weights) - sum(w * entropy(c) for w, c in zip(weights, columns.T, strict=True))


def gini(event, nonevent) -> float:
    """Of binned counts, bins in the order of their share of nonevents; 0 for one bin."""
    e, ne = np.asarray(event, float), np.asarray(nonevent, float)
    used = e + ne > 0
    e, ne = e[used], ne[used]
    if len(e) < 2 or not e.sum() or not ne.sum():
        return 0.0
    order = np.argsort(ne / (e + ne), kind="stable")
    e, ne = e[order], ne[order]
    below = np.cumsum(ne) - ne
    return float(1 - (e * (ne + 2 * below)).sum() / (e.sum() * ne.sum()))


def hhi(shares, normalized: bool = False) -> float:
    shares = np.asarray(shares, float)
    h, n = float((shares**2).sum()), len(shares)
    if not normalized:
        return h
    return 1.0 if n == 1 else (h - 1 / n) / (1 - 1 / n)


def cramer_v(table) -> float:
    """Of a table of counts with bins in rows; empty bins are left out."""
    rows = [list(r) for r in np.asarray(table, float) if sum(r) > 0]
    if len(rows) < 2:
        return 0.0
    t, _ = chi2_test(rows)
    n, k = sum(map(sum, rows)), min(len(rows), len(rows[0])) - 1
    return math.sqrt(t / n / k) if k > 0 and not math.isnan(t) else 0.0


def _support(p_values) -> float:
    return float(np.prod([1 - p for p in p_values if not math.isnan(p)])) if len(p_values) else 1.0


def quality_binary(iv: float, p_values, hhi_norm: float) -> float:
    return iv / BEST_IV * math.exp(0.5 * (1 - (iv / BEST_IV) ** 2)) * _support(p_values) * (1 - hhi_norm)


def quality_multiclass(js: float, n_classes: int, p_values, hhi_norm: float) -> float:
    return quality_binary(js / math.log(n_classes), p_values, hhi_norm)


def quality_continuous(relative_woe: float, p_values, hhi_norm: float) -> float:
    factor = max(1 - 1 / relative_woe, 0.0) if relative_woe > 0 else 0.0
    return factor * _support(p_values) * (1 - hhi_norm)
