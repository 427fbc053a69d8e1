"""Encoding of columns by fitted bins, as pure Column expressions.

Intervals become a balanced tree of comparisons: a row is compared about
log2(bins) times, inside generated code.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rows import is_missing, special_labels


def by_interval(x: Column, splits, leaf: Callable[[int], Column], right_closed: bool = False) -> Column:
    """``leaf(i)`` where x lies in the i-th of [.., s0), [s0, s1), ...; or of (.., s0], (s0, s1], ..."""

    def tree(a: int, b: int) -> Column:
        if a == b:
            return leaf(a)
        m = (a + b) // 2
        edge = F.lit(float(splits[m]))
        return F.when(x <= edge if right_closed else x < edge, tree(a, m)).otherwise(tree(m + 1, b))

    return tree(0, len(splits))


def by_category(x: Column, groups: list[list], leaf: Callable[[int], Column], unknown: Column) -> Column:
    out = None
    for i, group in enumerate(groups):
        if group:
            out = (F if out is None else out).when(x.isin([str(g) for g in group]), leaf(i))
    return unknown if out is None else out.otherwise(unknown)


def with_classes(x: Column, numeric: bool, special_codes, clean: Column, special: list[Column], missing: Column) -> Column:
    """``clean`` but for special and missing values; missing comes first."""
    out = F.when(is_missing(x, numeric), missing)
    for (_, codes), value in zip(special_labels(special_codes), special, strict=True):
        if codes:
            out = out.when(x.isin([float(c) for c in codes] if numeric else [str(c) for c in codes]), value)
    return out.otherwise(clean)


def override(metric: str, given, own):
    """The value of special or missing rows: their bin's own for "empirical", else the number that is given.

    For ``indices`` and ``bins`` a number replaces the index only; labels are never replaced.
    """
    if metric == "bins" or isinstance(given, str) and given == "empirical":
        return own
    if metric == "indices":
        return given if isinstance(given, int) and not isinstance(given, bool) else own
    return given


def check_overrides(metric_special, metric_missing) -> None:
    for name, value in (("metric_special", metric_special), ("metric_missing", metric_missing)):
        if isinstance(value, dict) and name == "metric_special":
            if all(isinstance(v, int | float) for v in value.values()):
                continue
        if isinstance(value, str) and value != "empirical" or not isinstance(value, str | int | float):
            raise ValueError(f'{name} is "empirical" or a number')


def polynomial(x: Column, coefficients) -> Column:
    """Horner form, highest power first."""
    out = F.lit(float(coefficients[0]))
    for c in coefficients[1:]:
        out = out * x + F.lit(float(c))
    return out


def rate_to_woe(rate: Column, n_nonevent: float, n_event: float) -> Column:
    """Weight of evidence at an event rate; null at 0 and 1."""
    return F.when((rate > 0) & (rate < 1), F.ln((1 / rate - 1) * F.lit(n_event / n_nonevent)))


def woe_to_rate(woe: Column, n_nonevent: float, n_event: float) -> Column:
    return 1 / (1 + F.lit(n_nonevent / n_event) * F.exp(woe))
