"""Optimal binning of one column against a binary, continuous or multiclass target, or over scenarios.

``fit`` aggregates the column once (two passes for very long columns), chooses
prebins, merges them by the exact partition solver and returns a model whose
``transform`` is a projection.
"""

from __future__ import annotations

import json
import math
import time
from dataclasses import asdict, dataclass, field
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.special import normal_quantile, welch
from ..plans import trend as trends
from ..plans.partition import SCALE, Problem, Solution, solve, triangle
from .encode import by_category, by_interval, check_overrides, override, with_classes
from .histogram import Histogram, add_moments, cell_edges, histogram, no_moments
from .rows import Bounds, is_missing, is_numeric, outlier_bounds, special_labels, y_quantile_bounds
from .splits import METHODS, mdlp_splits, prebin_splits
from .tables import BinaryTable, ContinuousTable, MulticlassTable, as_frame, interval_labels, rate_to_woe

TRENDS = ("auto", "auto_heuristic", "auto_asc_desc", "ascending", "descending", "convex", "concave", "peak", "valley", "peak_heuristic", "valley_heuristic")
SOLVERS = ("cp", "mip", "ls")  # names that callers may pass; all mean the same exact solver


class NotFittedError(ValueError):
    """A model was asked for before ``fit``."""


def _need(ok: bool, error: type[Exception], text: str) -> None:
    if not ok:
        raise error(text)


def distinct_values(df: DataFrame, column: str, most: int) -> list:
    """The values of a column in order; an error if there are more than ``most``."""
    found = [r[0] for r in df.select(column).distinct().limit(most + 1).collect()]
    _need(len(found) <= most, ValueError, f"{column} has more than {most} values")
    return sorted(found)


@dataclass
class BinningModel:
    """A fitted binning: bins, the moments of every row of its table, and what the fit chose."""

    name: str
    kind: str  # binary, continuous, multiclass
    dtype: str
    splits: list[float]
    groups: list[list[str]]  # categories of each bin of a categorical column
    others: list[str]  # categories below the cutoff; they have the last bin
    special_codes: Any
    classes: list
    moments: dict[str, list[float]]  # of the bins, others, special labels and Missing
    status: str = "OPTIMAL"
    trend: str | None = None
    cat_unknown: Any = None
    prebins: int = 0
    objective: int = 0
    exact: bool = True
    seconds: dict[str, float] = field(default_factory=dict)
    parameters: dict = field(default_factory=dict)

    # ------------------------------------------------ table

    @property
    def n_bins(self) -> int:
        return (len(self.groups) if self.dtype == "categorical" else len(self.splits) + 1) + bool(self.others)

    def labels(self, digits: int = 2) -> list[str]:
        if self.dtype == "categorical":
            out = ["[" + ", ".join(g) + "]" for g in self.groups] + (["[" + ", ".join(self.others) + "]"] if self.others else [])
        else:
            out = interval_labels(self.splits, digits)
        return out + [x for x, _ in special_labels(self.special_codes)] + ["Missing"]

    def table(self, digits: int = 2) -> BinaryTable | ContinuousTable | MulticlassTable:
        labels, m = self.labels(digits), {k: np.asarray(v, float) for k, v in self.moments.items()}
        if self.kind == "binary":
            return BinaryTable(labels, m["n0"], m["n1"], self.n_bins)
        if self.kind == "continuous":
            return ContinuousTable(labels, m, self.n_bins)
        return MulticlassTable(labels, np.stack([m[f"n{i}"] for i in range(len(self.classes))], axis=1), self.classes, self.n_bins)

    def binning_table(self, spark, digits: int = 2, totals: bool = True) -> DataFrame:
        return as_frame(spark, self.table(digits).build(totals))

    # ------------------------------------------------ encoding

    def _values(self, metric: str, digits: int) -> tuple[list, Any]:
        """(value of each row of the table, value of an unknown category)."""
        table, labels = self.table(digits), self.labels(digits)
        if metric == "bins":
            return labels, self.cat_unknown if isinstance(self.cat_unknown, str) else "unknown"
        if metric == "indices":
            return list(range(len(labels))), self.cat_unknown if isinstance(self.cat_unknown, int) else -1
        if self.kind == "binary" and metric in ("woe", "event_rate"):
            rate = table.n_event.sum() / max(1, table.records.sum())
            values, unknown = (table.woe, 0.0) if metric == "woe" else (table.event_rate, rate)
        elif self.kind == "continuous" and metric == "mean":
            values, unknown = table.mean, self.moments_total("s") / max(1.0, self.moments_total("n"))
        elif self.kind == "multiclass" and metric in ("mean_woe", "weighted_mean_woe"):
            per_class = np.stack([BinaryTable(labels, table.counts.sum(axis=1) - c, c, self.n_bins).woe for c in table.counts.T], axis=1)
            sums = table.counts.sum(axis=0)
            values, unknown = (per_class.mean(axis=1) if metric == "mean_woe" else per_class @ sums / sums.sum()), 0.0
        else:
            raise ValueError(f"metric {metric!r} does not fit a {self.kind} target")
        return [float(v) for v in values], float(self.cat_unknown if self.cat_unknown is not None else unknown)

    def moments_total(self, k: str) -> float:
        return float(np.sum(self.moments[k]))

    @property
    def default_metric(self) -> str:
        return {"binary": "woe", "continuous": "mean", "multiclass": "mean_woe"}[self.kind]

    def encode(self, x: Column, metric: str | None = None, metric_special=0, metric_missing=0, show_digits: int = 2) -> Column:
        """The expression that encodes ``x``."""
        metric = metric or self.default_metric
        check_overrides(metric_special, metric_missing)
        values, unknown = self._values(metric, show_digits)
        names = special_labels(self.special_codes)
        special = []
        for i, (label, _) in enumerate(names):
            given = metric_special.get(label, "empirical") if isinstance(metric_special, dict) else metric_special
            special.append(override(metric, given, values[self.n_bins + i]))
        return self.lookup(x, [*values[: self.n_bins], *special, override(metric, metric_missing, values[-1])], unknown)

    def lookup(self, x: Column, values: list, unknown) -> Column:
        """The expression that gives each row of the table, in its order, its own of ``values``."""
        numeric = self.dtype == "numerical"
        x = x.cast("double") if numeric else x.cast("string")
        leaf = lambda i: F.lit(values[i])
        if numeric:
            clean = by_interval(x, self.splits, leaf)
        else:
            clean = by_category(x, [*self.groups, self.others] if self.others else self.groups, leaf, F.lit(unknown))
        return with_classes(x, numeric, self.special_codes, clean, [F.lit(v) for v in values[self.n_bins : -1]], F.lit(values[-1]))

    def transform(self, df: DataFrame, x: str, output: str | None = None, **kwargs) -> DataFrame:
        """``df`` with ``x`` encoded, in place or as ``output``."""
        return df.withColumn(output or x, self.encode(F.col(x), **kwargs))

    # ------------------------------------------------ persistence and report

    def to_dict(self) -> dict:
        return asdict(self)

    def to_json(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as f:
            json.dump(self.to_dict(), f)

    @classmethod
    def from_dict(cls, d: dict) -> BinningModel:
        return cls(**d)

    @classmethod
    def read_json(cls, path: str) -> BinningModel:
        with open(path, encoding="utf-8") as f:
            return cls.from_dict(json.load(f))

    def information(self, print_level: int = 1) -> str:
        """Options (d marks a default, U one that was set), solver facts and timing."""
        _need(print_level in (0, 1, 2), ValueError, "print_level is 0, 1 or 2")
        lines = [f"name {self.name or 'UNKNOWN'}, target {self.kind}, status {self.status}, trend {self.trend}"]
        if print_level:
            lines.append(f"prebins {self.prebins}, bins {self.n_bins}, objective {self.objective / SCALE:.6f}")
            lines += [f"  {k} {v:.3f} s" for k, v in self.seconds.items()]
        if print_level == 2:
            defaults = {k: v for k, v in vars(type(self)).items() if k.startswith("_default")}
            lines += [f"  {k} = {v!r} {'d' if defaults.get(k) == v else 'U'}" for k, v in sorted(self.parameters.items())]
        return "\n".join(lines)


class _Binner:
    """Parameters and steps that all targets share."""

    kind = ""
    DEFAULTS: dict[str, Any] = {
        "name": "", "dtype": "numerical", "prebinning_method": "cart", "solver": "cp", "divergence": "iv", "max_n_prebins": 20,
        "min_prebin_size": 0.05, "min_n_bins": None, "max_n_bins": None, "min_bin_size": None, "max_bin_size": None,
        "min_bin_n_nonevent": None, "max_bin_n_nonevent": None, "min_bin_n_event": None, "max_bin_n_event": None,
        "monotonic_trend": "auto", "min_event_rate_diff": 0, "min_mean_diff": 0, "max_pvalue": None, "max_pvalue_policy": "consecutive",
        "gamma": 0, "outlier_detector": None, "outlier_params": None, "class_weight": None, "cat_cutoff": None, "cat_unknown": None,
        "user_splits": None, "user_splits_fixed": None, "special_codes": None, "split_digits": None, "mip_solver": "bop",
        "time_limit": 100, "verbose": False, "prebinning_kwargs": None,
    }

    def __init__(self, **parameters: Any) -> None:
        unknown = set(parameters) - set(self.DEFAULTS)
        _need(not unknown, TypeError, f"unknown parameters {sorted(unknown)}")
        self.parameters = self.DEFAULTS | parameters
        for k, v in self.parameters.items():
            setattr(self, k, v)
        self.model: BinningModel | None = None
        self._check()

    def get_params(self) -> dict:
        return dict(self.parameters)

    def _check(self) -> None:
        """Types and ranges of the parameters."""
        whole = lambda v: isinstance(v, int) and not isinstance(v, bool)
        number = lambda v: isinstance(v, int | float) and not isinstance(v, bool)
        _need(isinstance(self.name, str), TypeError, "name is a string")
        _need(self.dtype in ("numerical", "categorical"), ValueError, "dtype is numerical or categorical")
        _need(self.prebinning_method in METHODS, ValueError, f"prebinning_method is one of {METHODS}")
        _need(self.solver in SOLVERS, ValueError, f"solver is one of {SOLVERS}")
        _need(self.divergence in stats.DIVERGENCES, ValueError, f"divergence is one of {tuple(stats.DIVERGENCES)}")
        _need(whole(self.max_n_prebins) and self.max_n_prebins > 1, ValueError, "max_n_prebins is an integer above 1")
        _need(number(self.min_prebin_size) and 0 < self.min_prebin_size <= 0.5, ValueError, "min_prebin_size is in (0, 0.5]")
        for what, ok in (("n_bins", lambda v: whole(v) and v > 0), ("bin_n_nonevent", lambda v: whole(v) and v > 0), ("bin_n_event", lambda v: whole(v) and v > 0)):
            low, high = getattr(self, f"min_{what}"), getattr(self, f"max_{what}")
            _need(all(v is None or ok(v) for v in (low, high)), ValueError, f"min_{what} and max_{what} are positive integers")
            _need(low is None or high is None or low <= high, ValueError, f"min_{what} <= max_{what}")
        low, high = self.min_bin_size, self.max_bin_size
        _need(low is None or number(low) and 0 < low <= 0.5, ValueError, "min_bin_size is in (0, 0.5]")
        _need(high is None or number(high) and 0 < high <= 1, ValueError, "max_bin_size is in (0, 1]")
        _need(low is None or high is None or low <= high, ValueError, "min_bin_size <= max_bin_size")
        trend_list = self.monotonic_trend if isinstance(self.monotonic_trend, list) else [self.monotonic_trend]
        _need(all(t is None or t in TRENDS for t in trend_list), ValueError, f"monotonic_trend is one of {TRENDS} or None")
        _need(number(self.min_event_rate_diff) and 0 <= self.min_event_rate_diff <= 1, ValueError, "min_event_rate_diff is in [0, 1]")
        _need(number(self.min_mean_diff) and self.min_mean_diff >= 0, ValueError, "min_mean_diff is at least 0")
        _need(self.max_pvalue is None or number(self.max_pvalue) and 0 < self.max_pvalue <= 1, ValueError, "max_pvalue is in (0, 1]")
        _need(self.max_pvalue_policy in ("all", "consecutive"), ValueError, "max_pvalue_policy is all or consecutive")
        _need(number(self.gamma) and self.gamma >= 0, ValueError, "gamma is at least 0")
        detectors = ("range", "zscore", "yquantile") if self.kind == "continuous" else ("range", "zscore")
        _need(self.outlier_detector is None or self.outlier_detector in detectors, ValueError, f"outlier_detector is one of {detectors}")
        _need(self.outlier_params is None or isinstance(self.outlier_params, dict), TypeError, "outlier_params is a dict")
        _need(self.class_weight is None or isinstance(self.class_weight, dict) or self.class_weight == "balanced", ValueError, 'class_weight is a dict or "balanced"')
        _need(self.cat_cutoff is None or number(self.cat_cutoff) and 0 < self.cat_cutoff <= 1, ValueError, "cat_cutoff is in (0, 1]")
        _need(self.cat_unknown is None or number(self.cat_unknown) or isinstance(self.cat_unknown, str), TypeError, "cat_unknown is a number or a string")
        _need(self.user_splits is None or isinstance(self.user_splits, list | tuple | np.ndarray), TypeError, "user_splits is a list")
        if self.user_splits is not None and self.dtype == "numerical":
            _need(len(set(self.user_splits)) == len(self.user_splits), ValueError, "user_splits are unique")
        if self.user_splits_fixed is not None:
            _need(self.user_splits is not None, ValueError, "user_splits_fixed needs user_splits")
            _need(isinstance(self.user_splits_fixed, list | tuple | np.ndarray), TypeError, "user_splits_fixed is a list")
            _need(all(isinstance(v, bool | np.bool_) for v in self.user_splits_fixed), ValueError, "user_splits_fixed holds booleans")
            _need(len(self.user_splits_fixed) == len(self.user_splits), ValueError, "user_splits_fixed is as long as user_splits")
        _need(self.special_codes is None or isinstance(self.special_codes, list | tuple | np.ndarray | dict), TypeError, "special_codes is a list or a dict")
        _need(not isinstance(self.special_codes, dict) or len(self.special_codes) > 0, ValueError, "special_codes is not empty")
        _need(self.split_digits is None or whole(self.split_digits) and 0 <= self.split_digits <= 8, ValueError, "split_digits is in [0, 8]")
        _need(self.mip_solver in ("bop", "cbc"), ValueError, "mip_solver is bop or cbc")
        _need(number(self.time_limit) and self.time_limit >= 0, ValueError, "time_limit is at least 0")
        _need(isinstance(self.verbose, bool), TypeError, "verbose is a boolean")

    # ------------------------------------------------ steps

    def _class_list(self, df: DataFrame, y: str) -> list:
        return []

    def _class_weights(self, df: DataFrame, y: str) -> dict | None:
        if self.class_weight != "balanced":
            return self.class_weight
        counts = {r[0]: r[1] for r in df.where(F.col(y).isNotNull()).groupBy(y).count().collect()}
        return {c: sum(counts.values()) / (len(counts) * n) for c, n in counts.items()}

    def _bounds(self, df: DataFrame, x: str, y: str) -> Bounds | list[Bounds] | None:
        if self.outlier_detector is None or self.dtype == "categorical":
            return None
        from .rows import clean_rows

        clean = clean_rows(df.where(F.col(y).isNotNull()), x, self.special_codes)
        if self.outlier_detector == "yquantile":
            return y_quantile_bounds(clean, x, y, **(self.outlier_params or {}))
        return outlier_bounds(clean, x, self.outlier_detector, self.outlier_params)

    def fit(self, df: DataFrame, x: str, y: str, weight: str | None = None) -> BinningModel:
        """Fit on columns of ``df``; rows with a null target are left out."""
        began = time.perf_counter()
        self._check_columns(df, x, y)
        codes = self.special_codes.tolist() if isinstance(self.special_codes, np.ndarray) else self.special_codes
        edges = None
        if self.dtype == "numerical" and self.user_splits is not None:
            edges = [-math.inf, *sorted(map(float, self.user_splits)), math.inf]  # the bins themselves are enough
        elif self.dtype == "numerical":
            edges = cell_edges(df.where(~is_missing(F.col(y), is_numeric(df, y))), x, codes)
        self.classes = self._class_list(df, y)
        h = histogram(df, x, y, self.kind, weight, codes, self.classes, self._bounds(df, x, y), edges, self._class_weights(df, y), self.dtype)
        self.model = self.fit_histogram(h)
        self.model.seconds = {"aggregation": time.perf_counter() - began - self.model.seconds["optimisation"]} | self.model.seconds
        return self.model

    def fit_transform(self, df: DataFrame, x: str, y: str, weight: str | None = None, output: str | None = None, **kwargs) -> DataFrame:
        return self.fit(df, x, y, weight).transform(df, x, output, **kwargs)

    def _fitted(self) -> BinningModel:
        if self.model is None:
            raise NotFittedError("call fit first")
        return self.model

    def transform(self, df: DataFrame, x: str, output: str | None = None, **kwargs) -> DataFrame:
        return self._fitted().transform(df, x, output, **kwargs)

    @property
    def binning_table(self):
        return self._fitted().table()

    @property
    def splits(self):
        m = self._fitted()
        return m.groups if m.dtype == "categorical" else m.splits

    @property
    def status(self) -> str:
        return self._fitted().status

    def information(self, print_level: int = 1) -> str:
        return self._fitted().information(print_level)

    def _check_columns(self, df: DataFrame, x: str, y: str) -> None:
        if self.dtype == "numerical":
            _need(is_numeric(df, x), ValueError, f"{x} is not numeric; pass dtype='categorical'")

    # ------------------------------------------------ prebins

    def _rate(self, m: dict[str, np.ndarray]) -> np.ndarray:
        raise NotImplementedError

    def _impure(self, m: dict[str, np.ndarray]) -> np.ndarray:
        """Prebins that must be merged with the next one."""
        raise NotImplementedError

    def fit_histogram(self, h: Histogram) -> BinningModel:
        """The model of a histogram; everything here runs on small arrays."""
        began = time.perf_counter()
        others, groups, fixed = [], [], None
        other_moments = no_moments(h.moments)
        if self.dtype == "categorical":
            h, others, other_moments = self._cut_categories(h)
            groups, bins, fixed = self._category_prebins(h)
            splits = np.zeros(0)
        else:
            splits = self._numeric_splits(h)
            fixed = np.asarray(self.user_splits_fixed, bool)[np.argsort(np.asarray(self.user_splits, float))] if self.user_splits_fixed is not None else None
            if self.split_digits is not None:
                splits = np.unique(np.round(splits, self.split_digits))
            bins = h.by_split(splits)
        n = len(next(iter(bins.values())))
        # merge impure prebins to the right, the last one to the left, until none is left
        cuts = np.arange(n - 1)  # prebin boundaries that remain, by their left side
        starts = np.arange(n)
        while len(cuts) and (bad := self._impure(bins)).any():
            drop = bad[:-1].copy()
            drop[-1] |= bad[-1]
            if fixed is not None and (fixed & drop).any():
                raise ValueError("a fixed split is removed because its bin is pure")
            keep = ~drop
            fixed = fixed[keep] if fixed is not None else None
            cuts, splits = cuts[keep], splits[keep] if len(splits) else splits
            group = np.concatenate([[0], np.cumsum(keep)])
            bins = _merge(bins, group)
            starts = starts[np.concatenate([[True], keep])]
        merged_groups = [[c for g in groups[a:b] for c in g] for a, b in zip(starts, [*starts[1:], n], strict=True)] if groups else []
        solution, trend = self._optimise(bins, h.total, fixed)
        ends = solution.ends
        m = len(next(iter(bins.values())))
        group = np.searchsorted(np.asarray(ends), np.arange(m), side="left")
        final = _merge(bins, group)
        rows = {k: [*final[k].tolist(), *([other_moments[k]] if others else []), *[s[k] for s in h.special], h.missing[k]] for k in final}
        final_groups = [[c for g in merged_groups[a:b] for c in g] for a, b in zip([0, *[e + 1 for e in ends[:-1]]], [e + 1 for e in ends], strict=True)] if groups else []
        codes = self.special_codes.tolist() if isinstance(self.special_codes, np.ndarray) else self.special_codes
        return BinningModel(
            self.name, self.kind, self.dtype, [float(splits[e]) for e in ends[:-1]] if self.dtype == "numerical" else [], final_groups, [str(c) for c in others], codes,
            list(getattr(self, "classes", [])), rows, solution.status, trend, self.cat_unknown, m, solution.value, h.exact,
            {"optimisation": time.perf_counter() - began}, {k: v for k, v in self.parameters.items() if isinstance(v, int | float | str | bool | type(None))},
        )

    def _numeric_splits(self, h: Histogram) -> np.ndarray:
        if self.user_splits is not None:
            return np.sort(np.asarray(self.user_splits, float))
        least = min(0.5, math.ceil(self.min_prebin_size * h.total) / max(1e-300, h.size().sum())) * h.size().sum()
        kind = "continuous" if self.kind == "continuous" else "binary"
        return prebin_splits(h, kind, self.prebinning_method, self.max_n_prebins, least, **(self.prebinning_kwargs or {}))

    def _cut_categories(self, h: Histogram) -> tuple[Histogram, list, dict]:
        """Categories with fewer than ceil(cutoff * clean rows) rows are set aside."""
        if not self.cat_cutoff:
            return h, [], no_moments(h.moments)
        size = h.size()
        small = size < math.ceil(self.cat_cutoff * size.sum())
        _need(not small.all(), ValueError, "cat_cutoff leaves no category")
        aside = no_moments(h.moments)
        for i in np.flatnonzero(small):
            aside = add_moments(aside, {k: float(v[i]) for k, v in h.moments.items()})
        kept = Histogram(h.numeric, h.low[~small], h.high[~small], {k: v[~small] for k, v in h.moments.items()}, h.missing, h.special, h.rows)
        return kept, h.low[small].tolist(), aside

    def _category_prebins(self, h: Histogram) -> tuple[list[list[str]], dict, np.ndarray | None]:
        """Categories in the order of their rate, grouped by splits of the rank or by the user."""
        rate = self._rate(h.moments)
        order = np.lexsort((h.low.astype(str), rate))
        if self.user_splits is not None:
            given = [[str(c) for c in (g if isinstance(g, list | tuple | np.ndarray) else [g])] for g in self.user_splits]
            flat = [c for g in given for c in g]
            _need(len(flat) == len(set(flat)), ValueError, "a category is in several user_splits")
            number = {c: i for i, g in enumerate(given) for c in g}
            at = np.array([number.get(c, len(given)) for c in h.low.tolist()], int)
            n = len(given) + bool((at == len(given)).any())
            bins = h.by_group(at, n)
            groups = [*given, [c for c in h.low.tolist() if c not in number]][:n]
            by_rate = np.argsort(self._rate(bins), kind="stable")
            fixed = np.asarray([*self.user_splits_fixed, False][:n], bool)[by_rate][: n - 1] if self.user_splits_fixed is not None else None
            return [groups[i] for i in by_rate], {k: v[by_rate] for k, v in bins.items()}, fixed
        ranks = Histogram(True, np.arange(len(order), dtype=float), np.arange(len(order), dtype=float), {k: v[order] for k, v in h.moments.items()}, h.missing, h.special, h.rows)
        least = min(0.5, math.ceil(self.min_prebin_size * h.total) / max(1e-300, h.size().sum())) * h.size().sum()
        splits = prebin_splits(ranks, "continuous" if self.kind == "continuous" else "binary", self.prebinning_method, self.max_n_prebins, least, **(self.prebinning_kwargs or {}))
        at = np.searchsorted(splits, np.arange(len(order)), side="right")
        names = h.low[order].tolist()
        return [[c for c, g in zip(names, at, strict=True) if g == i] for i in range(len(splits) + 1)], ranks.by_split(splits), None

    # ------------------------------------------------ optimisation

    def _optimise(self, bins: dict[str, np.ndarray], total: float, fixed: np.ndarray | None) -> tuple[Solution, str | None]:
        n = len(next(iter(bins.values())))
        if n <= 1:
            return Solution([0], 0, "OPTIMAL"), None
        problem = self._problem(bins, total)
        size = problem.size
        if self.min_bin_size is not None:
            problem.allowed &= size >= math.ceil(self.min_bin_size * total)
        if self.max_bin_size is not None:
            problem.allowed &= size <= math.ceil(self.max_bin_size * total)
        problem.min_bins, problem.max_bins, problem.time_limit = self.min_n_bins, self.max_n_bins, self.time_limit
        if fixed is not None:
            problem.fixed = np.flatnonzero(fixed).tolist()
        if self.gamma and self.kind == "binary":
            problem.gamma = math.ceil(SCALE * self.gamma / size[n - 1][0])
        return solve(problem), problem.trends[0] if len(problem.trends) == 1 else ",".join(str(t) for t in problem.trends)

    def _problem(self, bins: dict[str, np.ndarray], total: float) -> Problem:
        raise NotImplementedError

    def _pick_trend(self, wanted: str | None, rates: np.ndarray, records: np.ndarray) -> str | None:
        if wanted is None:
            return None
        if self.dtype == "categorical":
            return "ascending"  # categories stand in the order of their rate
        return trends.choose(wanted, rates, records) if wanted.startswith("auto") else wanted

    def _turn(self, trend: str | None, rates: np.ndarray) -> int | None:
        return {"peak_heuristic": int(np.argmax(rates)), "valley_heuristic": int(np.argmin(rates))}.get(trend or "")


def _merge(bins: dict[str, np.ndarray], group: np.ndarray) -> dict[str, np.ndarray]:
    n = int(group[-1]) + 1
    out = {}
    for k, v in bins.items():
        if k in ("min", "max"):
            out[k] = np.full(n, np.inf if k == "min" else -np.inf)
            (np.minimum if k == "min" else np.maximum).at(out[k], group, v)
        else:
            out[k] = np.bincount(group, v, minlength=n)
    return out


def _scaled(x: np.ndarray) -> np.ndarray:
    return np.trunc(x * SCALE).astype(np.int64)


def _divide(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.zeros(np.broadcast(a, b).shape), where=b > 0)


class BinaryBinner(_Binner):
    """Binning against 0 (nonevent) and anything else (event)."""

    kind = "binary"

    def _rate(self, m):
        return _divide(m["n1"], m["n0"] + m["n1"])

    def _impure(self, m):
        if self.divergence in ("hellinger", "triangular"):
            return (m["n0"] + m["n1"]) == 0
        return (m["n0"].astype(np.int64) == 0) | (m["n1"].astype(np.int64) == 0)

    def _problem(self, bins, total):
        n0, n1 = np.trunc(bins["n0"]), np.trunc(bins["n1"])
        if self.divergence in ("hellinger", "triangular"):
            n0, n1 = np.maximum(n0, 1), np.maximum(n1, 1)
        t0, t1 = np.maximum(triangle(n0), 0), np.maximum(triangle(n1), 0)
        n = len(n0)
        rate = _scaled(_divide(t1, t0 + t1))
        value = _scaled(stats.DIVERGENCES[self.divergence](_divide(t1, np.float64(n1.sum())), _divide(t0, np.float64(n0.sum()))))
        trend = self._pick_trend(self.monotonic_trend, self._rate({"n0": n0, "n1": n1}), n0 + n1)
        turn = self._turn(trend, n1 / (n0 + n1))
        allowed = np.ones((n, n), bool)
        for low, high, t in ((self.min_bin_n_nonevent, self.max_bin_n_nonevent, t0), (self.min_bin_n_event, self.max_bin_n_event, t1)):
            if low is not None:
                allowed &= t >= low
            if high is not None:
                allowed &= t <= high
        conflict = None
        if self.max_pvalue is not None:
            z = normal_quantile(1 - self.max_pvalue / 2)

            def conflict(a, b, c, d):
                return _proportions_alike(t1[b][a], t0[b][a], t1[d][c], t0[d][c], z)

        return Problem(
            value, [rate], [trend], t0 + t1, allowed, min_diff=int(self.min_event_rate_diff * SCALE), changes=[turn],
            conflict=conflict, all_pairs=self.max_pvalue_policy == "all",
        )


def _proportions_alike(e1: float, ne1: float, e2: float, ne2: float, z: float) -> bool:
    """Whether the pooled test of two proportions stays below z."""
    n1, n2 = e1 + ne1, e2 + ne2
    p1, p2, pooled = e1 / n1, e2 / n2, (e1 + e2) / (n1 + n2)
    spread = math.sqrt(pooled * (1 - pooled) * (1 / n1 + 1 / n2))
    return spread == 0 or abs(p1 - p2) / spread < z


class ContinuousBinner(_Binner):
    """Binning against a number."""

    kind = "continuous"

    def _rate(self, m):
        return _divide(m["s"], m["n"])

    def _impure(self, m):
        return m["n"] == 0

    def _problem(self, bins, total):
        n, s, ss = (triangle(bins[k]) for k in ("n", "s", "ss"))
        k = len(bins["n"])
        mean = _divide(s, n)
        value = _scaled(np.abs(mean - bins["s"].sum() / bins["n"].sum()))
        rates = self._rate(bins)
        trend = self._pick_trend(self.monotonic_trend, rates, bins["n"])
        conflict = None
        if self.max_pvalue is not None:
            std = np.sqrt(np.maximum(_divide(ss, n) - mean**2, 0))

            def conflict(a, b, c, d):
                _, p = welch(n[b][a], mean[b][a], std[b][a], n[d][c], mean[d][c], std[d][c])
                return p > self.max_pvalue

        return Problem(
            value, [_scaled(mean)], [trend], n, np.ones((k, k), bool), min_diff=int(self.min_mean_diff * SCALE),
            changes=[self._turn(trend, rates)], conflict=conflict, all_pairs=self.max_pvalue_policy == "all",
        )


class MulticlassBinner(_Binner):
    """Binning of a numeric column against class labels; a trend for each class."""

    kind = "multiclass"
    MAX_CLASSES = 100

    def _class_list(self, df, y):
        return distinct_values(df.where(F.col(y).isNotNull()), y, self.MAX_CLASSES)

    def _check_columns(self, df, x, y):
        _need(self.dtype == "numerical" and is_numeric(df, x), ValueError, "a multiclass target needs a numeric column")

    def _impure(self, m):
        counts = np.stack(list(m.values()), axis=1)
        return ((counts == 0) | (counts == counts.sum(axis=1, keepdims=True))).any(axis=1)

    def _problem(self, bins, total):
        counts = [np.trunc(v) for v in bins.values()]
        size = np.sum(counts, axis=0)
        k = len(size)
        whole = triangle(size)
        wanted = self.monotonic_trend if isinstance(self.monotonic_trend, list) else [self.monotonic_trend] * len(counts)
        value, rates, chosen, changes = np.zeros((k, k), np.int64), [], [], []
        for c, want in zip(counts, wanted, strict=True):
            t1 = triangle(c)
            t0 = whole - t1
            rate = _scaled(_divide(t1, whole))
            used = (t0 > 0) & (t1 > 0)
            iv = np.zeros((k, k))
            iv[used] = stats.jeffrey(t1[used] / c.sum(), t0[used] / (size - c).sum())
            value += _scaled(iv)
            own = c / size
            trend = trends.choose(want, own, size) if want and want.startswith("auto") else want
            if not isinstance(self.monotonic_trend, list):
                trend = trend and trend.removesuffix("_heuristic")  # change points exist for a list of trends only
            turn = self._turn(trend, own)
            rates.append(rate)
            chosen.append(trend)
            changes.append(turn)
        conflict = None
        if self.max_pvalue is not None:
            z = normal_quantile(1 - self.max_pvalue / 2)

            sums = [triangle(c) for c in counts]

            def conflict(a, b, c, d):
                return any(_proportions_alike(t[b][a], whole[b][a] - t[b][a], t[d][c], whole[d][c] - t[d][c], z) for t in sums)

        return Problem(
            value, rates, chosen, whole, np.ones((k, k), bool), min_diff=int(self.min_event_rate_diff * SCALE), changes=changes,
            conflict=conflict, all_pairs=self.max_pvalue_policy == "all",
        )


class ScenarioBinner(BinaryBinner):
    """One binning for several scenarios of a binary target: the weighted sum of their values under rules that hold in each."""

    kind = "scenario"

    def fit(self, df: DataFrame, x: str, y: str, scenario: str, weights: dict | None = None) -> BinningModel:
        """``scenario`` names the column of the scenario; ``weights`` are equal by default."""
        began = time.perf_counter()
        names = distinct_values(df, scenario, 100)
        self.scenarios, self.weights = names, [float((weights or {}).get(s, 1.0)) for s in names]
        _need(all(w >= 0 for w in self.weights) and sum(self.weights) > 0, ValueError, "weights are not negative")
        target = F.struct(F.col(scenario).alias("s"), F.when(F.col(y) == 0, 0).otherwise(1).alias("y"))
        both = df.where(F.col(y).isNotNull()).select(F.col(x).alias("x"), F.concat_ws("|", target["s"].cast("string"), target["y"].cast("string")).alias("y"))
        classes = [f"{s}|{e}" for s in names for e in (0, 1)]
        edges = [-math.inf, *sorted(map(float, self.user_splits)), math.inf] if self.user_splits is not None else cell_edges(both, "x", self.special_codes)
        h = histogram(both, "x", "y", "multiclass", None, self.special_codes, classes, None, edges, None, self.dtype)
        self.classes = []
        wide = self.fit_histogram(h)
        self.wide = wide
        weight = np.repeat(self.weights, 2)
        sums = {f"n{e}": (weight[e::2, None] * np.array([wide.moments[f"n{2 * i + e}"] for i in range(len(names))])).sum(axis=0).tolist() for e in (0, 1)}
        self.model = BinningModel(**(asdict(wide) | {"kind": "binary", "moments": sums}))
        self.model.seconds = {"total": time.perf_counter() - began}
        return self.model

    def scenario_table(self, scenario) -> BinaryTable:
        """The binning table of one scenario."""
        i = self.scenarios.index(scenario)
        return BinaryTable(self._fitted().labels(), np.asarray(self.wide.moments[f"n{2 * i}"]), np.asarray(self.wide.moments[f"n{2 * i + 1}"]), self.wide.n_bins)

    def _pairs(self, m):
        return [(m[f"n{2 * i}"], m[f"n{2 * i + 1}"]) for i in range(len(self.scenarios))]

    def _rate(self, m):
        e, n = sum(b for _, b in self._pairs(m)), sum(a + b for a, b in self._pairs(m))
        return _divide(e, n)

    def _impure(self, m):
        return np.any([(a == 0) | (b == 0) for a, b in self._pairs(m)], axis=0)

    def _problem(self, bins, total):
        pairs = self._pairs(bins)
        k = len(pairs[0][0])
        value, rates, size = np.zeros((k, k), np.int64), [], np.zeros((k, k))
        for (a, b), w in zip(pairs, self.weights, strict=True):
            t0, t1 = triangle(a), triangle(b)
            rates.append(_scaled(_divide(t1, t0 + t1)))
            value += _scaled(w * stats.DIVERGENCES[self.divergence](_divide(np.maximum(t1, 0), b.sum()), _divide(np.maximum(t0, 0), a.sum())))
            size += t0 + t1
        trend = self.monotonic_trend
        if trend and trend.startswith("auto"):
            trend = self._pick_trend(trend, self._rate(bins), sum(a + b for a, b in pairs))
        turns = [self._turn(trend, _divide(b, a + b)) for a, b in pairs]
        conflict = None
        if self.max_pvalue is not None:
            z = normal_quantile(1 - self.max_pvalue / 2)
            sides = [(triangle(a), triangle(b)) for a, b in pairs]

            def conflict(a, b, c, d):
                return any(_proportions_alike(t1[b][a], t0[b][a], t1[d][c], t0[d][c], z) for t0, t1 in sides)

        return Problem(
            value, rates, [trend] * len(rates), size, np.ones((k, k), bool), min_diff=int(self.min_event_rate_diff * SCALE), changes=turns,
            conflict=conflict, all_pairs=self.max_pvalue_policy == "all",
        )


class MDLP:
    """Minimum-description-length splits of a numeric column."""

    def __init__(self, min_samples_split: int = 2, min_samples_leaf: int = 2, max_candidates: int = 32) -> None:
        _need(all(isinstance(v, int) and v > 0 for v in (min_samples_split, min_samples_leaf, max_candidates)), ValueError, "parameters are positive integers")
        self.parameters = (min_samples_split, min_samples_leaf, max_candidates)
        self.splits: np.ndarray | None = None

    def fit(self, df: DataFrame, x: str, y: str) -> MDLP:
        classes = distinct_values(df.where(F.col(y).isNotNull()), y, 100)
        self.splits = mdlp_splits(histogram(df, x, y, "multiclass", classes=classes, edges=cell_edges(df, x)), *self.parameters)
        return self


def summary_row(model: BinningModel) -> dict[str, Any]:
    return {"name": model.name, "dtype": model.dtype, "status": model.status, "n_bins": model.n_bins, **model.table().metrics()}


def summary(models: list[BinningModel]) -> pd.DataFrame:
    return pd.DataFrame([summary_row(m) for m in models])


__all__ = ["BinaryBinner", "BinningModel", "ContinuousBinner", "MDLP", "MulticlassBinner", "NotFittedError", "ScenarioBinner", "rate_to_woe", "summary"]
