"""Piecewise polynomials over optimal bins.

Least squares needs power sums by bin only, which one aggregation gives; the
other objectives reweight rows and aggregate again, a few times.  Continuity is
an equality constraint; trends are linear inequalities, so the curve is the
optimum among those with the trend.  Peaks and valleys turn at the best split.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from . import evaluate
from .binning import BinaryBinner, BinningModel, ContinuousBinner, NotFittedError, _need
from .encode import by_interval, override, polynomial, with_classes
from .rows import clean_rows, special_labels
from .scorecard import LogisticModel
from .tables import as_frame

OBJECTIVES = ("l2", "l1", "huber", "quantile")
ROUNDS = 15  # of reweighting


def nonnegative_least_squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x >= 0 with the least ||a x - b||: free variables join one at a time while that helps, and leave when they turn negative."""
    x, free = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    slack = 1e-10 * max(1.0, float(np.abs(a.T @ b).max(initial=0.0)))
    for _ in range(30 * a.shape[1] + 1):
        gain = np.where(free, -np.inf, a.T @ (b - a @ x))
        if free.all() or gain.max() <= slack:
            break
        free[gain.argmax()] = True
        while True:
            new = np.zeros(len(x))
            new[free] = np.linalg.lstsq(a[:, free], b, rcond=None)[0]
            low = free & (new <= 0)
            if not low.any():
                break
            step = (x[low] / np.maximum(x[low] - new[low], 1e-300)).min()
            x += step * (new - x)
            free &= x > 1e-14
            x[~free] = 0.0
        x = new
    return x


def _least(a: np.ndarray, b: np.ndarray, equal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """x with the least x'ax / 2 - b'x where ``equal`` x = 0 and ``above`` x >= 0.

    The equalities are eliminated; the multipliers of the inequalities solve a least squares problem in
    the metric of the rest.
    """
    space = np.eye(len(b))
    if len(equal):
        _, size, basis = np.linalg.svd(equal)
        space = basis[int((size > 1e-12 * size[0]).sum()) :].T
    h = space.T @ a @ space
    free = space @ np.linalg.lstsq(h, space.T @ b, rcond=None)[0]
    if (above @ free >= -1e-9).all():
        return free
    root = _root(h)
    goal = np.linalg.solve(root, space.T @ b)
    sides = above @ space
    sides = sides[np.linalg.norm(sides, axis=1) > 1e-12]
    sides = np.linalg.solve(root, (sides / np.linalg.norm(sides, axis=1, keepdims=True)).T)
    return space @ np.linalg.solve(root.T, goal + sides @ nonnegative_least_squares(sides, -goal))


def _root(h: np.ndarray) -> np.ndarray:
    """The Cholesky factor; the diagonal grows a little where bins hold too few values."""
    more = 0.0
    while True:
        try:
            return np.linalg.cholesky(h + more * np.eye(len(h)))
        except np.linalg.LinAlgError:
            more = max(10 * more, 1e-14 * max(1e-300, np.trace(h)))


def _powers(degree: int, x: float, order: int) -> np.ndarray:
    """The derivative of that order of each power at x."""
    return np.array([float(np.prod(range(p - order + 1, p + 1))) * x ** (p - order) if p >= order else 0.0 for p in range(degree + 1)])


def _joints(splits: list[float], degree: int, order: int) -> np.ndarray:
    """Rows that give the rise of a derivative at each split."""
    k = degree + 1
    out = np.zeros((len(splits), (len(splits) + 1) * k))
    for i, s in enumerate(splits):
        out[i, i * k : (i + 1) * k], out[i, (i + 1) * k : (i + 2) * k] = -_powers(degree, s, order), _powers(degree, s, order)
    return out


def trend_rows(splits: list[float], degree: int, trend: str, change: int = 0) -> np.ndarray:
    """Rows that are not negative on a curve with the trend, on the scaled range from -1 to 1.

    Slopes are bounded at the ends and at seven places inside each bin, which is exact up to degree 2.
    Curves also rise or fall from bin to bin.  Peaks and valleys turn at the start of bin ``change``.
    Slopes, or with degree 0 the steps, of convex curves rise.
    """
    m, k = len(splits) + 1, degree + 1
    edges = [-1.0, *splits, 1.0]
    jumps = _joints(splits, degree, 0)
    if trend in ("convex", "concave"):
        if degree == 0:
            middle = [(edges[i] + edges[i + 1]) / 2 for i in range(m)]
            steps = jumps / np.diff(middle)[:, None] if m > 1 else jumps
            bends = np.diff(steps, axis=0)
        else:
            bends = _joints(splits, degree, 1)
        return bends if trend == "convex" else -bends
    first = {"ascending": 1, "descending": -1, "peak": 1, "valley": -1}[trend]
    sign = [first if trend in ("ascending", "descending") or i < change else -first for i in range(m)]
    out = [np.zeros((0, m * k))]
    for i in range(m):
        places = np.linspace(edges[i], edges[i + 1], 9 if degree > 1 else 1) if degree else []
        for x in places:
            row = np.zeros((1, m * k))
            row[0, i * k : (i + 1) * k] = sign[i] * _powers(degree, x, 1)
            out.append(row)
    # with the turn at the start of a bin the curve may step either way there, but not for steps of degree 0
    out += [jumps[i : i + 1] * sign[i + 1] for i in range(m - 1) if sign[i] == sign[i + 1] or degree == 0]
    return np.concatenate(out)


def _solve(sums: list[tuple[np.ndarray, np.ndarray]], splits: list[float], degree: int, continuous: bool, smooth: bool, ridge: np.ndarray, trend: str | None) -> list[np.ndarray]:
    """Coefficients by rising power in each bin; ``ridge`` is the price of each squared coefficient."""
    m, k = len(sums), degree + 1
    a, b = np.zeros((m * k, m * k)), np.zeros(m * k)
    for i, (moments, cross) in enumerate(sums):
        part = np.array([[moments[p + q] for q in range(k)] for p in range(k)])
        a[i * k : (i + 1) * k, i * k : (i + 1) * k] = part + np.diag(ridge[i * k : (i + 1) * k])
        b[i * k : (i + 1) * k] = cross[:k]
    orders = ([0] if continuous else []) + ([1] if continuous and smooth and degree > 1 else [])
    equal = np.concatenate([np.zeros((0, m * k)), *[_joints(splits, degree, d) for d in orders]])
    changes = range(m + 1) if trend in ("peak", "valley") else [0]
    found = [_least(a, b, equal, trend_rows(splits, degree, trend, t) if trend else np.zeros((0, m * k))) for t in changes]
    x = min(found, key=lambda v: float(v @ a @ v / 2 - b @ v))
    return [x[i * k : (i + 1) * k] for i in range(m)]


@dataclass
class PiecewiseModel:
    """Coefficients of the scaled value (x - shift) / width by rising power, in each bin."""

    model: BinningModel
    coefficients: list[list[float]]
    shift: float
    width: float
    low: float | None
    high: float | None

    def curve(self, x: Column) -> Column:
        z = (x.cast("double") - F.lit(self.shift)) / F.lit(self.width)
        out = by_interval(x.cast("double"), self.model.splits, lambda i: polynomial(z, self.coefficients[i][::-1]))
        if self.low is not None:
            out = F.greatest(out, F.lit(float(self.low)))
        return out if self.high is None else F.least(out, F.lit(float(self.high)))

    def encode(self, x: Column, metric: str | None = None, metric_special=0, metric_missing=0) -> Column:
        table = self.model.table()
        binary = self.model.kind == "binary"
        metric = metric or ("woe" if binary else "mean")
        _need(metric in (("woe", "event_rate") if binary else ("mean",)), ValueError, f"metric {metric!r} does not fit")
        value = self.curve(x)
        if metric == "woe":
            e, ne = float(table.n_event.sum()), float(table.n_nonevent.sum())
            p = F.least(F.greatest(value, F.lit(1e-9)), F.lit(1 - 1e-9))
            value = F.ln((1 / p - 1) * F.lit(e / ne))
        own = {"woe": lambda: table.woe, "event_rate": lambda: table.event_rate, "mean": lambda: table.mean}[metric]()
        n = self.model.n_bins
        special = [F.lit(float(override(metric, metric_special, float(own[n + i])))) for i in range(len(special_labels(self.model.special_codes)))]
        return with_classes(x.cast("double"), True, self.model.special_codes, value, special, F.lit(float(override(metric, metric_missing, float(own[-1])))))

    def transform(self, df: DataFrame, x: str, output: str, **kwargs) -> DataFrame:
        return df.withColumn(output, self.encode(F.col(x), **kwargs))

    def binning_table(self, spark, digits: int = 2) -> DataFrame:
        """The table of the bins with coefficients ``c0..cd`` of powers of x."""
        t = self.model.table(digits).build(totals=False)
        for p, column in enumerate(zip(*self._plain(), strict=True)):
            t[f"c{p}"] = [*map(float, column), *[None] * (len(t) - len(column))]
        return as_frame(spark, t)

    def _plain(self) -> list[np.ndarray]:
        """Coefficients of powers of x itself."""
        line = np.array([-self.shift / self.width, 1 / self.width])
        out = []
        for c in self.coefficients:
            total, power = np.zeros(len(c)), np.array([1.0])
            for v in c:
                total[: len(power)] += v * power
                power = np.convolve(power, line)
            out.append(total)
        return out

    def metrics(self, df: DataFrame, x: str, y: str) -> DataFrame:
        """Of the predictions over all rows with empirical special and missing rows."""
        metric = "event_rate" if self.model.kind == "binary" else "mean"
        rows = df.withColumn("_p", self.encode(F.col(x), metric, "empirical", "empirical"))
        if metric == "mean":
            return evaluate.regression(rows, y, "_p")
        e = (F.col(y) != 0).cast("double")
        parts = (rows.agg(F.avg((F.col("_p") - e) ** 2).alias("brier")), self.divergences(rows, "_p"), evaluate.auc(rows, y, "_p"), evaluate.ks(rows, y, "_p").select("ks"))
        values = {k: v for part in parts for k, v in part.first().asDict().items()}
        return df.sparkSession.createDataFrame([tuple(values.values())], ", ".join(f"{k} double" for k in values))

    def analysis(self, df: DataFrame, x: str, y: str, pvalue_test: str = "chi2", n_samples: int = 100) -> tuple[dict, Any]:
        """(measures of the curve's predictions with quality score and trend, tests of neighbouring bins)."""
        table = self.model.table()
        out, tests = table.analysis(pvalue_test, n_samples) if self.model.kind == "binary" else table.analysis()
        out |= self.metrics(df, x, y).first().asDict()
        if self.model.kind == "binary":
            out["quality_score"] = stats.quality_binary(out["iv"], tests["p_value"].tolist(), out["hhi_norm"])
        return out, tests

    def divergences(self, rows: DataFrame, rate: str) -> DataFrame:
        """Divergences of the distributions that the predicted rates give: each row adds its rate to the events, the rest to the nonevents."""
        p, q = F.col(rate), 1 - F.col(rate)
        total = rows.agg(F.sum(p).alias("e"), F.sum(q).alias("ne")).first()
        a, b = p / F.lit(total["e"]), q / F.lit(total["ne"])
        middle = (a + b) / 2
        term = lambda u, v: F.when((u > 0) & (v > 0), u * F.ln(u / v)).otherwise(0.0)
        return rows.agg(
            F.sum(term(a, b) + term(b, a)).alias("iv"), F.sum((term(a, middle) + term(b, middle)) / 2).alias("js"),
            F.sum(0.5 * (F.sqrt(a) - F.sqrt(b)) ** 2).alias("hellinger"), F.sum((a - b) ** 2 / (a + b)).alias("triangular"),
        )


class PiecewiseBinner:
    """Bins, then a polynomial of ``degree`` in each; ``kind`` is binary or continuous."""

    DEFAULTS: dict[str, Any] = {
        "kind": "binary", "estimator": None, "objective": "l2", "degree": 1, "continuous": True, "continuous_deriv": True, "h_epsilon": 1.35, "quantile": 0.5,
        "regularization": None, "reg_l1": 1.0, "reg_l2": 1.0, "monotonic_trend": "auto", "n_subsamples": None, "random_state": None,
    }

    def __init__(self, **parameters: Any) -> None:
        own = self.DEFAULTS | {k: v for k, v in parameters.items() if k in self.DEFAULTS}
        for k, v in own.items():
            setattr(self, k, v)
        _need(self.kind in ("binary", "continuous"), ValueError, "kind is binary or continuous")
        _need(self.objective in OBJECTIVES, ValueError, f"objective is one of {OBJECTIVES}")
        _need(isinstance(self.degree, int) and self.degree >= 0, ValueError, "degree is a whole number")
        _need(self.regularization in (None, "l1", "l2"), ValueError, "regularization is l1, l2 or None")
        _need(0 < self.quantile < 1 and self.h_epsilon >= 1, ValueError, "quantile in (0, 1), h_epsilon at least 1")
        _need(self.monotonic_trend in (None, "auto", "ascending", "descending", "convex", "concave", "peak", "valley"), ValueError, "unknown monotonic_trend")
        _need(self.monotonic_trend not in ("convex", "concave") or self.degree <= 1, ValueError, "convex and concave need degree up to 1")
        rest = {k: v for k, v in parameters.items() if k not in self.DEFAULTS} | {"monotonic_trend": self.monotonic_trend}
        self.binner = (BinaryBinner if self.kind == "binary" else ContinuousBinner)(**rest)
        self.fitted: PiecewiseModel | None = None

    def fit(self, df: DataFrame, x: str, y: str, lb: float | None = None, ub: float | None = None) -> PiecewiseModel:
        model = self.binner.fit(df, x, y)
        rows = clean_rows(df.where(F.col(y).isNotNull()), x, self.binner.special_codes).select(F.col(x).cast("double").alias("x"), F.col(y).alias("y"))
        if self.n_subsamples is not None:
            rows = rows.sample(min(1.0, self.n_subsamples / max(1, rows.count())), seed=self.random_state or 0)
        if self.kind == "binary":
            # the curve follows the probabilities of an estimator, by default a logistic regression on x
            unit = rows.agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).first()
            scaled = rows.withColumn("_z", (F.col("x") - unit["m"]) / (unit["s"] or 1.0))
            fitted = (self.estimator or LogisticModel()).fit(scaled, ["_z"], "y")
            target = 1 / (1 + F.exp(-(F.lit(fitted.intercept) + F.lit(float(fitted.coefficients[0])) * F.col("_z"))))
            rows = scaled.select("x", target.alias("t"))
            lb, ub = 0.0 if lb is None else lb, 1.0 if ub is None else ub
        else:
            rows = rows.select("x", F.col("y").cast("double").alias("t"))
        ends = rows.agg(F.min("x").alias("a"), F.max("x").alias("b")).first()
        shift, width = (ends["a"] + ends["b"]) / 2, ((ends["b"] - ends["a"]) / 2) or 1.0
        z = (F.col("x") - F.lit(shift)) / F.lit(width)
        data = rows.select(by_interval(F.col("x"), model.splits, F.lit).alias("bin"), z.alias("z"), "t")
        splits = [(s - shift) / width for s in model.splits]
        m = len(splits) + 1
        coefficients: list[np.ndarray] | None = None
        for _ in range(1 if self.objective == "l2" else ROUNDS):
            w = F.lit(1.0) if coefficients is None else self._weight(data, coefficients, splits)
            sums = self._sums(data.withColumn("w", w), m)
            new = self._constrained(sums, splits, model.trend)
            if coefficients is not None and max(np.abs(a - b).max() for a, b in zip(new, coefficients, strict=True)) < 1e-9:
                break
            coefficients = new
        self.fitted = PiecewiseModel(model, [c.tolist() for c in coefficients], shift, width, lb, ub)
        return self.fitted

    def _sums(self, data: DataFrame, m: int) -> list[tuple[np.ndarray, np.ndarray]]:
        d = self.degree
        aggs = [F.sum(F.col("w") * F.pow("z", F.lit(p))).alias(f"m{p}") for p in range(2 * d + 1)] + [F.sum(F.col("w") * F.col("t") * F.pow("z", F.lit(p))).alias(f"c{p}") for p in range(d + 1)]
        out = [(np.zeros(2 * d + 1), np.zeros(d + 1)) for _ in range(m)]
        for r in data.groupBy("bin").agg(*aggs).collect():
            out[r["bin"]] = (np.array([r[f"m{p}"] for p in range(2 * d + 1)]), np.array([r[f"c{p}"] for p in range(d + 1)]))
        return out

    def _weight(self, data: DataFrame, coefficients: list[np.ndarray], splits: list[float]) -> Column:
        fit = by_interval(F.col("bin").cast("double"), [i + 0.5 for i in range(len(splits))], lambda i: polynomial(F.col("z"), coefficients[i][::-1]))
        e = F.col("t") - fit
        small = F.greatest(F.abs(e), F.lit(1e-6))
        if self.objective == "huber":
            return F.when(F.abs(e) <= self.h_epsilon, 1.0).otherwise(F.lit(self.h_epsilon) / small)
        q = self.quantile if self.objective == "quantile" else 0.5
        return F.when(e >= 0, F.lit(q)).otherwise(F.lit(1 - q)) / small

    def _constrained(self, sums, splits: list[float], trend: str | None) -> list[np.ndarray]:
        """The best curve with the trend; with l1, coefficients are priced by their size, by reweighting their squares."""
        trend = {"peak_heuristic": "peak", "valley_heuristic": "valley"}.get(trend, trend)
        trend = trend if trend in ("ascending", "descending", "peak", "valley", "convex", "concave") else None
        if trend in ("convex", "concave") and self.degree > 1:
            trend = None
        shape = np.tile([0.0] + [1.0] * self.degree, len(sums))
        price = {None: 0.0, "l2": self.reg_l2, "l1": self.reg_l1}[self.regularization] * shape
        solve = lambda ridge: _solve(sums, splits, self.degree, self.continuous, self.continuous_deriv, ridge, trend)
        c = solve(price)
        for _ in range(30 if self.regularization == "l1" else 0):
            c = solve(price / np.maximum(1e-6, np.abs(np.concatenate(c))))
        return c

    def transform(self, df: DataFrame, x: str, output: str, **kwargs) -> DataFrame:
        if self.fitted is None:
            raise NotFittedError("call fit first")
        return self.fitted.transform(df, x, output, **kwargs)
