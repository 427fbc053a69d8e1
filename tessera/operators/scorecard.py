"""Scorecards: binned variables, a linear model, points."""

from __future__ import annotations

import json
import math
from typing import Any

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .binning import NotFittedError, _need
from .encode import override
from .process import BinningPipeline
from .rows import special_labels
from .tables import as_frame


class LogisticModel:
    """Logistic regression with an L2 penalty of strength 1 / ``c``."""

    def __init__(self, c: float = 1.0, max_iter: int = 200, tol: float = 1e-8) -> None:
        self.c, self.max_iter, self.tol = c, max_iter, tol

    def fit(self, df: DataFrame, features: list[str], y: str, weight: str | None = None) -> LogisticModel:
        from pyspark.ml.classification import LogisticRegression

        rows = VectorAssembler(inputCols=features, outputCol="_x").transform(df.withColumn("_y", F.when(F.col(y) == 0, 0.0).otherwise(1.0)))
        total = rows.agg(F.sum(weight) if weight else F.count("*")).first()[0]
        # the mean loss here is penalised by half the squared coefficients over c * rows
        lr = LogisticRegression(featuresCol="_x", labelCol="_y", regParam=1.0 / (self.c * total), standardization=False, maxIter=self.max_iter, tol=self.tol)
        m = (lr.setWeightCol(weight) if weight else lr).fit(rows)
        self.coefficients, self.intercept = m.coefficients.toArray().tolist(), float(m.intercept)
        return self


class LinearModel:
    """Least squares."""

    def fit(self, df: DataFrame, features: list[str], y: str, weight: str | None = None) -> LinearModel:
        from pyspark.ml.regression import LinearRegression

        rows = VectorAssembler(inputCols=features, outputCol="_x").transform(df.withColumn("_y", F.col(y).cast("double")))
        lr = LinearRegression(featuresCol="_x", labelCol="_y", solver="normal", standardization=False)
        m = (lr.setWeightCol(weight) if weight else lr).fit(rows)
        self.coefficients, self.intercept = m.coefficients.toArray().tolist(), float(m.intercept)
        return self


class FixedModel:
    """Coefficients that are given."""

    def __init__(self, coefficients: list[float], intercept: float = 0.0) -> None:
        self.coefficients, self.intercept = list(coefficients), float(intercept)

    def fit(self, df, features, y, weight=None) -> FixedModel:
        _need(len(features) == len(self.coefficients), ValueError, "one coefficient for each variable")
        return self


def scale_points(points: list[np.ndarray], intercept: float, method: str, params: dict, reverse: bool = False) -> list[np.ndarray]:
    """Points of each variable on the scale of ``pdo_odds`` (pdo, odds, scorecard_points) or ``min_max`` (min, max)."""
    n, sense = len(points), -1 if reverse else 1
    if method == "pdo_odds":
        factor = params["pdo"] / math.log(2)
        offset = params["scorecard_points"] - factor * math.log(params["odds"])
        return [-(sense * p + intercept / n) * factor + offset / n for p in points]
    low, high = intercept + sum(p.min() for p in points), intercept + sum(p.max() for p in points)
    slope = sense * (params["min"] - params["max"]) / (high - low)
    base = (params["min"] if reverse else params["max"]) - slope * low + slope * intercept
    return [base / n + slope * p for p in points]


def round_points(points: list[np.ndarray]) -> list[np.ndarray]:
    """Whole points with the least total change whose least and greatest sums are the rounded ones.

    The least points of the variables are rounded so that they add up to the rounded sum of least
    points, those with the largest rounding remainder first, and so the greatest points; others lie
    between them, rounded to the nearest whole number.
    """

    def spread(ends: np.ndarray) -> np.ndarray:
        goal, out = int(np.rint(ends.sum())), np.floor(ends)
        extra = goal - int(out.sum())
        return out + np.isin(np.arange(len(ends)), np.argsort(out - ends, kind="stable")[:extra])

    low, high = spread(np.array([p.min() for p in points])), spread(np.array([p.max() for p in points]))
    out = []
    for p, a, b in zip(points, low, high, strict=True):
        r = np.clip(np.rint(p), a, max(a, b))
        r[p == p.min()] = a
        r[p == p.max()] = b
        out.append(r)
    return out


class Scorecard:
    """``fit`` bins, encodes and regresses; ``score`` is one projection."""

    def __init__(
        self, process: BinningPipeline, estimator=None, scaling_method: str | None = None, scaling_method_params: dict | None = None,
        intercept_based: bool = False, reverse_scorecard: bool = False, rounding: bool = False, verbose: bool = False,
    ) -> None:
        _need(scaling_method in (None, "pdo_odds", "min_max"), ValueError, "scaling_method is pdo_odds or min_max")
        p = scaling_method_params or {}
        if scaling_method == "pdo_odds":
            _need(all(isinstance(p.get(k), int | float) and p[k] > 0 for k in ("pdo", "odds", "scorecard_points")), ValueError, "pdo, odds and scorecard_points are positive")
        if scaling_method == "min_max":
            _need(all(isinstance(p.get(k), int | float) for k in ("min", "max")) and p["min"] <= p["max"], ValueError, "min <= max")
            _need(not rounding or all(float(p[k]).is_integer() for k in ("min", "max")), ValueError, "rounding needs a whole min and max")
        self.process, self.estimator, self.scaling_method, self.scaling_method_params = process, estimator, scaling_method, p
        self.intercept_based, self.reverse_scorecard, self.rounding, self.verbose = intercept_based, reverse_scorecard, rounding, verbose
        self.points: dict[str, list[float]] | None = None
        self.intercept_ = 0.0

    def fit(self, df: DataFrame, y: str, weight: str | None = None, metric_special=0, metric_missing=0, show_digits: int = 2) -> Scorecard:
        self.process.fit(df, y, weight)
        self.kind = self.process.kind
        _need(self.kind in ("binary", "continuous"), ValueError, "a scorecard needs a binary or continuous target")
        _need(self.scaling_method != "pdo_odds" or self.kind == "binary", ValueError, "pdo_odds needs a binary target")
        self.metric = "woe" if self.kind == "binary" else "mean"
        self.overrides = (metric_special, metric_missing)
        self.variables = self.process.get_support(names=True)
        estimator = self.estimator or (LogisticModel() if self.kind == "binary" else LinearModel())
        coded = self.process.transform(df, keep=[y] + [weight] * bool(weight), metric=self.metric, metric_special=metric_special, metric_missing=metric_missing)
        self.estimator_ = estimator.fit(coded, self.variables, y, weight)
        self._build(show_digits)
        return self

    def _row_values(self, v: str) -> np.ndarray:
        """The encoding of each row of a variable's table."""
        model = self.process.models[v]
        own = np.array(model._values(self.metric, 2)[0], float)
        special, missing = self.overrides
        for i, (label, _) in enumerate(special_labels(model.special_codes)):
            given = special.get(label, "empirical") if isinstance(special, dict) else special
            own[model.n_bins + i] = override(self.metric, given, own[model.n_bins + i])
        own[-1] = override(self.metric, missing, own[-1])
        return own

    def _build(self, digits: int) -> None:
        points = [c * self._row_values(v) for v, c in zip(self.variables, self.estimator_.coefficients, strict=True)]
        if self.scaling_method:
            points = scale_points(points, self.estimator_.intercept, self.scaling_method, self.scaling_method_params, self.reverse_scorecard)
        self.intercept_ = 0.0
        if self.intercept_based:
            self.intercept_ = float(sum(p.min() for p in points))
            points = [p - p.min() for p in points]
        if self.rounding:
            points = round_points(points) if self.scaling_method == "min_max" else [np.rint(p) for p in points]
            self.intercept_ = float(np.rint(self.intercept_))
        self.points = {v: p.tolist() for v, p in zip(self.variables, points, strict=True)}
        parts = []
        for v, c in zip(self.variables, self.estimator_.coefficients, strict=True):
            t = self.process.models[v].table(digits).build(totals=False)
            t.insert(0, "variable", v)
            t.insert(1, "bin_id", range(len(t)))
            t["coefficient"], t["points"] = c, self.points[v]
            parts.append(t)
        self._table = pd.concat(parts, ignore_index=True)

    def _fitted(self) -> None:
        if self.points is None:
            raise NotFittedError("call fit first")

    def table(self, style: str = "summary", spark=None):
        self._fitted()
        _need(style in ("summary", "detailed"), ValueError, "style is summary or detailed")
        out = self._table if style == "detailed" else self._table[["variable", "bin", "points"]]
        return as_frame(spark, out) if spark is not None else out

    def point_columns(self) -> dict[str, Column]:
        self._fitted()
        return {v: self.process.models[v].lookup(F.col(v), [float(x) for x in p], float(np.mean(p))) for v, p in self.points.items()}

    def score_column(self) -> Column:
        out = F.lit(float(self.intercept_))
        for c in self.point_columns().values():
            out = out + c
        return out

    def score(self, df: DataFrame, output: str = "score") -> DataFrame:
        """``df`` with the sum of points."""
        return df.withColumn(output, self.score_column())

    def transform(self, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
        """Points of each variable."""
        return df.select(*[F.col(c) for c in keep or []], *[c.alias(v) for v, c in self.point_columns().items()])

    def decision_column(self) -> Column:
        self._fitted()
        codes = self.process.expressions(metric=self.metric, metric_special=self.overrides[0], metric_missing=self.overrides[1])
        out = F.lit(self.estimator_.intercept)
        for v, c in zip(self.variables, self.estimator_.coefficients, strict=True):
            out = out + F.lit(float(c)) * codes[v]
        return out

    def decision_function(self, df: DataFrame, output: str = "decision") -> DataFrame:
        return df.withColumn(output, self.decision_column())

    def predict_proba(self, df: DataFrame, output: str = "probability") -> DataFrame:
        self._fitted()
        _need(self.kind == "binary", ValueError, "probabilities need a binary target")
        return df.withColumn(output, 1 / (1 + F.exp(-self.decision_column())))

    def predict(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        column = self.decision_column()
        return df.withColumn(output, (column > 0).cast("int") if self.kind == "binary" else column)

    def save(self, path: str) -> None:
        self._fitted()
        self.process.save(f"{path}.process.json")
        state: dict[str, Any] = {
            "coefficients": self.estimator_.coefficients, "intercept": self.estimator_.intercept, "overrides": self.overrides, "scaling_method": self.scaling_method,
            "scaling_method_params": self.scaling_method_params, "intercept_based": self.intercept_based, "reverse_scorecard": self.reverse_scorecard, "rounding": self.rounding,
        }
        with open(path, "w", encoding="utf-8") as f:
            json.dump(state, f)

    @classmethod
    def load(cls, path: str) -> Scorecard:
        with open(path, encoding="utf-8") as f:
            d = json.load(f)
        process = BinningPipeline.load(f"{path}.process.json")
        out = cls(process, FixedModel(d["coefficients"], d["intercept"]), d["scaling_method"], d["scaling_method_params"], d["intercept_based"], d["reverse_scorecard"], d["rounding"])
        out.kind, out.estimator_, out.overrides = process.kind, out.estimator, tuple(d["overrides"])
        out.metric, out.variables = "woe" if out.kind == "binary" else "mean", process.get_support(names=True)
        out._build(2)
        return out

    def information(self, print_level: int = 1) -> str:
        self._fitted()
        return f"target {self.kind}, scaling {self.scaling_method}, variables {len(self.variables)}\n{self.process.information(print_level)}"
