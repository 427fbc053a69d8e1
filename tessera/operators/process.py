"""Binning, screening and encoding of many columns."""

from __future__ import annotations

import json
import math
import time
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .binning import BinaryBinner, BinningModel, ContinuousBinner, MulticlassBinner, NotFittedError, _Binner, _need, summary
from .histogram import histograms
from .rows import is_numeric
from .tables import as_frame

#: Metrics that selection may use, by kind of target (fixed values).
METRICS = {
    "binary": ("iv", "js", "hellinger", "triangular", "gini", "ks", "cramer_v", "hhi", "hhi_norm", "quality_score"),
    "multiclass": ("js", "cramer_v", "hhi", "hhi_norm", "quality_score"),
    "continuous": ("iv", "woe", "hhi", "hhi_norm", "quality_score"),
}
BINNERS: dict[str, type[_Binner]] = {"binary": BinaryBinner, "continuous": ContinuousBinner, "multiclass": MulticlassBinner}


def target_kind(df: DataFrame, y: str) -> str:
    """binary for up to two values, multiclass for labels and whole numbers, else continuous."""
    kind = df.schema[y].dataType
    few = [r[0] for r in df.where(F.col(y).isNotNull()).select(y).distinct().limit(3).collect()]
    if len(few) <= 2:
        return "binary"
    if isinstance(kind, T.FractionalType):
        broken = df.where(F.col(y) != F.floor(F.col(y))).limit(1).count()
        return "continuous" if broken else "multiclass"
    return "multiclass"


def select(table: pd.DataFrame, criteria: dict[str, dict] | None, fixed: list[str] | None = None) -> list[bool]:
    """Variables that pass the criteria, metric by metric on those that are left; fixed ones always.

    A criterion has ``min``, ``max``, ``strategy`` (highest, lowest) and ``top``, a number or a share
    of the variables that are left; ties go to the earlier variable.
    """
    good = np.ones(len(table), bool)
    for metric, rule in (criteria or {}).items():
        values = table[metric].to_numpy(float)
        good &= (values >= rule.get("min", -np.inf)) & (values <= rule.get("max", np.inf))
        if "top" in rule:
            left = np.flatnonzero(good)
            k = rule["top"] if isinstance(rule["top"], int) else math.ceil(rule["top"] * len(left))
            sign = -1 if rule.get("strategy", "highest") == "highest" else 1
            keep = left[np.argsort(sign * values[left], kind="stable")[:k]]
            good = np.isin(np.arange(len(table)), keep)
    return (good | table["name"].isin(fixed or [])).tolist()


class BinningPipeline:
    """Fits all variables from one aggregation of the data, selects and encodes them."""

    OPTIONS = ("max_n_prebins", "min_prebin_size", "min_n_bins", "max_n_bins", "min_bin_size", "max_bin_size", "max_pvalue", "max_pvalue_policy", "split_digits")

    def __init__(
        self, variable_names: list[str], max_n_prebins: int = 20, min_prebin_size: float = 0.05, min_n_bins: int | None = None, max_n_bins: int | None = None,
        min_bin_size: float | None = None, max_bin_size: float | None = None, max_pvalue: float | None = None, max_pvalue_policy: str = "consecutive",
        selection_criteria: dict | None = None, fixed_variables: list[str] | None = None, categorical_variables: list[str] | None = None, special_codes=None,
        split_digits: int | None = None, binning_fit_params: dict[str, dict] | None = None, binning_transform_params: dict[str, dict] | None = None,
        n_jobs: int | None = None, verbose: bool = False,
    ) -> None:
        _need(isinstance(variable_names, list | tuple) and len(variable_names) > 0, TypeError, "variable_names is a list")
        own = {k: v for k, v in locals().items() if k != "self"}
        self.parameters: dict[str, Any] = own
        for k, v in own.items():
            setattr(self, k, v)
        BinaryBinner(**{k: own[k] for k in self.OPTIONS})  # checks the shared options
        for name in (selection_criteria or {}).values():
            _need(isinstance(name, dict) and set(name) <= {"min", "max", "strategy", "top"}, ValueError, "a criterion has min, max, strategy, top")
            _need(name.get("strategy", "highest") in ("highest", "lowest"), ValueError, "strategy is highest or lowest")
            top = name.get("top", 1)
            _need(isinstance(top, int) and top >= 1 or isinstance(top, float) and 0 < top < 1, ValueError, "top is a count or a share")
        self.models: dict[str, BinningModel] = {}
        self.kind: str | None = None
        self.support: list[bool] = []

    def _binner(self, name: str, categorical: bool) -> _Binner:
        options = {k: getattr(self, k) for k in self.OPTIONS} | {"name": name, "special_codes": self.special_codes}
        options |= (self.binning_fit_params or {}).get(name, {})
        if categorical:
            options["dtype"] = "categorical"
        return BINNERS[self.kind](**options)

    def fit(self, df: DataFrame, y: str, weight: str | None = None) -> BinningPipeline:
        """Fit all variables against ``y``; variables with own outlier or weight options are aggregated one by one."""
        began = time.perf_counter()
        missing = [v for v in self.variable_names if v not in df.columns]
        _need(not missing, ValueError, f"no columns {missing}")
        self.kind = target_kind(df, y)
        known = METRICS[self.kind]
        _need(all(m in known for m in self.selection_criteria or {}), ValueError, f"selection metrics are {known}")
        number = {v: is_numeric(df, v) and v not in (self.categorical_variables or []) for v in self.variable_names}
        binners = {v: self._binner(v, not number[v]) for v in self.variable_names}
        together = {v: n for v, n in number.items() if not (binners[v].outlier_detector or binners[v].class_weight)}
        classes = BINNERS["multiclass"]._class_list(MulticlassBinner(), df, y) if self.kind == "multiclass" else []
        splits = {v: binners[v].user_splits for v in together if binners[v].dtype == "numerical" and binners[v].user_splits is not None}
        shared = histograms(df, together, y, self.kind, weight, {v: binners[v].special_codes for v in together}, classes, splits)
        for v, b in binners.items():
            b.classes = classes
            self.models[v] = b.fit_histogram(shared[v]) if v in shared else b.fit(df, v, y, weight)
        self._select()
        self.seconds = time.perf_counter() - began
        return self

    def fit_from_dict(self, models: dict[str, BinningModel]) -> BinningPipeline:
        """Take fitted models of one kind, one for each variable."""
        _need(set(models) == set(self.variable_names), ValueError, "one model for each variable")
        _need(len({m.kind for m in models.values()}) == 1, TypeError, "models of one kind")
        self.kind, self.models, self.seconds = next(iter(models.values())).kind, {v: models[v] for v in self.variable_names}, 0.0
        self._select()
        return self

    def _select(self) -> None:
        self.table = summary([self._named(v) for v in self.variable_names])
        if self.selection_criteria and "quality_score" in self.selection_criteria:
            self.table["quality_score"] = [self.models[v].table().analysis()[0]["quality_score"] for v in self.variable_names]
        self.support = select(self.table, self.selection_criteria, self.fixed_variables)
        self.table["selected"] = self.support

    def _named(self, v: str) -> BinningModel:
        self.models[v].name = self.models[v].name or v
        return self.models[v]

    def _need_fit(self) -> None:
        if not self.models:
            raise NotFittedError("call fit first")

    def summary(self, spark=None) -> pd.DataFrame | DataFrame:
        self._need_fit()
        lead = ["name", "dtype", "status", "selected", "n_bins"]
        out = self.table[lead + [c for c in self.table.columns if c not in lead]]
        return as_frame(spark, out) if spark is not None else out

    def get_support(self, indices: bool = False, names: bool = False):
        self._need_fit()
        _need(not (indices and names), ValueError, "indices or names")
        if indices:
            return [i for i, s in enumerate(self.support) if s]
        return [v for v, s in zip(self.variable_names, self.support, strict=True) if s] if names else list(self.support)

    def get_binned_variable(self, name: str) -> BinningModel:
        self._need_fit()
        _need(name in self.models, ValueError, f"no variable {name}")
        return self.models[name]

    def update_binned_variable(self, name: str, model: BinningModel) -> None:
        _need(self.get_binned_variable(name).kind == model.kind, TypeError, "a model of the same kind")
        self.models[name] = model
        self._select()

    def expressions(self, metric: str | None = None, metric_special=0, metric_missing=0, show_digits: int = 2) -> dict:
        """The encoding of each selected variable; a variable's own parameters hold for it alone."""
        self._need_fit()
        common = {"metric": metric, "metric_special": metric_special, "metric_missing": metric_missing, "show_digits": show_digits}
        out = {}
        kinds = set()
        for v in self.get_support(names=True):
            own = common | (self.binning_transform_params or {}).get(v, {})
            kinds.add(own["metric"] == "bins")
            out[v] = self.models[v].encode(F.col(v), **own)
        _need(len(kinds) < 2, ValueError, "bins cannot be mixed with numbers")
        return out

    def transform(self, df: DataFrame, keep: list[str] | None = None, **kwargs) -> DataFrame:
        """The selected variables encoded, and the columns ``keep`` as they are; one projection."""
        return df.select(*[F.col(c) for c in keep or []], *[e.alias(v) for v, e in self.expressions(**kwargs).items()])

    def fit_transform(self, df: DataFrame, y: str, weight: str | None = None, **kwargs) -> DataFrame:
        return self.fit(df, y, weight).transform(df, **kwargs)

    def save(self, path: str) -> None:
        self._need_fit()
        with open(path, "w", encoding="utf-8") as f:
            json.dump({"parameters": self.parameters, "kind": self.kind, "models": {v: m.to_dict() for v, m in self.models.items()}}, f)

    @classmethod
    def load(cls, path: str) -> BinningPipeline:
        with open(path, encoding="utf-8") as f:
            d = json.load(f)
        return cls(**d["parameters"]).fit_from_dict({v: BinningModel.from_dict(m) for v, m in d["models"].items()})

    def information(self, print_level: int = 1) -> str:
        self._need_fit()
        lines = [f"target {self.kind}, variables {len(self.models)}, selected {sum(self.support)}, {self.seconds:.3f} s"]
        return "\n".join(lines + [m.information(print_level) for m in self.models.values()] if print_level > 1 else lines)
