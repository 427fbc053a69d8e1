"""Optimal binning of two columns into rectangles."""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from ..plans import grid
from ..plans.partition import SCALE
from .binning import NotFittedError, _need
from .encode import by_category, by_interval, check_overrides, override
from .histogram import Histogram, cell_edges, histogram, moment_columns, no_moments
from .rows import is_missing, is_numeric, row_class
from .splits import prebin_splits
from .tables import BinaryTable, ContinuousTable, as_frame, interval_labels, pair_tests, rectangle_pairs


@dataclass
class Axis:
    """Prebins of one column: splits of its values, or groups of its categories."""

    numeric: bool
    splits: list[float]
    groups: list[list[str]]
    special_codes: Any

    @property
    def n(self) -> int:
        return len(self.splits) + 1 if self.numeric else max(1, len(self.groups))

    def index(self, x: Column) -> Column:
        """The prebin of a clean value; null for an unknown category."""
        if self.numeric:
            return by_interval(x.cast("double"), self.splits, F.lit)
        return by_category(x.cast("string"), self.groups, F.lit, F.lit(None).cast("int"))

    def label(self, first: int, last: int, digits: int) -> str:
        if not self.numeric:
            return "[" + ", ".join(c for g in self.groups[first : last + 1] for c in g) + "]"
        low = f"[{self.splits[first - 1]:.{digits}f}" if first else "(-inf"
        return f"{low}, {self.splits[last]:.{digits}f})" if last < len(self.splits) else f"{low}, inf)"

    def row_class(self, x: Column) -> Column:
        return row_class(x, self.numeric, self.special_codes)


@dataclass
class Model2D:
    """Rectangles of prebins with the moments of every row of the table."""

    name_x: str
    name_y: str
    kind: str
    x: Axis
    y: Axis
    rectangles: list[list[int]]  # top, left, bottom, right; x runs to the right, y downwards
    moments: dict[str, list[float]]  # of the rectangles, Special and Missing
    status: str

    def cells(self) -> np.ndarray:
        out = np.zeros((self.y.n, self.x.n), int)
        for i, (top, left, bottom, right) in enumerate(self.rectangles):
            out[top : bottom + 1, left : right + 1] = i
        return out

    def table(self, digits: int = 2) -> BinaryTable | ContinuousTable:
        labels = [f"{self.x.label(r[1], r[3], digits)} ∪ {self.y.label(r[0], r[2], digits)}" for r in self.rectangles] + ["Special", "Missing"]
        m = {k: np.asarray(v, float) for k, v in self.moments.items()}
        return BinaryTable(labels, m["n0"], m["n1"], len(self.rectangles)) if self.kind == "binary" else ContinuousTable(labels, m, len(self.rectangles))

    def build(self, digits: int = 2, show_bin_xy: bool = False, totals: bool = True) -> pd.DataFrame:
        out = self.table(digits).build(totals)
        if show_bin_xy:
            return out
        names = lambda axis, a, b: [axis.label(r[a], r[b], digits) for r in self.rectangles] + ["Special", "Missing"] + ["Totals"] * totals
        out.insert(0, "bin_x", names(self.x, 1, 3))
        out.insert(1, "bin_y", names(self.y, 0, 2))
        return out.drop(columns="bin")

    def binning_table(self, spark, digits: int = 2, show_bin_xy: bool = False) -> DataFrame:
        return as_frame(spark, self.build(digits, show_bin_xy))

    def analysis(self, pvalue_test: str = "chi2") -> tuple[dict, pd.DataFrame]:
        """Metrics, and tests of neighbouring rectangles."""
        table, tests = self.table(), pair_tests(self.table(), rectangle_pairs(self.cells()), pvalue_test)
        out = table.metrics()
        if self.kind == "binary":
            out["quality_score"] = stats.quality_binary(out["iv"], tests["p_value"].tolist(), out["hhi_norm"])
        else:
            total = self.moments["s"] and sum(self.moments["s"]) / max(1, sum(self.moments["n"]))
            out["quality_score"] = stats.quality_continuous(out["woe"] / abs(total) if total else math.inf, tests["p_value"].tolist(), out["hhi_norm"])
        return out, tests

    def encode(self, x: Column, y: Column, metric: str | None = None, metric_special=0, metric_missing=0, show_digits: int = 2) -> Column:
        """The expression that encodes a pair; missing comes before special."""
        metric = metric or ("woe" if self.kind == "binary" else "mean")
        check_overrides(metric_special, metric_missing)
        table = self.table(show_digits)
        values = {"bins": lambda: table.labels, "indices": lambda: list(range(len(table.labels)))}.get(metric)
        if values is None:
            _need(metric in (("woe", "event_rate") if self.kind == "binary" else ("mean",)), ValueError, f"metric {metric!r} does not fit")
            found = [float(v) for v in {"woe": lambda: table.woe, "event_rate": lambda: table.event_rate, "mean": lambda: table.mean}[metric]()]
        else:
            found = values()
        cells = self.cells()
        ix, iy = self.x.index(x), self.y.index(y)
        column = lambda i: by_interval(iy, list(range(1, self.y.n)), lambda j: F.lit(found[cells[j, i]]))
        clean = by_interval(ix, list(range(1, self.x.n)), column)
        cx, cy = self.x.row_class(x), self.y.row_class(y)
        return (
            F.when((cx == "missing") | (cy == "missing"), F.lit(override(metric, metric_missing, found[-1])))
            .when(cx.startswith("special") | cy.startswith("special"), F.lit(override(metric, metric_special, found[-2])))
            .when(ix.isNull() | iy.isNull(), F.lit("unknown" if metric == "bins" else -1 if metric == "indices" else 0.0))
            .otherwise(clean)
        )

    def transform(self, df: DataFrame, x: str, y: str, output: str, **kwargs) -> DataFrame:
        return df.withColumn(output, self.encode(F.col(x), F.col(y), **kwargs))

    def to_json(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as f:
            json.dump(asdict(self), f)

    @classmethod
    def read_json(cls, path: str) -> Model2D:
        with open(path, encoding="utf-8") as f:
            d = json.load(f)
        return cls(**(d | {"x": Axis(**d["x"]), "y": Axis(**d["y"])}))


class Binner2D:
    """Rectangles over prebins of two columns, for a binary target or (``kind="continuous"``) a number.

    ``strategy="cart"`` offers only unions of the leaves of a tree over the prebins, which is much faster on large grids.
    """

    DEFAULTS: dict[str, Any] = {
        "name_x": "", "name_y": "", "dtype_x": "numerical", "dtype_y": "numerical", "prebinning_method": "cart", "strategy": "grid", "solver": "cp",
        "divergence": "iv", "max_n_prebins_x": 5, "max_n_prebins_y": 5, "min_prebin_size_x": 0.05, "min_prebin_size_y": 0.05, "min_n_bins": None,
        "max_n_bins": None, "min_bin_size": None, "max_bin_size": None, "min_bin_n_nonevent": None, "max_bin_n_nonevent": None, "min_bin_n_event": None,
        "max_bin_n_event": None, "monotonic_trend_x": None, "monotonic_trend_y": None, "min_event_rate_diff_x": 0, "min_event_rate_diff_y": 0,
        "min_mean_diff_x": 0, "min_mean_diff_y": 0, "gamma": 0, "special_codes_x": None, "special_codes_y": None, "split_digits": None, "n_jobs": 1,
        "time_limit": 100, "verbose": False, "kind": "binary",
    }

    def __init__(self, **parameters: Any) -> None:
        unknown = set(parameters) - set(self.DEFAULTS)
        _need(not unknown, TypeError, f"unknown parameters {sorted(unknown)}")
        for k, v in (self.DEFAULTS | parameters).items():
            setattr(self, k, v)
        _need(self.kind in ("binary", "continuous"), ValueError, "kind is binary or continuous")
        _need(self.strategy in ("grid", "cart"), ValueError, "strategy is grid or cart")
        _need(self.divergence in stats.DIVERGENCES, ValueError, "unknown divergence")
        for axis in "xy":
            _need(getattr(self, f"dtype_{axis}") in ("numerical", "categorical"), ValueError, "dtype is numerical or categorical")
            _need(getattr(self, f"monotonic_trend_{axis}") in (None, "ascending", "descending"), ValueError, "trend is ascending, descending or None")
            _need(isinstance(getattr(self, f"max_n_prebins_{axis}"), int) and getattr(self, f"max_n_prebins_{axis}") > 1, ValueError, "max_n_prebins is an integer above 1")
            _need(0 < getattr(self, f"min_prebin_size_{axis}") <= 0.5, ValueError, "min_prebin_size is in (0, 0.5]")
        self.model: Model2D | None = None

    def _axis(self, df: DataFrame, x: str, z: str, which: str) -> Axis:
        numeric = getattr(self, f"dtype_{which}") == "numerical"
        _need(not numeric or is_numeric(df, x), ValueError, f"{x} is not numeric")
        codes = getattr(self, f"special_codes_{which}")
        h = histogram(df, x, z, self.kind, None, codes, edges=cell_edges(df, x, codes) if numeric else None, dtype="numerical" if numeric else "categorical")
        order = None
        if not numeric:
            rate = h.moments["n1"] / h.size() if self.kind == "binary" else h.moments["s"] / h.size()
            order = np.lexsort((h.low.astype(str), rate))
            ranks = np.arange(len(order), dtype=float)
            names = h.low[order]
            h = Histogram(True, ranks, ranks, {k: v[order] for k, v in h.moments.items()}, h.missing, h.special, h.rows)
        least = math.ceil(getattr(self, f"min_prebin_size_{which}") * h.total)
        splits = prebin_splits(h, self.kind, self.prebinning_method, getattr(self, f"max_n_prebins_{which}"), least)
        if self.split_digits is not None and numeric:
            splits = np.unique(np.round(splits, self.split_digits))
        if numeric:
            return Axis(True, [float(s) for s in splits], [], codes)
        at = np.searchsorted(splits, np.arange(len(order)), side="right")
        return Axis(False, [], [[str(c) for c in names[at == i]] for i in range(len(splits) + 1)], codes)

    def fit(self, df: DataFrame, x: str, y: str, z: str) -> Model2D:
        """Fit; two aggregations for the prebins and one for the grid."""
        ax, ay = self._axis(df, x, z, "x"), self._axis(df, y, z, "y")
        cells = grid_moments(df, x, y, z, ax, ay, self.kind)
        m, n = ay.n, ax.n
        names = list(moment_columns(self.kind, F.lit(0), F.lit(0)))
        mats = {k: np.full((m, n), no_moments([k])[k]) for k in names}
        special, missing = no_moments(names), no_moments(names)
        for r in cells:
            values = {k: float(r[f"m_{k}"]) for k in names}
            if r["class"] == "clean":
                for k in names:
                    mats[k][r["iy"], r["ix"]] = values[k]
            elif r["class"] == "special":
                special = values
            else:
                missing = values
        chosen, status = self._choose(mats, m, n)
        rows: dict[str, list[float]] = {k: [] for k in names}
        for top, left, bottom, right in chosen:
            for k in names:
                part = mats[k][top : bottom + 1, left : right + 1]
                rows[k].append(float(part.min() if k == "min" else part.max() if k == "max" else part.sum()))
        for extra in (special, missing):
            for k in names:
                rows[k].append(extra[k])
        self.model = Model2D(self.name_x, self.name_y, self.kind, ax, ay, [list(map(int, c)) for c in chosen], rows, status)
        return self.model

    def transform(self, df: DataFrame, x: str, y: str, output: str, **kwargs) -> DataFrame:
        if self.model is None:
            raise NotFittedError("call fit first")
        return self.model.transform(df, x, y, output, **kwargs)

    def _choose(self, mats: dict[str, np.ndarray], m: int, n: int) -> tuple[list[tuple], str]:
        binary = self.kind == "binary"
        sums = {k: grid.prefix_sums(v) for k, v in mats.items() if k not in ("min", "max")}
        total = {k: float(v[-1, -1]) for k, v in sums.items()}
        size_total = total["n0"] + total["n1"] if binary else total["n"]
        shapes = list(grid.all_rectangles(m, n)) if self.strategy == "grid" else leaf_unions(mats, self.kind, self._leaf_size(size_total))
        found = []
        for shape in shapes:
            s = {k: grid.rectangle_sum(v, *shape) for k, v in sums.items()}
            size = s["n0"] + s["n1"] if binary else s["n"]
            if not size or binary and (not s["n0"] or not s["n1"]):
                continue
            if self.min_bin_size is not None and size < math.ceil(self.min_bin_size * size_total) or self.max_bin_size is not None and size > math.ceil(self.max_bin_size * size_total):
                continue
            if binary:
                limits = ((self.min_bin_n_nonevent, self.max_bin_n_nonevent, s["n0"]), (self.min_bin_n_event, self.max_bin_n_event, s["n1"]))
                if any(low is not None and v < low or high is not None and v > high for low, high, v in limits):
                    continue
                rate = s["n1"] / size
                value = float(stats.DIVERGENCES[self.divergence](np.array([s["n1"] / total["n1"]]), np.array([s["n0"] / total["n0"]]))[0])
            else:
                rate = s["s"] / size
                value = abs(rate - total["s"] / size_total)
            found.append(grid.Rectangle(*shape, int(value * SCALE), int(rate * SCALE), size))
        diff = "event_rate" if binary else "mean"
        chosen, status = grid.solve(
            found, m, n, self.monotonic_trend_x, self.monotonic_trend_y, int(getattr(self, f"min_{diff}_diff_x") * SCALE), int(getattr(self, f"min_{diff}_diff_y") * SCALE),
            self.min_n_bins, self.max_n_bins, math.ceil(SCALE * self.gamma / size_total) if self.gamma and size_total else 0, self.time_limit,
        )
        if not chosen:
            return [(0, 0, m - 1, n - 1)], status
        return sorted((found[i].top, found[i].left, found[i].bottom, found[i].right) for i in chosen), status

    def _leaf_size(self, total: float) -> float:
        return 0.25 * min(self.min_prebin_size_x, self.min_prebin_size_y) * total


def grid_moments(df: DataFrame, x: str, y: str, z: str, ax: Axis, ay: Axis, kind: str) -> list:
    """Moments by cell of the prebins, and of special and missing pairs; rows with a null target are left out.

    A pair with a missing part is missing, else one with a special part is special.
    """
    cx, cy = ax.row_class(F.col(x)), ay.row_class(F.col(y))
    both = F.when((cx == "missing") | (cy == "missing"), "missing").when((cx != "clean") | (cy != "clean"), "special").otherwise("clean")
    rows = df.where(~is_missing(F.col(z), is_numeric(df, z))).select(
        both.alias("class"), ax.index(F.col(x)).alias("ix"), ay.index(F.col(y)).alias("iy"), F.col(z).alias("z"),
    )
    clean = F.col("class") == "clean"
    columns = moment_columns(kind, F.col("z"), F.lit(1.0))
    return rows.groupBy("class", F.when(clean, F.col("iy")).alias("iy"), F.when(clean, F.col("ix")).alias("ix")).agg(*[c.alias(f"m_{k}") for k, c in columns.items()]).collect()


def leaf_unions(mats: dict[str, np.ndarray], kind: str, min_leaf: float) -> list[tuple]:
    """Rectangles that are unions of the leaves of a greedy tree over the grid."""
    binary = kind == "binary"
    weight = mats["n0"] + mats["n1"] if binary else mats["n"]
    m, n = weight.shape

    def error(t: int, a: int, b: int, r: int) -> float:
        part = (slice(t, b + 1), slice(a, r + 1))
        w = weight[part].sum()
        if binary:
            e = mats["n1"][part].sum()
            return w - (e * e + (w - e) ** 2) / w if w else 0.0
        s = mats["s"][part].sum()
        return mats["ss"][part].sum() - s * s / w if w else 0.0

    leaves = [(0, 0, m - 1, n - 1)]
    while len(leaves) < m * n:
        best = None
        for i, (t, a, b, r) in enumerate(leaves):
            whole = error(t, a, b, r)
            for parts in [((t, a, k, r), (k + 1, a, b, r)) for k in range(t, b)] + [((t, a, b, k), (t, k + 1, b, r)) for k in range(a, r)]:
                if all(weight[p[0] : p[2] + 1, p[1] : p[3] + 1].sum() >= min_leaf for p in parts):
                    gain = whole - sum(error(*p) for p in parts)
                    if gain > 1e-12 and (best is None or gain > best[0]):
                        best = (gain, i, parts)
        if best is None:
            break
        leaves[best[1] : best[1] + 1] = best[2]
    owner = np.zeros((m, n), int)
    for i, (t, a, b, r) in enumerate(leaves):
        owner[t : b + 1, a : r + 1] = i
    area = np.bincount(owner.ravel())
    return [s for s in grid.all_rectangles(m, n) if sum(area[i] for i in np.unique(owner[s[0] : s[2] + 1, s[1] : s[3] + 1])) == (s[2] - s[0] + 1) * (s[3] - s[1] + 1)]


__all__ = ["Axis", "Binner2D", "Model2D", "grid_moments", "interval_labels"]
