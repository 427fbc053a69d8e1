"""Binning tables and their significance analysis.

Tables have one row per bin, then one per special label, then Missing, then a
totals row.  They are small; ``as_frame`` puts one into a DataFrame.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..functions import stats
from ..functions.special import chi2_test, fisher_exact, probability_greater, welch
from ..plans.trend import label as trend_label


def interval_labels(splits, digits: int = 2) -> list[str]:
    """``(-inf, a)``, ``[a, b)``, ..., ``[z, inf)``."""
    edges = [f"{s:.{digits}f}" for s in splits]
    if not edges:
        return ["(-inf, inf)"]
    return [f"(-inf, {edges[0]})", *(f"[{a}, {b})" for a, b in zip(edges, edges[1:], strict=False)), f"[{edges[-1]}, inf)"]


def as_frame(spark: SparkSession, table: pd.DataFrame) -> DataFrame:
    """The table as a DataFrame, numbers as long or double and missing entries as null."""
    from pyspark.sql import types as T

    kinds = {"i": T.LongType(), "f": T.DoubleType(), "b": T.BooleanType()}
    fields, columns = [], []
    for c in table.columns:
        kind = kinds.get(table[c].dtype.kind)
        if kind is None:
            present = [v for v in table[c] if v is not None and v == v]
            kind = T.DoubleType() if present and all(isinstance(v, int | float) and not isinstance(v, bool) for v in present) else T.StringType()
        cast = {"LongType": int, "DoubleType": float, "BooleanType": bool, "StringType": str}[type(kind).__name__]
        fields.append(T.StructField(str(c), kind))
        columns.append([None if v is None or v != v else cast(v) for v in table[c]])
    return spark.createDataFrame(list(zip(*columns, strict=True)) if len(table) else [], T.StructType(fields))


def _with_row(table: pd.DataFrame, row: list) -> pd.DataFrame:
    out = table.astype(object)
    out.loc[len(out)] = row
    return out.infer_objects()


def _shares(a: np.ndarray) -> np.ndarray:
    return a / a.sum() if a.sum() else np.zeros_like(a, float)


def rate_to_woe(rate, n_nonevent: float, n_event: float):
    """ln(share of nonevents / share of events) at an event rate."""
    return np.log((1 / np.asarray(rate, float) - 1) * n_event / n_nonevent)


def woe_to_rate(woe, n_nonevent: float, n_event: float):
    return 1 / (1 + n_nonevent / n_event * np.exp(np.asarray(woe, float)))


@dataclass
class BinaryTable:
    """Counts by row of the table; ``n_bins`` of the rows are bins (others included)."""

    labels: list[str]
    n_nonevent: np.ndarray
    n_event: np.ndarray
    n_bins: int

    def __post_init__(self) -> None:  # weighted counts are cut to whole numbers
        self.n_nonevent = np.asarray(self.n_nonevent).astype(np.int64)
        self.n_event = np.asarray(self.n_event).astype(np.int64)
        self.p, self.q = _shares(self.n_event), _shares(self.n_nonevent)

    @property
    def records(self) -> np.ndarray:
        return self.n_event + self.n_nonevent

    @property
    def event_rate(self) -> np.ndarray:
        n = self.records
        return np.divide(self.n_event, n, out=np.zeros(len(n)), where=n > 0)

    @property
    def woe(self) -> np.ndarray:
        out = np.zeros(len(self.labels))
        used = (self.n_event > 0) & (self.n_nonevent > 0)
        out[used] = np.log(self.q[used] / self.p[used])
        return out

    def divergence_terms(self, name: str) -> np.ndarray:
        used = (self.n_event > 0) & (self.n_nonevent > 0)
        out = np.zeros(len(self.labels))
        out[used] = stats.DIVERGENCES[name](self.p[used], self.q[used])
        return out

    def metrics(self) -> dict[str, float]:
        share = self.records / max(1, self.records.sum())
        clean = slice(0, self.n_bins)
        return {
            "iv": float(self.divergence_terms("iv").sum()),
            "js": float(self.divergence_terms("js").sum()),
            "hellinger": float(self.divergence_terms("hellinger").sum()),
            "triangular": float(self.divergence_terms("triangular").sum()),
            "gini": stats.gini(self.n_event, self.n_nonevent),
            "ks": float(np.abs(np.cumsum(self.p) - np.cumsum(self.q)).max()) if len(self.p) else 0.0,
            "hhi": stats.hhi(share),
            "hhi_norm": stats.hhi(share, True),
            "cramer_v": stats.cramer_v(np.stack([self.n_nonevent[clean], self.n_event[clean]], axis=1)),
        }

    def build(self, totals: bool = True) -> pd.DataFrame:
        n, rate = self.records, self.event_rate
        out = pd.DataFrame({
            "bin": self.labels, "count": n, "count_pct": n / max(1, n.sum()), "non_event": self.n_nonevent, "event": self.n_event,
            "event_rate": rate, "woe": self.woe, "iv": self.divergence_terms("iv"), "js": self.divergence_terms("js"),
        })
        if totals:
            e, ne = int(self.n_event.sum()), int(self.n_nonevent.sum())
            out = _with_row(out, ["Totals", e + ne, 1.0, ne, e, e / max(1, e + ne), None, float(out["iv"].sum()), float(out["js"].sum())])
        return out

    def analysis(self, pvalue_test: str = "chi2", n_samples: int = 100) -> tuple[dict, pd.DataFrame]:
        """(metrics with quality score and trend, tests of neighbouring bins)."""
        if pvalue_test not in ("chi2", "fisher"):
            raise ValueError('pvalue_test is "chi2" or "fisher"')
        rows = []
        for i in range(self.n_bins - 1):
            a, b, c, d = (int(v) for v in (self.n_nonevent[i], self.n_event[i], self.n_nonevent[i + 1], self.n_event[i + 1]))
            t, p = chi2_test([[a, b], [c, d]]) if pvalue_test == "chi2" else fisher_exact(a, b, c, d)
            above = probability_greater(b, a, d, c, n_samples)
            rows.append({"bin_a": i, "bin_b": i + 1, "statistic": t, "p_value": p, "p_a_greater": above, "p_b_greater": 1 - above})
        out = self.metrics()
        out["quality_score"] = stats.quality_binary(out["iv"], [r["p_value"] for r in rows], out["hhi_norm"])
        out["trend"] = trend_label(self.event_rate[: self.n_bins]) if self.n_bins else "undefined"
        return out, pd.DataFrame(rows, columns=["bin_a", "bin_b", "statistic", "p_value", "p_a_greater", "p_b_greater"])

    def plot_data(self, metric: str = "woe") -> pd.DataFrame:
        """Bars and line of the usual chart."""
        t = self.build(totals=False)
        return t[["bin", "non_event", "event", metric]]


@dataclass
class MulticlassTable:
    """``counts[row, class]``."""

    labels: list[str]
    counts: np.ndarray
    classes: list
    n_bins: int

    def __post_init__(self) -> None:
        self.counts = np.asarray(self.counts).astype(np.int64)

    def build(self, totals: bool = True) -> pd.DataFrame:
        n = self.counts.sum(axis=1)
        out = pd.DataFrame({"bin": self.labels, "count": n, "count_pct": n / max(1, n.sum())})
        for i, c in enumerate(self.classes):
            out[f"event_{c}"] = self.counts[:, i]
        for i, c in enumerate(self.classes):
            out[f"event_rate_{c}"] = np.divide(self.counts[:, i], n, out=np.zeros(len(n)), where=n > 0)
        if totals:
            sums = self.counts.sum(axis=0)
            out = _with_row(out, ["Totals", int(n.sum()), 1.0, *sums.tolist(), *(sums / max(1, n.sum())).tolist()])
        return out

    def metrics(self) -> dict[str, float]:
        share = self.counts.sum(axis=1) / max(1, self.counts.sum())
        dist = np.stack([_shares(c) for c in self.counts.T], axis=1)
        return {
            "js": stats.jensen_shannon_multivariate(dist),
            "hhi": stats.hhi(share),
            "hhi_norm": stats.hhi(share, True),
            "cramer_v": stats.cramer_v(self.counts[: self.n_bins]),
        }

    def analysis(self) -> tuple[dict, pd.DataFrame]:
        rows = []
        for i in range(self.n_bins - 1):
            pair = self.counts[i : i + 2]
            t, p = chi2_test(pair[:, pair.sum(axis=0) > 0].tolist())
            rows.append({"bin_a": i, "bin_b": i + 1, "statistic": t, "p_value": p})
        out = self.metrics()
        out["quality_score"] = stats.quality_multiclass(out["js"], len(self.classes), [r["p_value"] for r in rows], out["hhi_norm"])
        n = np.maximum(1, self.counts[: self.n_bins].sum(axis=1))
        out["trends"] = {str(c): trend_label(self.counts[: self.n_bins, i] / n) for i, c in enumerate(self.classes)}
        return out, pd.DataFrame(rows, columns=["bin_a", "bin_b", "statistic", "p_value"])


@dataclass
class ContinuousTable:
    """Moments by row of the table."""

    labels: list[str]
    moments: dict[str, np.ndarray]
    n_bins: int

    def __post_init__(self) -> None:
        m = self.moments
        self.n = np.asarray(m["n"]).astype(np.int64)
        used = self.n > 0
        self.mean = np.divide(m["s"], self.n, out=np.zeros(len(self.n)), where=used)
        square = np.divide(m["ss"], self.n, out=np.zeros(len(self.n)), where=used) - self.mean**2
        self.std = np.sqrt(np.maximum(square, 0))

    @property
    def woe(self) -> np.ndarray:
        total = self.moments["s"].sum() / max(1, self.n.sum())
        return np.where(self.n > 0, self.mean - total, -total * (self.n > 0))

    def build(self, totals: bool = True) -> pd.DataFrame:
        m, share = self.moments, self.n / max(1, self.n.sum())
        none = lambda v: [None if k == 0 else float(x) for x, k in zip(v, self.n, strict=True)]
        out = pd.DataFrame({
            "bin": self.labels, "count": self.n, "count_pct": share, "sum": m["s"], "std": none(self.std), "mean": self.mean,
            "min": none(m["min"]), "max": none(m["max"]), "zeros_count": m["zeros"].astype(np.int64), "woe": self.woe, "iv": np.abs(self.woe) * share,
        })
        if totals:
            used = self.n > 0
            n, s = int(self.n.sum()), float(m["s"].sum())
            out = _with_row(out, [
                "Totals", n, 1.0, s, None, s / max(1, n), float(m["min"][used].min()) if used.any() else None, float(m["max"][used].max()) if used.any() else None,
                int(m["zeros"].sum()), float(np.abs(self.woe).sum()), float(out["iv"].sum()),
            ])
        return out

    def metrics(self) -> dict[str, float]:
        share = self.n / max(1, self.n.sum())
        return {"iv": float((np.abs(self.woe) * share).sum()), "woe": float(np.abs(self.woe).sum()), "hhi": stats.hhi(share), "hhi_norm": stats.hhi(share, True)}

    def analysis(self) -> tuple[dict, pd.DataFrame]:
        rows = []
        for i in range(self.n_bins - 1):
            j = i + 1
            t, p = welch(self.n[i], self.mean[i], self.std[i], self.n[j], self.mean[j], self.std[j])
            rows.append({"bin_a": i, "bin_b": j, "statistic": t, "p_value": p})
        out = self.metrics()
        total = self.moments["s"].sum() / max(1, self.n.sum())
        relative = out["woe"] / abs(total) if total else math.inf
        out["quality_score"] = stats.quality_continuous(relative, [r["p_value"] for r in rows], out["hhi_norm"])
        out["trend"] = trend_label(self.mean[: self.n_bins])
        return out, pd.DataFrame(rows, columns=["bin_a", "bin_b", "statistic", "p_value"])


# ---------------------------------------------------------------- two variables


def rectangle_pairs(cells: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of neighbouring rectangles of a grid of rectangle numbers."""
    out = set()
    for a, b in ((cells[:, :-1], cells[:, 1:]), (cells[:-1], cells[1:])):
        out |= {(int(min(x, y)), int(max(x, y))) for x, y in zip(a.ravel(), b.ravel(), strict=True) if x != y}
    return sorted(out)


def pair_tests(table: BinaryTable | ContinuousTable, pairs: list[tuple[int, int]], pvalue_test: str = "chi2") -> pd.DataFrame:
    """Tests between given bins."""
    rows = []
    for i, j in pairs:
        if isinstance(table, BinaryTable):
            a, b, c, d = (int(v) for v in (table.n_nonevent[i], table.n_event[i], table.n_nonevent[j], table.n_event[j]))
            t, p = chi2_test([[a, b], [c, d]]) if pvalue_test == "chi2" else fisher_exact(a, b, c, d)
        else:
            t, p = welch(table.n[i], table.mean[i], table.std[i], table.n[j], table.mean[j], table.std[j])
        rows.append({"bin_a": i, "bin_b": j, "statistic": t, "p_value": p})
    return pd.DataFrame(rows, columns=["bin_a", "bin_b", "statistic", "p_value"])
