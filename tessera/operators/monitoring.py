"""Stability and performance of a scorecard between expected and actual data.

Every table comes from conditional sums over one union of both data sets.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.special import chi2_test, welch
from . import evaluate
from .binning import NotFittedError, _need
from .encode import by_interval
from .histogram import cell_edges, histogram
from .quantiles import quantiles
from .scorecard import Scorecard
from .splits import prebin_splits
from .tables import interval_labels

#: Limits of the stability index and what they mean (fixed values).
LIMITS = ((0.1, "no significant change"), (0.25, "moderate change"), (float("inf"), "significant change"))


def psi(counts_a, counts_e) -> np.ndarray:
    """Terms of the population stability index of two lists of counts."""
    a, e = np.asarray(counts_a, float), np.asarray(counts_e, float)
    return stats.jeffrey(a / a.sum(), e / e.sum())


def psi_table(labels: list[str], counts_a, counts_e) -> pd.DataFrame:
    a, e = np.asarray(counts_a, np.int64), np.asarray(counts_e, np.int64)
    out = pd.DataFrame({"bin": labels, "count_a": a, "count_e": e, "count_a_pct": a / a.sum(), "count_e_pct": e / e.sum(), "psi": psi(a, e)})
    return pd.concat([out, pd.DataFrame([["Totals", int(a.sum()), int(e.sum()), 1.0, 1.0, float(out["psi"].sum())]], columns=out.columns)], ignore_index=True)


def verdict(value: float) -> str:
    return next(text for limit, text in LIMITS if value < limit or limit == float("inf"))


class Monitoring:
    """``fit`` compares actual with expected data."""

    def __init__(self, scorecard: Scorecard, psi_method: str = "cart", psi_n_bins: int = 20, psi_min_bin_size: float = 0.05, show_digits: int = 2, verbose: bool = False) -> None:
        _need(psi_method in ("uniform", "quantile", "cart"), ValueError, "psi_method is uniform, quantile or cart")
        _need(isinstance(psi_n_bins, int) and psi_n_bins > 0, ValueError, "psi_n_bins is a positive integer")
        _need(0 < psi_min_bin_size <= 0.5, ValueError, "psi_min_bin_size is in (0, 0.5]")
        self.scorecard, self.psi_method, self.psi_n_bins, self.psi_min_bin_size, self.show_digits = scorecard, psi_method, psi_n_bins, psi_min_bin_size, show_digits
        self.psi_splits: list[float] | None = None

    def fit(self, actual: DataFrame, expected: DataFrame, y: str) -> Monitoring:
        card, binary = self.scorecard, self.scorecard.kind == "binary"
        tagged = lambda df, name: card.score(df.where(F.col(y).isNotNull()), "_score").withColumn("_set", F.lit(name))
        e = tagged(expected, "e")
        h = histogram(e, "_score", y, card.kind, edges=cell_edges(e, "_score"))
        splits = prebin_splits(h, card.kind, self.psi_method, self.psi_n_bins, self.psi_min_bin_size * h.total)
        self.psi_splits = [float(s) for s in splits]
        names = [y, "_score", "_set", *card.variables]
        both = tagged(actual, "a").select(*names).unionByName(e.select(*names))
        index = by_interval(F.col("_score"), splits, F.lit, right_closed=True)  # bins are closed on the right here
        t = F.col(y)
        aggs = {"n": F.count("*"), "event": F.count_if(t != 0)} if binary else {"n": F.count("*"), "mean": F.avg(t), "std": F.stddev_pop(t)}
        rows = both.groupBy("_set", index.alias("bin")).agg(*[c.alias(k) for k, c in aggs.items()]).toPandas()
        n = len(splits) + 1
        side = {s: rows[rows["_set"] == s].set_index("bin").reindex(range(n)).fillna(0) for s in "ae"}
        labels = interval_labels(splits, self.show_digits)
        self.psi = psi_table(labels, side["a"]["n"], side["e"]["n"])
        self.tests = self._tests(labels, side, binary)
        self.target = self._target(both, y, side, binary)
        self.performance = {s: self._performance(df, y, binary) for s, df in (("actual", actual), ("expected", expected))}
        self.variables = self._variables(both)
        return self

    def _tests(self, labels, side, binary: bool) -> pd.DataFrame:
        out = []
        for i, label in enumerate(labels):
            a, e = side["a"].iloc[i], side["e"].iloc[i]
            if binary:
                t, p = chi2_test([[a["n"] - a["event"], a["event"]], [e["n"] - e["event"], e["event"]]])
                rate = lambda r: r["event"] / r["n"] if r["n"] else 0.0
                out.append([label, int(a["n"]), int(e["n"]), rate(a), rate(e), t, p])
            else:
                t, p = welch(a["n"], a["mean"], a["std"], e["n"], e["mean"], e["std"]) if a["n"] and e["n"] else (np.nan, np.nan)
                out.append([label, int(a["n"]), int(e["n"]), a["mean"], e["mean"], t, p])
        what = "event_rate" if binary else "mean"
        return pd.DataFrame(out, columns=["bin", "count_a", "count_e", f"{what}_a", f"{what}_e", "statistic", "p_value"])

    def _target(self, both: DataFrame, y: str, side, binary: bool) -> pd.DataFrame:
        if binary:
            rows = [["records", *(int(side[s]["n"].sum()) for s in "ae")], ["event", *(int(side[s]["event"].sum()) for s in "ae")]]
            rows.append(["non_event", rows[0][1] - rows[1][1], rows[0][2] - rows[1][2]])
            return pd.DataFrame(rows, columns=["metric", "actual", "expected"])
        t = F.col(y).cast("double")
        got = both.groupBy("_set").agg(F.avg(t).alias("mean"), F.stddev_pop(t).alias("std")).collect()
        by = {r["_set"]: [r["mean"], r["std"], *(quantiles(both.where(F.col("_set") == r["_set"]), t, [0.25, 0.5, 0.75]) or [None] * 3)] for r in got}
        return pd.DataFrame({"metric": ["mean", "std", "p25", "median", "p75"], "actual": by["a"], "expected": by["e"]})

    def _performance(self, df: DataFrame, y: str, binary: bool) -> dict[str, float]:
        predicted = self.scorecard.predict(df, "_prediction")
        if not binary:
            return evaluate.regression(predicted, y, "_prediction").first().asDict()
        scored = self.scorecard.predict_proba(predicted, "_probability")
        return evaluate.classification(scored, y, "_prediction").first().asDict() | evaluate.auc(scored, y, "_probability").first().asDict()

    def _variables(self, both: DataFrame) -> pd.DataFrame:
        """Counts of every bin of every variable, special and missing bins included."""
        card = self.scorecard
        codes = [F.struct(F.lit(v).alias("variable"), _index(card, v).alias("bin_id")) for v in card.variables]
        rows = both.select("_set", F.explode(F.array(*codes)).alias("c")).groupBy("c.variable", "c.bin_id").agg(
            F.count_if(F.col("_set") == "a").alias("count_a"), F.count_if(F.col("_set") == "e").alias("count_e")
        ).toPandas()
        out = []
        for v in card.variables:
            own = rows[(rows["variable"] == v) & (rows["bin_id"] >= 0)].set_index("bin_id").reindex(range(len(card.points[v]))).fillna(0)
            own = own[(own["count_a"] > 0) | (own["count_e"] > 0)]
            terms = psi(own["count_a"], own["count_e"])
            labels = card.process.models[v].labels(self.show_digits)
            out += [[v, int(i), labels[int(i)], int(a), int(e), float(x)] for i, a, e, x in zip(own.index, own["count_a"], own["count_e"], terms, strict=True)]
        return pd.DataFrame(out, columns=["variable", "bin_id", "bin", "count_a", "count_e", "psi"])

    def _need_fit(self) -> None:
        if self.psi_splits is None:
            raise NotFittedError("call fit first")

    def psi_table(self) -> pd.DataFrame:
        self._need_fit()
        return self.psi

    def psi_variable_table(self, name: str | None = None, style: str = "summary") -> pd.DataFrame:
        self._need_fit()
        _need(style in ("summary", "detailed"), ValueError, "style is summary or detailed")
        rows = self.variables if name is None else self.variables[self.variables["variable"] == name]
        return rows if style == "detailed" else rows.groupby("variable", as_index=False)["psi"].sum()

    def tests_table(self) -> pd.DataFrame:
        self._need_fit()
        return self.tests

    def psi_plot_data(self) -> pd.DataFrame:
        """Shares of records and event rates or means by bin."""
        self._need_fit()
        return self.psi.iloc[:-1][["bin", "count_a_pct", "count_e_pct"]].join(self.tests.iloc[:, 3:5])

    def system_stability_report(self) -> str:
        """The stability index with its verdict, tests, target and performance as text."""
        self._need_fit()
        total = float(self.psi["psi"].iloc[-1])
        bins = self.psi.iloc[:-1]["psi"]
        low = 0.0
        lines = [f"PSI {total:.6f}: {verdict(total)}"]
        for limit, text in LIMITS:
            lines.append(f"  bins in [{low}, {limit}): {int(((bins >= low) & (bins < limit)).sum())} ({text})")
            low = limit
        blocks = [self.tests.to_string(index=False), self.target.to_string(index=False), pd.DataFrame(self.performance).to_string()]
        return "\n\n".join(["\n".join(lines), *blocks])

    def information(self, print_level: int = 1) -> str:
        self._need_fit()
        return f"psi_method {self.psi_method}, bins {len(self.psi_splits) + 1}, variables {len(self.scorecard.variables)}"


def _index(card: Scorecard, v: str) -> Column:
    n = len(card.points[v])
    return card.process.models[v].lookup(F.col(v), list(range(n)), -1)
