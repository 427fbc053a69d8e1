"""Classification of rows as Column expressions, and outlier bounds."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .quantiles import quantiles

CLEAN, MISSING, SPECIAL = "clean", "missing", "special"


def is_numeric(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.NumericType)


def is_missing(x: Column, numeric: bool) -> Column:
    """Null, or NaN for numbers."""
    return (x.isNull() | F.isnan(x.cast("double"))) if numeric else x.isNull()


def special_labels(special_codes) -> list[tuple[str, list]]:
    """(label, codes) in order: one label for a list, one for each entry of a dict."""
    if special_codes is None or len(special_codes) == 0:
        return [("Special", [])]
    if isinstance(special_codes, dict):
        return [(str(k), list(v) if isinstance(v, list | tuple | set) else [v]) for k, v in special_codes.items()]
    return [("Special", list(special_codes))]


def row_class(x: Column, numeric: bool, special_codes=None) -> Column:
    """``missing``, ``special:<number of the label>`` or ``clean``; a missing value is never special."""
    out = F.when(is_missing(x, numeric), MISSING)
    for i, (_, codes) in enumerate(special_labels(special_codes)):
        if codes:
            out = out.when(x.isin([float(c) for c in codes] if numeric else [str(c) for c in codes]), f"{SPECIAL}:{i}")
    return out.otherwise(CLEAN)


def clean_rows(df: DataFrame, x: str, special_codes=None) -> DataFrame:
    return df.where(row_class(F.col(x), is_numeric(df, x), special_codes) == CLEAN)


def within(df: DataFrame, x: str, low: float | None = None, high: float | None = None) -> DataFrame:
    """Rows with x from ``low`` to ``high``; both bounds hold where both are given.  Missing values stay."""
    x_ = F.col(x)
    keep = F.lit(True)
    if low is not None:
        keep &= x_ >= low
    if high is not None:
        keep &= x_ <= high
    return df.where(is_missing(x_, is_numeric(df, x)) | keep)


# ---------------------------------------------------------------- outliers


@dataclass
class Bounds:
    """Values from ``low`` to ``high`` are kept; ``at`` limits a pair of bounds to x from at[0] to below at[1]."""

    low: float
    high: float
    at: tuple[float, float] = (-math.inf, math.inf)


def range_bounds(df: DataFrame, x: str, interval_length: float = 0.5, k: float = 1.5, method: str = "ETI") -> Bounds:
    """Bounds k widths beyond an interval that holds ``interval_length`` of the values.

    ETI takes equal tails, HDI the shortest interval (the first of equally short ones).
    """
    if not 0 < interval_length <= 1 or k < 0 or method not in ("ETI", "HDI"):
        raise ValueError("interval_length in (0, 1], k >= 0, method ETI or HDI")
    rows = df.where(~is_missing(F.col(x), True)).select(F.col(x).cast("double").alias("v"))
    if method == "ETI":
        tail = (1 - interval_length) / 2
        low, high = quantiles(rows, "v", [tail, 1 - tail]) or (math.nan, math.nan)
    else:
        low, high = _shortest(rows, interval_length)
    return Bounds(low - k * (high - low), high + k * (high - low))


def _shortest(rows: DataFrame, share: float) -> tuple[float, float]:
    """Ends of the shortest run of ceil(share * n) of the sorted values, the first of equally short ones.

    A shortest run that starts at a value starts at the value's first copy.  The values are numbered
    by running sums in buckets, then each first value is matched to the value whose numbers hold its
    goal by a merge of both in the same order.
    """
    from .evaluate import prefix_sums

    counts = rows.groupBy("v").agg(F.count("*").cast("long").alias("c"))
    ranked = prefix_sums(counts, "v", ["c"])
    n = rows.count()
    reach = math.ceil(share * n)
    if not n:
        return math.nan, math.nan
    # goals and first numbers on one line of numbers, in blocks of it; a block's last value is carried on
    block = max(1, n // 256)
    marks = ranked.select((F.col("upto_c") - F.col("c") + 1).alias("at"), F.col("v").alias("to"), F.lit(None).cast("double").alias("a"), F.lit(0).alias("goal"))
    goals = ranked.select((F.col("upto_c") - F.col("c") + reach).alias("at"), F.lit(None).cast("double").alias("to"), F.col("v").alias("a"), F.lit(1).alias("goal")).where(F.col("at") <= n)
    both = marks.unionByName(goals).withColumn("block", F.floor(F.col("at") / block))
    line = Window.partitionBy("block").orderBy("at", "goal").rowsBetween(Window.unboundedPreceding, 0)
    ends = both.groupBy("block").agg(F.max("to").alias("last"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(F.col("block").alias("_b"), F.max("last").over(before).alias("carry"))  # a few hundred blocks
    found = both.withColumn("own", F.last("to", ignorenulls=True).over(line)).where("goal = 1").join(carried, F.col("block") == F.col("_b"))
    best = found.select("a", F.coalesce("own", "carry").alias("b")).withColumn("w", F.col("b") - F.col("a")).orderBy("w", "a").first()
    return (best["a"], best["b"]) if best else (math.nan, math.nan)


def zscore_bounds(df: DataFrame, x: str, threshold: float = 3.5) -> Bounds:
    """Bounds of the modified z-score: 0.6745 |x - median| / MAD up to ``threshold``; none if MAD is 0."""
    rows = df.where(~is_missing(F.col(x), True)).select(F.col(x).cast("double").alias("v"))
    middle = quantiles(rows, "v", [0.5])
    if middle is None:
        return Bounds(-math.inf, math.inf)
    middle = middle[0]
    mad = quantiles(rows, F.abs(F.col("v") - F.lit(middle)), [0.5])[0]
    if not mad:
        return Bounds(-math.inf, math.inf)
    reach = threshold * mad / 0.6745
    return Bounds(middle - reach, middle + reach)


def y_quantile_bounds(df: DataFrame, x: str, y: str, outlier_detector: str = "zscore", outlier_params: dict | None = None, n_bins: int = 5) -> list[Bounds]:
    """Bounds on ``y`` for each of ``n_bins`` quantile bins of ``x``."""
    rows = df.where(~is_missing(F.col(x), True) & ~is_missing(F.col(y), True))
    inner = quantiles(rows, x, [i / n_bins for i in range(1, n_bins)]) or []
    edges = [-math.inf, *sorted(set(inner)), math.inf]
    out = []
    for a, b in zip(edges, edges[1:], strict=False):
        inside = rows.where((F.col(x) >= a) & (F.col(x) < b))
        found = outlier_bounds(inside, y, outlier_detector, outlier_params)
        out.append(Bounds(found.low, found.high, (a, b)))
    return out


def outlier_bounds(df: DataFrame, x: str, detector: str, params: dict | None = None) -> Bounds:
    if detector not in ("range", "zscore"):
        raise ValueError('outlier detectors are "range" and "zscore"')
    return (range_bounds if detector == "range" else zscore_bounds)(df, x, **(params or {}))


def is_outlier(x: Column, bounds: Bounds | list[Bounds], y: Column | None = None) -> Column:
    """Whether a value lies outside; with a list, ``y`` against the bounds of the bin that ``x`` is in."""
    if isinstance(bounds, Bounds):
        return (x < bounds.low) | (x > bounds.high)
    out = F.lit(False)
    for b in bounds:
        out = F.when((x >= b.at[0]) & (x < b.at[1]), (y < b.low) | (y > b.high)).otherwise(out)
    return out
