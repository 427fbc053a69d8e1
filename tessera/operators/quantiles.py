"""Exact quantiles without a task that holds all distinct values.

Values are counted where they are distinct.  While there are too many for the
driver, they are dealt to buckets of about equal numbers of distinct values and
only the buckets that hold a wanted rank are looked at again.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 256
FEW = 50_000  # distinct values that the driver takes at most


def quantiles(df: DataFrame, value: Column | str, at: list[float]) -> list[float] | None:
    """The quantiles of the values that are not null, linear between ranks; None without a value.  NaN counts as the largest."""
    counts = df.select((F.col(value) if isinstance(value, str) else value).cast("double").alias("v")).where("v IS NOT NULL").groupBy("v").agg(F.count("*").alias("c"))
    some = counts.limit(FEW + 1).collect()
    n = sum(r["c"] for r in some) if len(some) <= FEW else counts.agg(F.sum("c")).first()[0]
    if not n:
        return None
    places = [p * (n - 1) for p in at]
    ranks = sorted({f(p) for p in places for f in (math.floor, math.ceil)})
    found = _pick(some, ranks) if len(some) <= FEW else _search(counts, ranks)
    out = []
    for p in places:
        a, b = found[math.floor(p)], found[math.ceil(p)]
        out.append(a if a == b else (math.ceil(p) - p) * a + (p - math.floor(p)) * b)
    return out


def _pick(rows: list, ranks: list[int]) -> dict[int, float]:
    """The values at ranks from 0, of counted values."""
    ordered = sorted(((r["v"], r["c"]) for r in rows), key=lambda r: (r[0] != r[0], r[0]))
    out, upto, left = {}, 0, list(ranks)
    for v, c in ordered:
        upto += c
        while left and left[0] < upto:
            out[left.pop(0)] = v
    return out


def _search(counts: DataFrame, ranks: list[int]) -> dict[int, float]:
    edges = counts.agg(F.percentile_approx("v", [i / BUCKETS for i in range(1, BUCKETS)], 8 * BUCKETS)).first()[0]
    splits = [-math.inf, *sorted({e for e in edges if math.isfinite(e)}), math.inf]
    dealt = Bucketizer(splits=splits, inputCol="v", outputCol="b", handleInvalid="keep").transform(counts)
    out: dict[int, float] = {}
    before = 0
    for r in sorted(dealt.groupBy("b").agg(F.sum("c").alias("c"), F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect(), key=lambda r: r["b"]):
        inside = [k for k in ranks if before <= k < before + r["c"]]
        if inside and r["n"] == 1:
            out |= dict.fromkeys(inside, r["low"])
        elif inside:
            part, own = counts.where(F.col("v").between(r["low"], r["high"])), [k - before for k in inside]
            found = _pick(part.collect(), own) if r["n"] <= FEW else _search(part, own)
            out |= {k + before: v for k, v in found.items()}
        before += r["c"]
    return out
