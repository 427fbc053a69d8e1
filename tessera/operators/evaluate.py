"""Measures of predictions, and the points of the usual curves, as DataFrame aggregations.

Predictions are first counted by distinct score.  Running sums are made in buckets of
the score and then over the buckets, so no task orders all scores.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import quantiles

BUCKETS = 256


def prefix_sums(df: DataFrame, key: str, columns: list[str], ties: list[str] | None = None, descending: bool = False) -> DataFrame:
    """Add ``upto_<c>``, the running sum of each column by ``key`` with the row's own included, and ``total_<c>``.

    Rows of a bucket of ``key`` are ordered in one task, buckets hold about equal numbers of rows;
    the buckets' sums are a table of at most ``BUCKETS`` rows.  ``ties`` order equal keys.
    """
    found = df.agg(F.percentile_approx(F.col(key).cast("double"), [i / BUCKETS for i in range(1, BUCKETS)], 8 * BUCKETS)).first()[0] or []
    edges = [-float("inf"), *sorted(set(found)), float("inf")]
    rows = df.withColumn("_key", F.col(key).cast("double"))
    rows = Bucketizer(splits=edges, inputCol="_key", outputCol="_bucket").transform(rows) if len(edges) > 2 else rows.withColumn("_bucket", F.lit(0.0))
    way = lambda c: F.col(c).desc() if descending else F.col(c).asc()
    line = Window.partitionBy("_bucket").orderBy(way("_key"), *(ties or [])).rowsBetween(Window.unboundedPreceding, 0)
    sums = rows.groupBy("_bucket").agg(*[F.sum(c).alias(f"s_{c}") for c in columns])
    before = Window.orderBy(way("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        F.col("_bucket").alias("_b"),
        *[F.coalesce(F.sum(f"s_{c}").over(before), F.lit(0)).alias(f"b_{c}") for c in columns],
        *[F.sum(f"s_{c}").over(Window.partitionBy()).alias(f"total_{c}") for c in columns],
    )
    out = rows.select("*", *[F.sum(c).over(line).alias(f"w_{c}") for c in columns]).join(F.broadcast(offsets), F.col("_bucket") == F.col("_b"))
    return out.select(*df.columns, *[(F.col(f"b_{c}") + F.col(f"w_{c}")).alias(f"upto_{c}") for c in columns], *[f"total_{c}" for c in columns])


def score_counts(df: DataFrame, y: str, score: str) -> DataFrame:
    """``score, n_event, n_nonevent`` of each distinct score."""
    return df.where(F.col(y).isNotNull() & F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("score")).agg(
        F.sum((F.col(y) != 0).cast("long")).alias("n_event"), F.sum((F.col(y) == 0).cast("long")).alias("n_nonevent")
    )


def _running(df: DataFrame, y: str, score: str, descending: bool) -> DataFrame:
    return prefix_sums(score_counts(df, y, score), "score", ["n_event", "n_nonevent"], descending=descending)


def _share(c: str):
    return F.col(f"upto_{c}") / F.col(f"total_{c}")


def roc_points(df: DataFrame, y: str, score: str) -> DataFrame:
    """``threshold, fpr, tpr`` by falling score."""
    return _running(df, y, score, True).select(F.col("score").alias("threshold"), _share("n_nonevent").alias("fpr"), _share("n_event").alias("tpr"))


def auc(df: DataFrame, y: str, score: str) -> DataFrame:
    """``auc, gini``: ties count half."""
    c = _running(df, y, score, False)
    pairs = F.col("n_event") * (F.col("upto_n_nonevent") - F.col("n_nonevent") / 2)
    value = F.sum(pairs) / (F.sum("n_event") * F.sum("n_nonevent"))
    return c.agg(value.alias("auc"), (2 * value - 1).alias("gini"))


def cap_curve(df: DataFrame, y: str, score: str) -> DataFrame:
    """``threshold, population, captured``: shares of all rows and of events by falling score."""
    population = (F.col("upto_n_event") + F.col("upto_n_nonevent")) / (F.col("total_n_event") + F.col("total_n_nonevent"))
    return _running(df, y, score, True).select(F.col("score").alias("threshold"), population.alias("population"), _share("n_event").alias("captured"))


def ks_curve(df: DataFrame, y: str, score: str) -> DataFrame:
    """``threshold, p_event, p_nonevent, distance`` by rising score."""
    c = _running(df, y, score, False).select(F.col("score").alias("threshold"), _share("n_event").alias("p_event"), _share("n_nonevent").alias("p_nonevent"))
    return c.withColumn("distance", F.abs(F.col("p_nonevent") - F.col("p_event")))


def ks(df: DataFrame, y: str, score: str) -> DataFrame:
    """``ks, threshold``: the largest distance and the lowest score where it is reached."""
    return ks_curve(df, y, score).orderBy(F.col("distance").desc(), "threshold").limit(1).select(F.col("distance").alias("ks"), "threshold")


def ks_by_record(df: DataFrame, y: str, score: str, ident: str) -> DataFrame:
    """``ks``: of single records by rising score, with the population counted before each record.

    The nonevent share at a record is that of the records before it; this shifts it by one record.
    ``ident`` orders equal scores.
    """
    rows = df.select(F.col(score).alias("score"), F.col(ident).alias("ident"), (F.col(y) != 0).cast("long").alias("e"), F.lit(1).cast("long").alias("one"))
    c = prefix_sums(rows, "score", ["e", "one"], ["ident"])
    nonevents = F.col("total_one") - F.col("total_e")
    return c.agg(F.max((F.col("upto_one") - 1 - F.col("upto_e")) / nonevents - F.col("upto_e") / F.col("total_e")).alias("ks"))


def classification(df: DataFrame, y: str, prediction: str) -> DataFrame:
    """Rates of a confusion matrix, balanced accuracy and discriminant power; null where a denominator is 0."""
    true, guess = F.col(y) != 0, F.col(prediction) != 0
    c = df.agg(
        F.count_if(true & guess).alias("tp"), F.count_if(~true & guess).alias("fp"), F.count_if(~true & ~guess).alias("tn"), F.count_if(true & ~guess).alias("fn")
    )
    ratio = lambda a, b: F.when(F.col(a) + F.col(b) > 0, F.col(a) / (F.col(a) + F.col(b)))
    out = c.select(ratio("tp", "fn").alias("tpr"), ratio("tn", "fp").alias("tnr"), ratio("fp", "tn").alias("fpr"), ratio("fn", "tp").alias("fnr"))
    odds = lambda a: F.when((F.col(a) > 0) & (F.col(a) < 1), F.ln(F.col(a) / (1 - F.col(a))))
    return out.withColumn("balanced_accuracy", (F.col("tpr") + F.col("tnr")) / 2).withColumn("discriminant_power", F.lit(math.sqrt(3) / math.pi) * (odds("tpr") + odds("tnr")))


def regression(df: DataFrame, y: str, prediction: str) -> DataFrame:
    """Errors of predictions of a number; percentage errors leave out rows that divide by 0."""
    a, p = F.col(y).cast("double"), F.col(prediction).cast("double")
    e = a - p
    share = F.when(a != 0, e / a)
    both = F.when(F.abs(a) + F.abs(p) > 0, F.abs(e) / (F.abs(a) + F.abs(p)))
    half = lambda c: F.lit((quantiles(df, c, [0.5]) or [None])[0]).cast("double")
    return df.agg(
        F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"), half(F.abs(e)).alias("median_absolute_error"),
        (1 - F.var_pop(e) / F.var_pop(a)).alias("explained_variance"), (1 - F.sum(e * e) / (F.count(a) * F.var_pop(a))).alias("r2"),
        F.avg(share).alias("mpe"), F.avg(F.abs(share)).alias("mape"), half(F.abs(share)).alias("mdape"), F.avg(both).alias("smape"), half(both).alias("smdape"),
    )
