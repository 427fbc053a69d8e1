"""Quantiles are those of Spark's own exact aggregate, when values are searched in buckets, too."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import quantiles as q

AT = [0.0, 0.1, 0.25, 0.5, 2 / 3, 0.9, 1.0]


@pytest.mark.parametrize("few", [30, 50_000])
@pytest.mark.parametrize("value", ["id", "id % 7", "CASE WHEN id % 10 < 9 THEN 5 ELSE id END", "CASE WHEN id % 3 = 0 THEN NULL ELSE sin(id) END", "-1", "CASE WHEN id = 3 THEN double('-infinity') WHEN id = 4 THEN double('infinity') ELSE id END"])
def test_quantiles(spark, monkeypatch, few, value):
    monkeypatch.setattr(q, "FEW", few)
    monkeypatch.setattr(q, "BUCKETS", 16)
    df = spark.range(400).select(F.expr(value).cast("double").alias("x"))
    want = df.agg(F.percentile("x", F.array(*map(F.lit, AT)))).first()[0]
    assert q.quantiles(df, "x", AT) == pytest.approx(want, abs=1e-9)
    assert q.quantiles(df.where("x > 1e9 AND x < 2e9"), F.col("x"), AT) is None
