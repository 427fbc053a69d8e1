"""Queries and operators whose columns have more distinct values than cells, on small tables with lowered bounds."""

import duckdb
import numpy as np
import pytest
from conftest import DATA, same_rows
from pyspark.sql import functions as F

from tessera.operators import histogram as cells
from tessera.operators.histogram import histogram, refine
from tessera.operators.rows import range_bounds
from tessera.queries import FOUR, QUERIES, SQL


def test_many_cells_are_refined_at_once(spark):
    df = spark.range(8000).select(F.col("id").cast("double").alias("x"), (F.col("id") % 3 % 2).cast("int").alias("y"))
    h = histogram(df, "x", "y", "binary", edges=[-np.inf, *np.arange(2.0, 8000, 2), np.inf])
    got, want = refine(h, df, "x", "y", "binary", np.arange(1, 4000, 1)), histogram(df, "x", "y", "binary")
    assert got.low.tolist() == [0.0, *want.low[2:]] and got.high.tolist() == want.low[1:].tolist()
    assert got.moments["n1"].tolist() == [want.moments["n1"][:2].sum(), *want.moments["n1"][2:]]


@pytest.mark.parametrize("name", ["disk_fit_transform", "process_fit_transform", "process_transform", "scorecard_points_intercept_based", "scorecard_points_min_max", "scorecard_points_pdo", "scorecard_probability", "scorecard_rounded", "scorecard_saved", "scorecard_score", "scorecard_transform"])
def test_rows_of_long_columns_with_user_splits_are_those_of_the_sql(spark, oracle, monkeypatch, name):
    monkeypatch.setattr(cells, "MAX_DISTINCT", 500)
    monkeypatch.setattr(cells, "CELLS", 64)
    same_rows(QUERIES[name](spark, f"{DATA}/sf0.01").toPandas(), oracle.sql(SQL[name]).df())


@pytest.mark.parametrize("value", ["floor(40 * sin(id))", "floor(exp(id % 100 / 12))", "id % 2"])
@pytest.mark.parametrize("share", [0.1, 0.5, 1.0])
def test_shortest_interval_of_repeated_values(spark, value, share):
    df = spark.range(1000).select(F.expr(value).cast("double").alias("v"))
    v = np.sort(df.toPandas()["v"].to_numpy())
    reach = int(np.ceil(share * len(v)))
    width = v[reach - 1 :] - v[: len(v) - reach + 1]
    k = int(np.argmin(width))
    got = range_bounds(df, "v", share, 0.0, "HDI")
    assert (got.low, got.high) == (v[k], v[k + reach - 1])


@pytest.mark.parametrize("name", ["disk_fit_transform", "scorecard_points_pdo", "scorecard_probability", "scorecard_score"])
@pytest.mark.parametrize(("most", "one_pass"), [(0, 0), (0, 1 << 60), (1 << 60, 0)])
def test_rows_with_user_splits_depend_on_no_bound_of_sizes(spark, monkeypatch, name, most, one_pass):
    want = QUERIES[name](spark, f"{DATA}/sf0.001").toPandas()
    monkeypatch.setattr(cells, "MAX_DISTINCT", most)
    monkeypatch.setattr(cells, "ONE_PASS", one_pass)
    monkeypatch.setattr(cells, "CELLS", 8)
    same_rows(QUERIES[name](spark, f"{DATA}/sf0.001").toPandas(), want)


@pytest.mark.parametrize("name", ["process_fit_transform", "process_transform"])
def test_rows_of_missing_values_are_those_of_the_sql(spark, tmp_path, name):
    gaps = ", ".join(f"CASE WHEN hash(l_orderkey, l_linenumber, '{c}') % 50 > 0 THEN {c} END AS {c}" for c in FOUR)
    con = duckdb.connect()
    con.sql(f"COPY (SELECT * REPLACE ({gaps}) FROM '{DATA}/sf0.001/lineitem.parquet') TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    same_rows(QUERIES[name](spark, str(tmp_path)).toPandas(), con.sql(SQL[name]).df())
