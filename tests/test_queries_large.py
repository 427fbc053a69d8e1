"""Queries over a column with more distinct values than cells have the rows of their SQL, too."""

import os

import duckdb
import numpy as np
import pytest
from conftest import DATA, same_rows

from tessera.operators.histogram import histogram
from tessera.operators.splits import cart_splits
from tessera.queries import QUERIES, SQL, lines

LARGE = f"{DATA}/sf0.1"
NAMES = [n for n in SQL if n.startswith("optimal_")] + ["triangular_model_data", "pvalue_conflicts", "min_diff_conflicts", "sign_changes", "trend_label", "quantile_prebins"]


@pytest.fixture(scope="module")
def large_oracle():
    con = duckdb.connect()
    for name in os.listdir(LARGE):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{LARGE}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(NAMES))
def test_rows_of_long_columns_are_those_of_the_sql(spark, large_oracle, name):
    same_rows(QUERIES[name](spark, LARGE).toPandas(), large_oracle.sql(SQL[name]).df())


def test_cart_prebins_of_long_columns_are_those_of_the_values(spark):
    h = histogram(lines(spark, LARGE), "l_extendedprice", "y1", "binary")
    want = cart_splits(h, "binary", 20, np.ceil(0.05 * h.total))
    got = QUERIES["cart_prebins"](spark, LARGE).toPandas().sort_values("split_id")["split"]
    assert got.tolist() == pytest.approx(want.tolist(), abs=1e-9)
