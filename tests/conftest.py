import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "4g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def oracle():
    """A DuckDB connection with the small tables as views."""
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(f"{DATA}/sf0.01"):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{DATA}/sf0.01/{name}'")
    return con


def cell(v):
    import numpy as np
    import pandas as pd

    if v is None or v is pd.NA or v is pd.NaT:
        return "null"
    if isinstance(v, bool | np.bool_):
        return str(bool(v))
    if isinstance(v, float | np.floating):
        return "null" if v != v else f"{v:.5g}"
    if isinstance(v, int | np.integer):
        return f"{float(v):.5g}" if abs(v) < 1e5 else str(int(v))
    return str(v)


def same_rows(a, b):
    """Whether two pandas frames hold the same rows in any order."""
    assert sorted(a.columns) == sorted(b.columns)
    names = sorted(a.columns)
    rows = lambda t: sorted(tuple(cell(v) for v in r) for r in t[names].astype(object).itertuples(index=False))
    assert rows(a) == rows(b)
