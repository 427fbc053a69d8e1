"""Every engine query that SQL can express has the rows of its SQL."""

import pytest
from conftest import DATA, same_rows

from tessera.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_rows_are_those_of_the_sql(spark, oracle, name):
    same_rows(QUERIES[name](spark, f"{DATA}/sf0.01").toPandas(), oracle.sql(SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_queries_without_sql_have_rows(spark, name):
    assert QUERIES[name](spark, f"{DATA}/sf0.01").count() > 0
