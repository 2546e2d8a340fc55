"""Every query that SQL can express, compared row by row with DuckDB."""

import pytest
from conftest import SMALL

from __spark_entry__ import entry, oracle_sql, queries
from check_oracles import compare, connect


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    good, note = compare(duck, spark, SMALL, name, queries()[name], oracle_sql()[name])
    assert good, note


def test_entry(spark):
    assert entry(spark).count() == 5


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())
