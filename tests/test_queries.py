"""Every registered query against its SQL twin on the smallest tables."""

import oracle
import pytest
from conftest import DATA

import __spark_entry__ as contract

QUERIES, SQL = contract.queries(), contract.oracle_sql()


def test_names_line_up():
    assert set(SQL) <= set(QUERIES)
    assert len(SQL) > 100


def test_entry(spark):
    assert contract.entry(spark).count() > 0


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    if name in SQL:
        ok, message = oracle.compare(df, duck, SQL[name])
        assert ok, message
    else:
        assert df.count() > 0
