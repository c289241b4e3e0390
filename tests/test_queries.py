"""Every registered query with SQL gives the rows of that SQL."""

import os

import pytest
from oracle import compare, connect

import __spark_entry__ as entry

SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    if not os.path.isdir(sf_dir):
        pytest.skip("no test tables")
    return connect(sf_dir)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, con, sf_dir, name):
    assert compare(entry.queries()[name](spark, sf_dir), con, SQL[name]) is None
