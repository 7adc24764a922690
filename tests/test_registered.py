"""Every registered query runs; those with a DuckDB text give the same rows."""

import pytest

import __spark_entry__ as entry
import check
from conftest import SF

QUERIES, SQLS = entry.queries(), entry.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    ok, message = check.compare(spark, con, name, QUERIES[name], SQLS.get(name), SF)
    assert ok, message


def test_entry(spark):
    assert entry.entry(spark).count() > 0
