"""Every registered library query against its SQL in DuckDB."""

import pytest
from conftest import DATA, same

from winlog_spark.queries import QUERIES, SQL

WITHOUT_SQL = sorted(set(QUERIES) - set(SQL))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_sql(spark, duck, name):
    same(QUERIES[name](spark, str(DATA)), duck, SQL[name])


@pytest.mark.parametrize("name", WITHOUT_SQL)
def test_query_runs(spark, name):
    assert QUERIES[name](spark, str(DATA)).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert set(SQL) <= set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["ip", "n"]
