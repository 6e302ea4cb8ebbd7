"""Every query runs; those with SQL give the rows that DuckDB gives."""

import pytest
from conftest import SMALL, same_as_sql

from pagewright.plans import registry

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    same_as_sql(spark, duck, registry.queries()[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_query_runs(spark, name):
    df = registry.queries()[name](spark, SMALL)
    assert len(df.collect()) > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
