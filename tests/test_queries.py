"""Every catalog query against DuckDB on the smallest tables; those without SQL must give rows."""

import pytest

from lumora.plans import registry
from tests.oracle import connect, same

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    got = QUERIES[name](spark, FOLDER).toPandas()
    if name in SQL:
        same(got, connect(FOLDER).execute(SQL[name]).df())
    else:
        assert len(got)


def test_entry_point_imports_and_agrees(spark):
    import __spark_entry__ as e

    assert set(registry.queries()) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
