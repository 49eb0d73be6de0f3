"""Every query of the library against its SQL on the small tables."""

import duckdb
import pytest
from oracle import TABLES, spark_rows, sql_rows

from siftline import catalog


@pytest.fixture(scope="module")
def connection(sf):
    found = duckdb.connect()
    for name in TABLES:
        found.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return found


@pytest.mark.parametrize("key", sorted(catalog.queries()))
def test_query_equals_sql(spark, sf, connection, key):
    got = spark_rows(catalog.queries()[key](spark, sf))
    sql = catalog.oracle_sql().get(key)
    if sql is not None:
        assert got == sql_rows(connection, sql)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
