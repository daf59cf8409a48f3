"""Every registered query with SQL agrees with DuckDB on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
import check

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    c = duckdb.connect()
    for name in check.TABLES:
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(set(entry.queries())))
def test_query_matches_its_sql(spark, connection, name):
    status, rows, _, _, note = check.compare(spark, connection, FOLDER, name)
    assert status in ("ok", "rows"), note
    assert rows > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
