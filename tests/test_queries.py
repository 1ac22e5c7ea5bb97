import duckdb
import pytest

import __spark_entry__ as entry
from catalog.queries import all_queries
from check import TABLES, compare

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query_matches_statement(spark, connection, name):
    statement = entry.oracle_sql()[name]
    verdict = compare(spark, connection, SF_DIR, name, entry.queries()[name], statement)
    assert verdict.startswith("ok") and "TYPES" not in verdict, verdict


def test_every_statement_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(all_queries()) <= set(entry.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
