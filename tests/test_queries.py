"""Every registered query against its SQL counterpart in DuckDB, on whole tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from runledger.plans.registry import QUERIES
from tools.check_queries import TABLES, rows_of

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    frame = entry.queries()[name](spark, FOLDER)
    mine = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    if name not in entry.oracle_sql():
        assert mine
        return
    result = duck.execute(entry.oracle_sql()[name])
    names = [c[0] for c in result.description]
    assert sorted(frame.columns) == sorted(names)
    assert mine == rows_of(names, result.fetchall())


def test_entry_runs(spark):
    frame = entry.entry(spark)
    assert frame.count() == 10
    assert frame.columns == ["column", "type", "ks_statistic", "p_value", "frequency_distance", "drift_detected", "reason"]


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
