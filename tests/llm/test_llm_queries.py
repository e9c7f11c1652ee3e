"""Queries with a SQL counterpart, on whole tables."""

import duckdb
import pytest

from runledger.llm import queries
from tools.check_queries import TABLES, rows_of

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    for table in TABLES:
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    frame = queries.QUERIES[name](spark, FOLDER)
    result = duck.execute(queries.ORACLES[name])
    names = [c[0] for c in result.description]
    assert sorted(frame.columns) == sorted(names)
    assert rows_of(frame.columns, [tuple(r) for r in frame.collect()]) == rows_of(names, result.fetchall())


def test_every_operator_has_its_query():
    assert {q.split("_")[0] for q in queries.QUERIES} == {f"op{n}" for n in range(1, 14)}
