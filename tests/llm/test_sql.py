"""The queries that SQL can express, against DuckDB over the same tables."""

import duckdb
import pytest

from quillstream.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, name):
    df = queries.queries()[name](spark, SF)
    columns = sorted(df.columns)
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    found = c.sql(queries.oracle_sql()[name])
    assert sorted(found.columns) == columns
    at = [found.columns.index(x) for x in columns]
    assert sorted(tuple(r[x] for x in columns) for r in df.collect()) == sorted(tuple(r[k] for k in at) for r in found.fetchall())


def test_names():
    assert set(queries.oracle_sql()) < set(queries.queries())
