"""Queries with SQL, against DuckDB."""

import os

import duckdb
import pytest
from marginalia.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, sf_dir, name):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    df, want = queries.QUERIES[name](spark, sf_dir), con.sql(queries.ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    show = lambda r, names: repr([r[names.index(c)] for c in columns])
    assert sorted(show(tuple(r), df.columns) for r in df.collect()) == sorted(show(r, want.columns) for r in want.fetchall())
