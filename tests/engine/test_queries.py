"""Every registered query against DuckDB on the same tables."""

import os

import duckdb
import pytest
from marginalia import queries


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(repr([list(r[k]) if isinstance(r[k], list | tuple) else r[k] for k in order]) for r in data)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, sf_dir, duck, name):
    df, want = queries.QUERIES[name](spark, sf_dir), duck.sql(queries.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    got = rows(df.columns, map(tuple, df.collect()))
    assert got and got == rows(want.columns, want.fetchall())
