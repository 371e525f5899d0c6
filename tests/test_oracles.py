"""Every query against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from sheetstorm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{file}')")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    cursor = duck.execute(queries.ORACLES[name])
    columns = [x[0] for x in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    got = sorted((tuple(map(repr, (r[c] for c in order))) for r in df.collect()))
    want = sorted((tuple(map(repr, (r[columns.index(c)] for c in order))) for r in cursor.fetchall()))
    assert got == want
