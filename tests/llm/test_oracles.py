"""The queries of this subpackage that have SQL against it in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from sheetstorm.llm import queries

from .helpers import SF


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, name):
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{file}')")
    df = queries.queries()[name](spark, SF)
    cursor = con.execute(queries.oracle_sql()[name])
    columns = [x[0] for x in cursor.description]
    order = sorted(columns)
    assert order == sorted(df.columns)
    got = sorted(tuple(map(repr, (r[c] for c in order))) for r in df.collect())
    want = sorted(tuple(map(repr, (r[columns.index(c)] for c in order))) for r in cursor.fetchall())
    assert got == want
