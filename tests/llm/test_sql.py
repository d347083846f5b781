"""Queries of this package that SQL can express give DuckDB's rows on the smallest tables."""

import os

import duckdb
import pytest

from lexiloom.llm import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "embeddings", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    want = con.sql(queries.SQL[name])
    columns = sorted(want.columns)
    plain = lambda rows: sorted(repr(tuple(r)) for r in rows)
    assert plain(queries.QUERIES[name](spark, FOLDER).select(*columns).collect()) == plain(want.select(*[f'"{c}"' for c in columns]).fetchall())
