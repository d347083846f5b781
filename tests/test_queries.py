"""Every registered query that has SQL gives the same rows as DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from lexiloom.plans import registry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(v):
    if str(v) in ("None", "nan", "NaT", "<NA>"):
        return "None"
    if isinstance(v, float) and not math.isinf(v):
        return f"{v:.5f}".rstrip("0").rstrip(".")
    return str(v)


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(tuple(plain(v) for v in r) for r in frame[columns].itertuples(index=False, name=None))


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    found = QUERIES[name](spark, FOLDER).toPandas()
    if name in SQL:
        assert rows(found) == rows(duck.sql(SQL[name]).df())
    else:
        assert len(found.columns) > 0


def test_flagship(spark):
    assert registry.flagship(spark, FOLDER).count() == 10
