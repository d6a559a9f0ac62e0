"""Queries with SQL against DuckDB, row by row, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from orderloom.llm import registry

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS FROM '{path}'")
    return c


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_is_its_sql(spark, duck, name):
    found = registry.queries()[name](spark, FOLDER)
    told = duck.sql(registry.oracle_sql()[name])
    assert sorted(found.columns) == sorted(told.columns)
    columns = sorted(found.columns)
    assert sorted(map(tuple, found.select(*columns).collect())) == sorted(told.select(*columns).fetchall())
