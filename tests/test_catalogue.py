import duckdb
import pytest

from orderloom.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_its_sql(spark, oracle, name):
    df = catalogue.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    want = oracle.sql(catalogue.oracle_sql()[name])
    assert sorted(want.columns) == columns
    rows = oracle.sql(f"select {', '.join(f'\"{c}\"' for c in columns)} from ({catalogue.oracle_sql()[name]})").fetchall()
    got = [tuple(r) for r in df.select(columns).collect()]
    plain = lambda r: tuple(float(v) if hasattr(v, "as_tuple") else v for v in r)
    assert sorted(map(plain, got), key=repr) == sorted(map(plain, rows), key=repr)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
