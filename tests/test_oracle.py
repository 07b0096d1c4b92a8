"""Every query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from quernstone import suite

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def rows(found):
    return sorted(tuple(repr(float(v)) if isinstance(v, float) else str(v) for v in r) for r in found)


@pytest.mark.parametrize("name", sorted(suite.queries()))
def test_query(spark, duck, name):
    df = suite.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = df.select(*cols).collect()
    sql = suite.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    assert cols == sorted(duck.sql(sql).columns)
    assert rows(got) == rows(duck.sql(f"SELECT {', '.join(cols)} FROM ({sql})").fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
