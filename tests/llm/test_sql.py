"""The queries that SQL can express against their SQL."""

import duckdb
import pytest

from quernstone.llm import registry

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", registry.oracle_sql())
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(registry.oracle_sql()[name])
    names = [c[0] for c in want.description]
    got = registry.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(str, (tuple(r) for r in got.select(*names).collect()))) == sorted(map(str, want.fetchall()))
