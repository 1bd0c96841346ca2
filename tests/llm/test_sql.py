"""Queries whose SQL says the same, over the smallest tables."""

from pathlib import Path

import pytest

from seamfinder.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_like_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "labels"):
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    c.execute(ORACLE_SQL[name])
    names = [x[0] for x in c.description]
    got = QUERIES[name](spark, DATA)
    assert got.columns == names
    assert sorted(map(tuple, got.collect())) == sorted(c.fetchall()) != []
