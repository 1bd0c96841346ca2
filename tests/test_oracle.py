"""Every registered query runs; those with SQL give DuckDB's rows."""

import math
from pathlib import Path

import pytest

import __spark_entry__ as entry
from seamfinder.plans.catalog import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    return v.isoformat() if hasattr(v, "isoformat") else v


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=str)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for p in Path(DATA).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    got = rows(df.columns, df.collect())
    if name in ORACLE_SQL:
        c = duck.execute(ORACLE_SQL[name])
        names = [x[0] for x in c.description]
        want = rows(names, c.fetchall())
        assert sorted(df.columns) == sorted(names)
        assert len(got) == len(want)
        assert got == want
    assert got or name == "match_empty"


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
