"""Every query with an SQL counterpart gives the same rows in Spark and DuckDB."""

import decimal
import math

import duckdb
import pytest

from tickloom import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return round(float(v), 6) if isinstance(v, decimal.Decimal) else v


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_query(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    other = duck.sql(plans.ORACLE_SQL[name])
    columns = sorted(other.columns)
    assert sorted(df.columns) == columns
    mine = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    at = [other.columns.index(c) for c in columns]
    theirs = sorted((tuple(plain(r[i]) for i in at) for r in other.fetchall()), key=repr)
    assert len(mine) == len(theirs)
    for a, b in zip(mine, theirs, strict=True):
        assert a == pytest.approx(b, abs=2e-6) if all(isinstance(x, (int, float)) for x in a) else all(x == y or (isinstance(x, float) and abs(x - y) < 2e-6) for x, y in zip(a, b, strict=True)), (a, b)
