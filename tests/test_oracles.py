"""Every query with SQL against DuckDB, over the smallest tables."""

import math
import os

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def _value(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return tuple(_value(x) for x in v) if isinstance(v, list | tuple) else v


def _own():
    from lineweave.queries import ORACLES

    return sorted(ORACLES)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{t}')")
    return con


@pytest.mark.parametrize("name", _own())
def test_same_as_sql(spark, duck, name):
    from lineweave.queries import ORACLES, QUERIES

    df = QUERIES[name](spark, SF)
    cursor = duck.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    want = sorted((tuple(_value(r[names.index(c)]) for c in order) for r in cursor.fetchall()), key=repr)
    assert sorted((tuple(_value(r[c]) for c in order) for r in df.collect()), key=repr) == want


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
