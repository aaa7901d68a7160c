"""The queries run on the smallest tables, and agree with their SQL."""

from __future__ import annotations

import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from sparkloom.plans import registry

DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, float):
        return None if value != value else round(value, 6)
    return value


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, str(DATA))
    rows = sorted(tuple(map(str, map(plain, r))) for r in df.select(*sorted(df.columns)).collect())
    sql = entry.oracle_sql().get(name)
    if sql:
        result = duck.execute(sql)
        names = [d[0] for d in result.description]
        order = sorted(range(len(names)), key=lambda k: names[k])
        assert sorted(names) == sorted(df.columns)
        assert rows == sorted(tuple(str(plain(r[k])) for k in order) for r in result.fetchall())


def test_stream_equals_batch(spark):
    batch, stream = (entry.queries()[n](spark, str(DATA)).collect() for n in ("early_abort", "stream_abort"))
    assert {tuple(r) for r in batch} == {tuple(r) for r in stream}


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
