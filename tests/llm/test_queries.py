"""Every query of the folder runs on the smallest tables; those with SQL agree with it."""

from __future__ import annotations

import os
from pathlib import Path

import duckdb
import pytest

from sparkloom.llm import queries

DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no tables")
COLUMNS = {
    "p1_found": [("limit_name", "string"), ("page_id", "bigint"), ("block_no", "bigint")], "p2_found": [("page_id", "bigint")], "p3_found": [("page_id", "bigint"), ("block_no", "bigint")], "p4_found": [("page_a", "bigint"), ("page_b", "bigint")],
    "p5_found": [("page_id", "bigint"), ("line_no", "bigint")], "p6_found": [("page_id", "bigint")], "p7_ids": [("doc_id", "bigint"), ("ids", "array<int>")], "p9_found": [("doc_id", "bigint")],
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, str(DATA))
    rows = [tuple(map(str, r)) for r in df.select(*sorted(df.columns)).collect()]
    if name in COLUMNS:
        assert df.dtypes == COLUMNS[name] and len(rows) == len(set(rows))
    if name in queries.ORACLES:
        con = duckdb.connect()
        for path in DATA.glob("*.parquet"):
            con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
        result = con.execute(queries.ORACLES[name])
        names = [d[0] for d in result.description]
        order = sorted(range(len(names)), key=lambda k: names[k])
        assert sorted(rows) == sorted(tuple(str(r[k]) for k in order) for r in result.fetchall())
