"""Corpus queries against their SQL on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from quartzvol.llm.oracles import ORACLE_SQL
from quartzvol.llm.queries import QUERIES

DATA = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not DATA.exists(), reason="the test tables are not here")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    found = con.execute(ORACLE_SQL[name])
    columns = sorted(c[0] for c in found.description)
    want = [dict(zip((c[0] for c in found.description), row, strict=True)) for row in found.fetchall()]
    got = QUERIES[name](spark, str(DATA))
    assert sorted(got.columns) == columns
    rows = [r.asDict() for r in got.collect()]
    plain = lambda all_rows: sorted(tuple(str(r[c]) for c in columns) for r in all_rows)
    assert plain(rows) == plain(want)
