"""Registered queries against their SQL on the smallest tables, and the driver's contract."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from quartzvol.plans import registry, studies  # noqa: F401

DATA = Path("/root/testdata/sf0.001")
FAST = ["log_returns", "month_start", "realised_skew", "as_of_skew", "har_rv_forecast", "model_dataset", "wf_extended", "scorecard", "per_regime_qlike", "dm_stat", "dm_stat_lagged", "cw_stat_qlike", "regime_pair_table", "cw_corrected_stat", "mz_regression", "pnl", "tail_metrics", "episodes", "rejection_rates", "size_power_table", "importance_ranks", "snapshot_upsert", "daily_bars"]


def _plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])

    def text(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else f"{v:.6g}"
        return str(v)

    return sorted(tuple(text(r[k]) for k in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.skipif(not DATA.exists(), reason="the test tables are not here")
@pytest.mark.parametrize("name", FAST)
def test_query_equals_its_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, str(DATA))
    found = duck.execute(registry.ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(got.columns) == sorted(columns)
    assert _plain([tuple(r) for r in got.collect()], got.columns) == _plain(found.fetchall(), columns)
    spark.catalog.clearCache()


def test_every_sql_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.skipif(not DATA.exists(), reason="the test tables are not here")
def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
