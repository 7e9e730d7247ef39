"""A few registered queries against their SQL at the smallest scale."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from registry.core import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
NAMES = ["baseline_wape_by_category", "clean_sales_dedupe", "panel_weekly", "pareto_concentration",
         "risk_table", "recovered_demand", "residual_quantiles"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def test_registry_is_complete():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(ORACLES) <= set(QUERIES)
    assert len(QUERIES) - len(ORACLES) <= 5  # fitted models, whose checks stand in backtest_checks


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(map(repr, (tuple(r) for r in df.select(*columns).collect())))
    cur = duck.execute(entry.oracle_sql()[name])
    order = sorted(range(len(cur.description)), key=lambda i: cur.description[i][0])
    assert [cur.description[i][0] for i in order] == columns
    want = sorted(repr(tuple(r[i] for i in order)) for r in cur.fetchall())
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() == 6
