"""The panel is checked in all its years after writing, target drivers at all horizons."""

import pytest

import __spark_entry__ as entry
from registry.panel import H
from test_queries import SF, duck  # noqa: F401


@pytest.mark.parametrize("name, column, few", [("write_and_read_all_years", "year", 2), ("target_week_drivers_all_horizons", "horizon", len(H))])
def test_whole_table_matches_sql(spark, duck, name, column, few):  # noqa: F811
    df = entry.queries()[name](spark, SF)
    got = sorted(map(repr, map(tuple, df.collect())))
    cur = duck.execute(entry.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert names == df.columns
    rows = cur.fetchall()
    assert got == sorted(map(repr, rows)) and len({r[names.index(column)] for r in rows}) >= few
