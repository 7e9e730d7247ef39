"""Results that must not cost a copy of every SKU-week."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from registry import decisions, hierarchy
from stockloom import session
from stockloom.operators import audit as A
from stockloom.operators import censoring as Z
from stockloom.operators import coldstart as C
from stockloom.operators import insights as I
from stockloom.operators import panel as P

FIRST, LAST = dt.date(2020, 1, 1), dt.date(2021, 12, 31)


def _sales(spark):
    rows = [(dt.date(2020, 1, 8), "A", 2.0, 10.0, 5.0, 1), (dt.date(2020, 1, 10), "A", 1.0, 6.0, 6.0, 0),
            (dt.date(2021, 3, 1), "A", 3.0, 21.0, 7.0, 0), (dt.date(2020, 6, 3), "B", None, 4.0, None, None)]
    return spark.createDataFrame(rows, "date date, sku_id string, units_sold double, revenue double, unit_price double, promo_flag int")


def _master(spark):
    launch = dt.date(2020, 1, 1)
    rows = [(s, "Decor", "X", launch, 1.0, 2.0) for s in ("A", "B", "C")] + [(None, "Decor", "X", launch, 1.0, None)]
    return spark.createDataFrame(rows, "sku_id string, category string, subcategory string, launch_date date, unit_cost double, list_price double")


def _weeks(spark):
    return spark.createDataFrame([(dt.date(2019, 12, 30) + dt.timedelta(weeks=k), float(k % 2)) for k in range(110)], "week_start date, holiday_days double")


def test_runs_grow_with_sales_and_unfold_into_the_daily_sums(spark):
    runs = P.week_runs(_sales(spark), _master(spark), FIRST, LAST)
    assert runs.count() <= 16  # 4 SKUs over 104 weeks, 4 sales
    panel = P.unfold_runs(runs, _weeks(spark))
    daily = P.daily_grid(_sales(spark), _master(spark), (FIRST, LAST)).withColumn("week_start", F.date_trunc("week", "date").cast("date"))
    by_day = daily.groupBy("sku_id", "week_start").agg(
        F.sum("units_sold").alias("units"), F.sum("revenue").alias("revenue"), F.round(F.avg("unit_price"), 9).alias("avg_price"),
        F.sum("promo_flag").cast("double").alias("promo_days"), F.count(F.lit(1)).alias("n")).filter("n = 7").drop("n")
    short = panel.select("sku_id", "week_start", "units", "revenue", F.round("avg_price", 9).alias("avg_price"), "promo_days")
    assert short.filter("sku_id <> 'B' or sku_id is null").exceptAll(by_day.filter("sku_id <> 'B' or sku_id is null")).count() == 0
    assert short.count() == by_day.count() == 4 * 103


@pytest.mark.parametrize("since", [dt.date(2020, 1, 6), dt.date(2020, 1, 13), dt.date(2021, 3, 1), dt.date(2021, 11, 29)])
def test_a_panel_from_a_week_on_is_the_end_of_the_panel(spark, since):
    runs = P.week_runs(_sales(spark), _master(spark), FIRST, LAST)
    late, whole = P.unfold_runs(runs, _weeks(spark), since), P.unfold_runs(runs, _weeks(spark)).filter(F.col("week_start") >= F.lit(since))
    assert late.count() == whole.count() > 0 and late.exceptAll(whole).count() == 0


def test_cut_drops_the_shuffles_and_leaves_the_session_as_it_was(spark):
    before = spark.conf.get(session._CLEAN, None)
    out = session.cut(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    assert out.count() == 7 and spark.conf.get(session._CLEAN, None) == before


class _Written:
    """Counts the rows that a module writes with ``cut``."""

    def __init__(self):
        self.rows = []

    def __call__(self, df):
        out = session.cut(df)
        self.rows.append(out.count())
        return out


@pytest.mark.parametrize("module, work", [(decisions, lambda R: decisions.risk_inputs(R)), (hierarchy, lambda R: hierarchy.residuals(R))])
def test_risk_and_residuals_do_not_write_the_panel(spark, monkeypatch, module, work):
    from registry.core import part

    R, written = part(spark, "/root/testdata/sf0.001"), _Written()
    monkeypatch.setattr(module, "cut", written)
    work(R)
    # Eight horizons of a SKU, or the residuals of 157 nodes; a panel has a row per SKU and week.
    assert written.rows and max(written.rows) < R.panel.count() / 2


def test_tail_profile_and_attributes_read_the_panel_once(spark):
    seen = spark.sparkContext.accumulator(0)
    rows = [(f"S{k % 9}", "Decor", "X" if k % 2 else "Y", dt.date(2020, 1, 6) + dt.timedelta(weeks=k // 9), float(k % 3), 2.0 + k % 9, 1.0) for k in range(270)]

    def note(row):
        seen.add(1)
        return row

    panel = spark.createDataFrame(spark.sparkContext.parallelize(rows, 2).map(note), "sku_id string, category string, subcategory string, week_start date, units double, list_price double, unit_cost double")
    assert I.tail_profile(panel).first()["skus"] == 9
    assert seen.value == len(rows)
    seen.value = 0
    table = {r["sku_id"]: r["list_price"] for r in C.attributes(panel).collect()}
    assert table == {f"S{k}": 2.0 + k for k in range(9)} and seen.value == len(rows)


def test_a_target_keeps_few_leaves_and_the_exact_neighbours(spark):
    points = [(f"P{k:04d}", f"C{k % 3}", f"S{k % 6}", (k * 37 % 1000) / 1000.0, (k * 91 % 1000) / 1000.0, (k * 53 % 1000) / 1000.0) for k in range(900)]
    frame = spark.createDataFrame(points, "sku_id string, category string, subcategory string, log_list_price double, margin_rate double, price_rank double")
    near, written = {}, []
    real = C.cut
    C.cut = lambda df: written.append(real(df)) or written[-1]
    try:
        for r in C.nearest_donors(frame.filter("sku_id < 'P0020'"), frame, 5).collect():
            near.setdefault(r["sku_id"], []).append((round(r["distance"], 9), r["donor"]))
    finally:
        C.cut = real
    for t in points[:20]:
        best = sorted((round(sum((a - b) ** 2 for a, b in zip(t[3:], o[3:])) ** 0.5 + (o[2] != t[2]) + 4.0 * (o[1] != t[1]), 9), o[0]) for o in points if o[0] != t[0])
        assert sorted(near[t[0]]) == best[:5]
    kept = next(w for w in written if "_order" in w.columns)
    leaves = kept.agg(F.max(F.size("_order"))).first()[0]
    total = next(w for w in written if "_slices" in w.columns and "_n" in w.columns).count()
    assert leaves <= total / 2  # those farther than all of a leaf with enough donors are left out


def test_blackout_fallback_of_unknown_products_and_unserved_tables(spark):
    week = dt.date(2020, 1, 6)
    rows = [("A", "Decor", week, 4.0, 1.0), ("A", "Decor", week + dt.timedelta(7), 0.0, 0.0), (None, "Decor", week, 2.0, 1.0), ("B", "Decor", week, 8.0, 0.2)]
    schema = "sku_id string, category string, week_start date, units double, availability double"
    out = {(r["sku_id"], r["week_start"]): r["fallback"] for r in Z.blackout_fallback(spark.createDataFrame(rows, schema)).collect()}
    # Own served weeks first; a row without a product, or never served, takes the mean of all served weeks.
    assert out == {("A", week): 4.0, ("A", week + dt.timedelta(7)): 4.0, (None, week): 3.0, ("B", week): 3.0}
    none = Z.blackout_fallback(spark.createDataFrame([("A", "Decor", week, 4.0, 0.1)], schema)).first()
    assert none["fallback"] == 4.0


def test_audit_counts_one_frame_after_the_other(spark, monkeypatch):
    written = _Written()
    monkeypatch.setattr(A, "cut", written)
    trail = A.AuditTrail()
    for n in (3, 5):
        trail.add("t", "{n} rows", spark.range(n), F.count(F.lit(1)), "d", "r", "w")
    assert [r["rows_affected"] for r in trail.to_df(spark).collect()] == [3, 5] and written.rows == [1, 1]
