import datetime as dt

from pyspark.sql import functions as F

from stockloom.operators import cleaning as K
from stockloom.operators import panel as P
from stockloom.operators.audit import AuditTrail
from stockloom.sources import extracts, uploads
import pytest

from stockloom.contracts import DataQualityError

D = dt.date


def master(spark):
    return spark.createDataFrame(
        [("A", "Lighting", "Lamps", D(2020, 1, 1), 6.0, 10.0), ("B", "Decor", "Vases", D(2020, 1, 8), 3.0, 5.0)],
        "sku_id string, category string, subcategory string, launch_date date, unit_cost double, list_price double",
    )


def raw_sales(spark, rows):
    names = ["date", "sku_id", "units_sold", "revenue", "unit_price", "promo_flag"]
    schema = ", ".join(f"{n} string" for n in names) + ", _row_seq int"
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], schema)


def test_sales_steps(spark):
    rows = [
        ("2020-01-06", "a", "2", "20", "10", "1"),
        ("2020-01-06", "a", "2", "20", "10", "1"),        # exact duplicate
        ("06-01-2020", " A ", "2", "20", "10", "TRUE"),   # same sale, other spelling
        ("2020-01-06", "A", "1", "9", "9", "0"),          # key collision, summed
        ("2020-01-07", "A", "-3", "-30", "10", "N"),      # refund
        ("2020-01-08", "A", "4", "48", None, "Y"),        # price from revenue
        ("2020-01-09", "A", "0", None, "0", "no"),        # price from the SKU median
        ("2020-01-09", "B", "2", None, None, "no"),       # price from the list
        ("2020-01-09", "GHOST", "1", "1", "1", "1"),      # unknown product
        ("soon", "A", "1", "1", "1", "1"),                # no date
    ]
    trail = AuditTrail()
    out = K.clean_sales(raw_sales(spark, rows), master(spark), trail)
    got = {(str(r["date"]), r["sku_id"]): r for r in out.collect()}
    assert len(got) == 5
    first = got[("2020-01-06", "A")]
    assert (first["units_sold"], first["revenue"], first["unit_price"], first["promo_flag"]) == (3.0, 29.0, 9.5, 1)
    assert got[("2020-01-07", "A")]["units_sold"] == 0.0 and got[("2020-01-07", "A")]["revenue"] == 0.0
    assert got[("2020-01-08", "A")]["unit_price"] == 12.0
    assert got[("2020-01-09", "A")]["unit_price"] == 10.0
    assert got[("2020-01-09", "B")]["revenue"] == 10.0
    notes = {r["detection"]: r["rows_affected"] for r in trail.to_df(spark).collect()}
    assert notes["units_sold < 0"] == 1
    assert notes["null after parsing"] == 1
    assert notes["anti-join against the master"] == 1


def test_inventory_carry_and_lead_time(spark):
    rows = [
        ("2020-01-06", "A", None, "1", "7", "1", 0),
        ("2020-01-13", "A", "5", None, "900", "1", 1),
        ("2020-02-10", "A", None, "1", "9", "1", 2),
        ("2020-02-10", "A", "-4", "1", "9", "1", 3),
        ("2020-01-06", "B", "3", "1", "0", "1", 4),
    ]
    raw = spark.createDataFrame(
        rows, "date string, sku_id string, on_hand_units string, on_order_units string, lead_time_days string, reorder_point string, _row_seq int",
    )
    out = K.clean_inventory(raw, master(spark))
    got = {(str(r["date"]), r["sku_id"]): (r["on_hand_units"], r["lead_time_days"]) for r in out.collect()}
    assert got == {
        ("2020-01-06", "A"): (0.0, 7.0),
        ("2020-01-13", "A"): (5.0, 9.0),
        ("2020-02-10", "A"): (0.0, 9.0),
        ("2020-01-06", "B"): (3.0, 9.0),
    }


def test_carry_crosses_months(spark):
    rows = [("2020-01-06", "5", 0), ("2020-02-03", None, 1), ("2020-04-06", None, 2)]
    raw = spark.createDataFrame(rows, "d string, on_hand_units string, _row_seq int").select(
        F.to_date("d").alias("date"), F.lit("A").alias("sku_id"),
        F.col("on_hand_units").cast("double").alias("on_hand_units"), F.lit(0.0).alias("on_order_units"),
        F.lit(0.0).alias("reorder_point"), "_row_seq",
    )
    assert [r["on_hand_units"] for r in K.fill_on_hand(raw).collect()] == [5.0, 5.0, 5.0]


def test_weekly_panel_equals_the_daily_route(spark):
    sales = spark.createDataFrame(
        [(D(2020, 1, 6), "A", 2.0, 20.0, 10.0, 1), (D(2020, 1, 9), "A", 1.0, 8.0, 8.0, 0),
         (D(2020, 1, 22), "A", 1.0, 7.0, 7.0, 0), (D(2020, 1, 26), "A", 1.0, 7.5, 7.5, 1)],
        "date date, sku_id string, units_sold double, revenue double, unit_price double, promo_flag int",
    )
    days = spark.range(40).select(F.date_add(F.lit(D(2020, 1, 6)), F.col("id").cast("int")).alias("date"))
    raw = days.select(
        F.col("date").cast("string").alias("date"), F.lit("Yes").alias("is_holiday"), F.lit(None).cast("string").alias("promo_event"),
        F.lit("").alias("week"), F.lit("").alias("month"), F.lit("").alias("season"),
    )
    calendar = K.clean_calendar(raw)
    span = P.date_span(sales)
    fast = P.weekly_panel(sales, master(spark), P.weekly_calendar(calendar), span)
    slow = P.weekly_from_daily(P.attach_dimensions(P.daily_grid(sales, master(spark), span), calendar)).select(*P.PANEL)
    a = sorted(map(tuple, fast.collect()))
    b = sorted(map(tuple, slow.collect()))
    assert len(a) == 5  # A: 3 weeks; B launches in week one, so two full weeks
    for x, y in zip(a, b):
        assert x[:4] == y[:4] and abs(x[4] - y[4]) < 1e-9 and x[5:] == y[5:]
    assert {r["avg_price"] for r in fast.filter("sku_id = 'B'").collect()} == {5.0}


def test_headers(spark):
    assert uploads.resolve_headers(["Qty Sold", "Week Commencing", "Item-Code"]) == {
        "sku_id": "Item-Code", "week_starting": "Week Commencing", "units": "Qty Sold",
    }
    assert uploads.classify_table(["sku", "YHat"]) == "forecast"
    with pytest.raises(DataQualityError):
        uploads.resolve_headers(["a", "b"])


def test_extract_reading(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b\n one,NA\n two,-\nthree,4\n")
    rows = extracts.read_text(spark, str(tmp_path / "x.csv")).orderBy("_row_seq").collect()
    assert [(r["a"], r["b"]) for r in rows] == [(" one", None), (" two", None), ("three", "4")]
    with pytest.raises(extracts.MissingFileError):
        extracts.load_extracts(spark, str(tmp_path))
    assert set(extracts.load_optional(spark, str(tmp_path)).values()) == {None}
