"""No row is lost and no size is refused: pooled lookups, uploads, error correlation, streams' batch forms."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from stockloom.models.conformal import apply_conformal
from stockloom.models.trees import residual_interval
from stockloom.operators.hierarchy import LEAST_SCALE, shrunk_correlation
from stockloom.operators.lookup import lookup_pooled
from stockloom.sources.uploads import combine_uploads
from stockloom.streaming.live import accuracy_windows, latest_positions


def test_lookups_without_a_pooled_row_keep_every_row(spark):
    df = spark.createDataFrame([("a", 10.0, 8.0, 12.0), ("b", 20.0, 15.0, 22.0)], "regime string, ensemble double, ensemble_lower double, ensemble_upper double")
    coefs = spark.createDataFrame([("a", 2.0)], "regime string, scale double")
    got = {r["regime"]: r["scale"] for r in lookup_pooled(df, coefs, "regime", ["scale"]).collect()}
    assert got == {"a": 2.0, "b": None}
    out = apply_conformal(df, coefs.filter("false")).orderBy("regime").collect()
    assert [(r["recalibrated_lower"], r["recalibrated_upper"]) for r in out] == [(8.0, 12.0), (16.5, 23.5)]
    rows = df.withColumnRenamed("ensemble", "prediction").withColumn("horizon", F.lit(1))
    empty = spark.createDataFrame([], "cell string, low double, high double")
    assert residual_interval(rows, empty, ["regime", "horizon"]).count() == 2


def test_the_last_row_of_the_last_file_wins_by_number(spark):
    rows = [(f"s{k}", "2020-01-06", float(n), n) for k in (1, 2) for n in range(1, 13)]
    first = spark.createDataFrame(rows, "sku string, week string, units double, _row_seq long")
    second = spark.createDataFrame([("s2", "2020-01-06", 100.0 + n, (0, n)) for n in range(9, 13)], "sku string, week string, units double, _row_seq struct<file:int,row:long>")
    third = spark.createDataFrame([("s3", "2020-01-06", v) for v in (9.0, 3.0)], "sku string, week string, units double").coalesce(1)
    got, forecast = combine_uploads([first, second, third])
    assert {r["sku_id"]: r["units"] for r in got.collect()} == {"S1": 12.0, "S2": 112.0, "S3": 3.0} and forecast is None


def test_correlation_of_many_nodes_is_the_pairwise_sum(spark):
    rng = np.random.default_rng(0)
    nodes, weeks = 430, 40
    common = rng.normal(size=weeks)
    x = rng.normal(size=(nodes, weeks)) + 0.5 * common
    start = dt.date(2020, 1, 6)
    residuals = spark.createDataFrame([(f"n{i}", start + dt.timedelta(days=7 * t), 1, float(x[i, t])) for i in range(nodes) for t in range(weeks)],
                                      "node string, week_start date, horizon int, residual double")
    scales = spark.createDataFrame([(f"n{i}", "category", 1, weeks, 1.0) for i in range(nodes)], "node string, level string, horizon int, observations long, scale double")
    got = shrunk_correlation(residuals, scales).first()
    z = (x - x.mean(axis=1, keepdims=True)) / np.maximum(x.std(axis=1, ddof=1, keepdims=True), LEAST_SCALE)
    c, q = z @ z.T, (z**2) @ (z**2).T
    off = ~np.eye(nodes, dtype=bool)
    variance = (weeks / (weeks - 1) ** 3 * (q - c**2 / weeks))[off].sum()
    want = min(1.0, max(0.0, variance / ((c / (weeks - 1)) ** 2)[off].sum()))
    assert got["nodes"] == nodes and got["observations"] == weeks and abs(got["intensity"] - want) < 1e-9


def test_restated_and_repeated_events_count_once(spark):
    at = lambda d, h: dt.datetime(2020, 1, d, h)
    actuals = spark.createDataFrame([("a", 5.0, at(7, 1)), ("a", 8.0, at(8, 1)), ("a", 8.0, at(8, 1)), ("b", 2.0, at(9, 1))], "sku_id string, units double, event_time timestamp")
    forecast = spark.createDataFrame([(s, dt.date(2020, 1, 6), "c", 6.0, 1.0, 9.0) for s in "ab"],
                                     "sku_id string, target_week date, category string, prediction double, prediction_lower double, prediction_upper double")
    (row,) = accuracy_windows(actuals, forecast).collect()
    assert (row["rows"], row["coverage"], round(row["wape"], 6)) == (2, 1.0, 0.6)
    events = spark.createDataFrame([("a", 1, 3.0, at(9, 1)), ("a", 2, 4.0, at(8, 1)), ("a", 1, 3.0, at(9, 1))], "sku_id string, event_id long, on_hand_units double, event_time timestamp")
    assert [r["on_hand_units"] for r in latest_positions(events).collect()] == [3.0]
