"""Publication in one step, tagged runs, the refresh, and the choice of the blend."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from registry.core import style
from registry.runs import _Level, clean_csv_folder
from stockloom.contracts import CLEAN, ContractError
from stockloom.operators import hierarchy as G
from stockloom.plans import refresh as RF
from stockloom.sources import store
from stockloom.sources.publish import Publication


def test_readers_see_whole_versions_only(spark, tmp_path):
    shop = Publication(spark, str(tmp_path))
    with pytest.raises(FileNotFoundError):
        shop.read("a")
    first = shop.stage()
    first.put("a", spark.range(3))
    assert shop.entries() == {}  # written, not published
    assert first.publish("x") == 1 and shop.read("a").count() == 3
    broken = shop.stage()
    broken.put("a", spark.range(9))
    with pytest.raises(ContractError, match="not unique"):
        row = ("p", "c", "s", dt.date(2020, 1, 1), 1.0, 2.0)
        broken.put("m", spark.createDataFrame([row, row], "sku_id string, category string, subcategory string, launch_date date, unit_cost double, list_price double"), CLEAN["sku_master"])
    assert shop.read("a").count() == 3  # the failed run left nothing that a reader finds
    second = shop.stage()
    second.reuse(shop.entries())
    second.put("b", spark.range(1))
    assert second.publish("y") == 2
    assert {n: e["rows"] for n, e in shop.entries().items()} == {"a": 3, "b": 1}
    assert set(shop.entries(1)) == {"a"} and shop.entries()["a"]["path"] == shop.entries(1)["a"]["path"]
    assert shop.read("a", 1).count() == 3


def test_a_rerun_replaces_its_own_tag(spark, tmp_path):
    rows = spark.range(10).withColumn("wape", F.lit(0.5))
    for tag, of in (("plain", rows), ("drivers", rows), ("plain", rows.where("id < 4")), ("empty", rows), ("empty", rows.where("false"))):
        store.write_backtest({"metrics": of, "feature_importance": None}, str(tmp_path), tag)
    assert {r["run_tag"]: r["count"] for r in store.read_run(spark, str(tmp_path), "metrics").groupBy("run_tag").count().collect()} == {"plain": 4, "drivers": 10}
    assert store.read_run(spark, str(tmp_path), "metrics", "plain").columns == ["id", "wape"]
    assert store.read_run(spark, str(tmp_path), "metrics", "empty").count() == 0
    store.write_plan(rows, rows, rows, str(tmp_path / "plan"), "week1")
    store.write_plan(rows.limit(1), rows, rows, str(tmp_path / "plan"), "week2")
    assert store.read_run(spark, str(tmp_path / "plan"), "forecast").groupBy("run_tag").count().count() == 2
    for bad in ("2024", "a/b", ""):
        with pytest.raises(ValueError, match="run tag"):
            store.write_run({"metrics": rows}, str(tmp_path), bad)
    with pytest.raises(ValueError, match="not an artifact"):
        store.write_backtest({"forecast": rows}, str(tmp_path), "plain")


class Saved(_Level):
    trained_to = dt.date(2001, 1, 1)

    def save(self, path):
        from pyspark.sql import SparkSession

        SparkSession.active().range(1).write.parquet(path)


def test_refresh_publishes_and_reuses(spark, tmp_path):
    R = style(spark, "/root/testdata/sf0.001")
    folder, out = clean_csv_folder(R), str(tmp_path / "out")
    with pytest.raises(ValueError, match="no trained model"):
        RF.refresh(spark, folder, out)
    assert Publication(spark, out).entries() == {}
    seen = []

    def fit(supervised, panel):
        seen.append((supervised.limit(1).count(), panel.limit(1).count()))
        return Saved()

    first = RF.refresh(spark, folder, out, fit=fit)
    loaded = []
    RF.refresh(spark, folder, out, load=lambda s, path: loaded.append(path) or Saved())
    one, two = first.entries(1), first.entries(2)
    assert seen == [(1, 1)] and loaded == [one["model"]["path"]]
    assert {n for n in one if one[n]["path"] == two[n]["path"]} >= {"weekly_panel", "sku_master_clean", "sales_clean", "analysis_ready", "cleaning_report", "model"}
    assert all(one[n]["path"] != two[n]["path"] for n in ("forecast", "risk_table", "impact", "report"))
    forecast = first.read("forecast")
    assert {"regime", "model"} <= set(forecast.columns) and forecast.where("regime is null").count() == 0
    said = {(r["section"], r["item"]): r["value"] for r in first.read("report").collect()}
    assert int(said["impact", "total_skus"]) == first.read("risk_table").count() and ("model", "weeks_behind") in said
    panel = first.read("weekly_panel")
    shared = [c for c in panel.columns if c in R.panel.columns]
    assert len(shared) >= 10 and panel.select(shared).exceptAll(R.panel.select(shared)).count() == 0 and panel.count() == R.panel.count()


def test_blend_choice_is_the_one_standard_error_rule(spark):
    advantage = lambda x: spark.createDataFrame([(x,)], "advantage double")

    def choose(rows, gain=0.1):
        return G.choose_blend(spark.createDataFrame(rows, "`lambda` double, wape double, standard_error double"), advantage(gain)).first().asDict()

    rows = [(0.0, 0.30, 0.0), (0.1, 0.29, 0.01), (0.5, 0.25, 0.02), (0.8, 0.24, 0.015), (1.0, 0.26, 0.02)]
    got = choose(rows)
    assert got["best_lambda"] == 0.8 and got["strength"] == 0.5 and got["wape"] == 0.25 and got["gate"] == "passed"
    assert got["tolerance"] == pytest.approx(0.255) and got["base_wape"] == 0.30
    assert choose(rows, -0.1)["strength"] == 0.0 and choose(rows, 0.0)["gate"] == "declined"
    assert choose(rows, None)["strength"] == 0.5
    assert choose([(0.0, 0.2, 0.0), (1.0, 0.3, 0.5)])["strength"] == 0.0
    assert choose([(0.0, None, 0.0), (1.0, None, 0.0)])["strength"] == 0.0


def test_correlation_by_gram_is_the_pairwise_sum(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(6, 40)) + rng.normal(size=40)
    day = dt.date(2020, 1, 6)
    rows = [(f"CAT::{i}", day + dt.timedelta(weeks=t // 2), t % 2 + 1, float(x[i, t])) for i in range(6) for t in range(40)]
    residuals = spark.createDataFrame(rows, "node string, week_start date, horizon int, residual double").withColumns({"actual": F.col("residual"), "prediction": F.lit(0.0)})
    scales = spark.createDataFrame([(f"CAT::{i}", "category", h, 20, 1.0) for i in range(6) for h in (1, 2)], "node string, level string, horizon int, observations long, scale double")
    got = G.shrunk_correlation(residuals, scales).first()
    z = (x - x.mean(1, keepdims=True)) / x.std(1, ddof=1, keepdims=True)
    t = 40
    num = den = 0.0
    for i in range(6):
        for j in range(6):
            if i != j:
                w = z[i] * z[j]
                den += (w.sum() / (t - 1)) ** 2
                num += t / (t - 1) ** 3 * ((w - w.mean()) ** 2).sum()
    assert got["nodes"] == 6 and got["observations"] == 40 and got["intensity"] == pytest.approx(min(max(num / den, 0), 1))
    assert G.shrunk_correlation(residuals.where("false"), scales.where("false")).first()["intensity"] == 1.0
