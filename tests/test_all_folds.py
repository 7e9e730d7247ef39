"""The fitted-model queries cover every backtest origin; stand-ins for the fits keep this short."""

import pytest
from pyspark.sql import functions as F

from registry import models
from registry.core import style
from stockloom.models import bands as BD
from stockloom.models import trees as T
from stockloom.plans import backtest as B
from stockloom.sources.shelf import Shelf

SF = "/root/testdata/sf0.001"


class Level:
    def predict(self, rows):
        return rows.withColumn("prediction", F.coalesce("units_roll_mean_4", F.lit(0.0)))


class Width:
    def interval(self, rows):
        return rows.withColumns({"prediction_lower": F.col("prediction") * 0.5, "prediction_upper": F.col("prediction") * 2})


@pytest.fixture(scope="module")
def bt(spark):
    return models.Backtest(style(spark, SF))


@pytest.fixture
def fits(monkeypatch, spark, tmp_path, bt):
    seen = []

    def model(self, name, fit, part="train"):
        seen.append((self.number, name, part))
        return Level()

    bt.shelf = Shelf(spark, str(tmp_path / "shelf"))
    monkeypatch.setattr(models, "Backtest", lambda R: bt)
    monkeypatch.setattr(B.Fold, "model", model)
    monkeypatch.setattr(B.Fold, "prepared", lambda self, part="train": None)
    monkeypatch.setattr(BD, "fit_bands", lambda *a, **k: Width())
    monkeypatch.setattr(T, "feature_importance", lambda fitted, spark: spark.createDataFrame([("f", 1.0)], "feature string, importance double"))
    return seen


@pytest.fixture(scope="module")
def tested(bt):
    assert len(bt.origins) == 6
    return bt.origins, bt.rows.where(F.col("week_start").isin(bt.origins)).count()


def test_gbt_forecast_has_every_origin(spark, fits, tested):
    out = models.gbt_forecast(spark, SF).select("week_start", "prediction", "prediction_lower", "prediction_upper").collect()
    assert sorted({r[0] for r in out}) == tested[0] and len(out) == tested[1]
    assert all(0 <= r[2] <= r[1] <= r[3] for r in out)
    assert sorted(fits) == [(n, "trees", "early") for n in range(1, 7)]


def test_feature_importance_has_every_origin(spark, fits, tested):
    assert sorted(r["origin_week"] for r in models.feature_importance(spark, SF).collect()) == tested[0]
    assert sorted(fits) == [(n, "trees", "train") for n in range(1, 7)]


def test_benchmark_scores_every_origin(spark, fits, tested):
    out = models.benchmark_models(spark, SF).collect()
    assert {r["model"] for r in out} == {"linear_regression", "random_forest", "squared_trees", "damped_smoothing"}
    assert {r["n_observations"] for r in out} == {tested[1]}
    assert {(n, part) for n, _, part in fits} == {(n, "train") for n in range(1, 7)} and len(fits) == 18


def test_ensemble_scores_every_origin(spark, fits, tested):
    out = models.ensemble_backtest(spark, SF).collect()
    assert {r["model"] for r in out} == {"baseline", "naive", "trees", "ensemble"} and {r["n_observations"] for r in out} == {tested[1]}
    assert sorted(set(fits)) == [(n, "trees", part) for n in range(1, 7) for part in ("early", "train")]
