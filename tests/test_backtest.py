"""Shelves, shared folds, ranking of candidates, saved models, quantile leaves, the ensemble without a validation window."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stockloom.models import bands as BD
from stockloom.models import ensemble as E
from stockloom.models import trees as T
from stockloom.operators.features import FeatureSpec
from stockloom.plans import backtest as B
from stockloom.sources.shelf import Shelf, side_by_side

DAY = dt.date(2020, 1, 6)
SPEC = FeatureSpec(("level", "horizon", "gappy", "void"), ("category",))


@pytest.fixture(scope="module")
def supervised(spark):
    rng = np.random.default_rng(7)
    rows = []
    for sku in range(8):
        level = 5.0 + 4.0 * sku
        for week in range(60):
            for h in (1, 2):
                rows.append((f"s{sku}", DAY + dt.timedelta(weeks=week), DAY + dt.timedelta(weeks=week + h), h, "ab"[sku % 2], "x", 100, level,
                             None if week % 3 else level, float(max(0.0, level + rng.normal() * level * 0.3)), level, level, level))
    names = ["sku_id", "week_start", "target_week", "horizon", "category", "subcategory", "weeks_since_launch", "level", "gappy", "y",
             "units_seasonal_lag", "units_roll_mean_4", "units_lag_0"]
    return spark.createDataFrame(pd.DataFrame(rows, columns=names)).withColumns(
        {"void": F.lit(None).cast("double"), "gappy": F.when(~F.isnan("gappy"), F.col("gappy")), "horizon": F.col("horizon").cast("int")})


ORIGINS = [DAY + dt.timedelta(weeks=w) for w in (40, 44, 48)]


class Constant:
    def __init__(self, value, rows=None):
        self.value, self.rows = value, rows

    def predict(self, df):
        out = df.withColumn("prediction", F.lit(float(self.value)))
        return out.where(self.rows) if self.rows else out


def test_shelf_goes_on_where_it_stopped(spark, tmp_path):
    shelf, made = Shelf(spark, str(tmp_path)), []

    def make():
        made.append(1)
        return spark.range(3)

    assert shelf.table("t", make).count() == shelf.table("t", make).count() == 3 and len(made) == 1
    spark.range(9).write.parquet(shelf.path("broken"))
    (tmp_path / "broken" / "_SUCCESS").unlink()  # as a run that ended in the middle leaves it
    assert shelf.table("broken", make).count() == 3 and len(made) == 2
    one, same, other = spark.range(5), spark.range(5).orderBy(F.desc("id")), spark.range(6)
    assert Shelf.of(one).folder == Shelf.of(same).folder != Shelf.of(other).folder
    assert side_by_side(lambda n: spark.range(n).count(), [3, 1, 2], spark) == [3, 1, 2]


def test_backtest_scores_identical_rows_and_resumes(spark, supervised, tmp_path):
    calls = []

    def constant(value):
        def fit(fold):
            calls.append((value, fold.number))
            assert fold.train.agg(F.max("target_week")).first()[0] <= fold.origin
            return Constant(value)

        return fit

    shelf = Shelf(spark, str(tmp_path))
    first = B.backtest(supervised, {"one": constant(1)}, ORIGINS, shelf=shelf, spec=SPEC)
    assert first.count() == 3 * 8 * 2 and first.select("fold", "origin_week").distinct().count() == 3
    both = B.backtest(supervised, {"one": constant(1), "two": constant(2)}, ORIGINS, shelf=shelf, spec=SPEC)
    assert sorted(calls) == [(v, n) for v in (1, 2) for n in (1, 2, 3)]
    assert both.agg(F.sum("one"), F.sum("two")).first()[:] == (48.0, 96.0)
    with pytest.raises(ValueError, match="short 24"):
        B.backtest(supervised, {"short": lambda fold: Constant(1, "horizon = 1")}, ORIGINS, shelf=shelf, spec=SPEC)


def test_candidates_are_ranked_with_paired_folds(spark, supervised, tmp_path):
    fits = {f"c{v}": (lambda v: lambda fold: Constant(v))(v) for v in (0, 10, 18, 19, 40)}
    got = {r["candidate"]: r for r in B.tune(supervised, fits, ORIGINS, shelf=Shelf(spark, str(tmp_path))).collect()}
    rows = supervised.where(F.col("week_start").isin(ORIGINS)).select("week_start", "y").toPandas()
    wape = {v: rows.groupby("week_start")["y"].apply(lambda y: (y - v).abs().sum() / y.abs().sum()) for v in (0, 10, 18, 19, 40)}
    pooled = {v: (rows["y"] - v).abs().sum() / rows["y"].sum() for v in wape}
    order = sorted(pooled, key=pooled.get)
    for place, v in enumerate(order, start=1):
        r, gap = got[f"c{v}"], wape[v] - wape[order[0]]
        assert r["place"] == place and r["folds"] == 3
        assert r["wape"] == pytest.approx(pooled[v]) and r["gap"] == pytest.approx(gap.mean(), abs=1e-12)
        assert r["gap_se"] == pytest.approx(gap.std(ddof=1) / np.sqrt(3), abs=1e-12)
        assert r["within_one_se"] == (r["gap"] <= r["gap_se"])


def test_saved_model_serves_by_its_own_contract(spark, supervised, tmp_path):
    train = supervised.where(F.col("target_week") <= F.lit(ORIGINS[0]))
    for fit in (lambda: T.fit_trees(train, SPEC, {"maxIter": 2, "maxDepth": 2}), lambda: T.fit_linear(train, SPEC)):
        fitted = fit()
        fitted.save(str(tmp_path / "m"))
        back = T.Fitted.load(spark, str(tmp_path / "m"))
        assert back.spec == fitted.spec and back.trained_to == ORIGINS[0]
        assert "void" not in back.spec.numeric  # no value, no median
        test = supervised.where(F.col("week_start") == F.lit(ORIGINS[1]))
        a, b = (m.predict(test).orderBy("sku_id", "horizon").toPandas() for m in (fitted, back))
        assert a.equals(b) and (a["prediction"] >= 0).all() and list(a.columns) == [*test.columns, "prediction"]
        with pytest.raises(ValueError, match="missing feature column.*: level"):
            back.predict(test.drop("level"))
        with pytest.raises(ValueError, match="not numbers: gappy"):
            back.predict(test.withColumn("gappy", F.lit("1")))


def test_one_preprocessing_serves_trees_and_lines(spark, supervised):
    prepared = T.Prepared(supervised, SPEC)
    trees, lines = prepared.vectors(supervised).first()["features"], prepared.vectors(supervised, one_hot=True).first()["features"]
    assert trees.size == 3 + 1 + 1  # three numbers, one flag for the gappy one, one category number
    assert lines.size == 3 + 2


def test_quantile_leaves_hold_what_they_promise(spark):
    rng = np.random.default_rng(1)

    def rows(n):
        size = rng.uniform(1, 50, n)
        return spark.createDataFrame(pd.DataFrame({"category": "a", "level": size, "horizon": 1.0, "regime": "steady", "prediction": size,
                                                   "y": np.maximum(size + rng.normal(size=n) * size * 0.4, 0)}))

    spec = FeatureSpec(("level", "horizon"), ("category",))
    held, test = rows(6000), rows(4000)
    leaves = BD.fit_bands(held, T.Prepared(held, spec)).interval(test).toPandas()
    flat = T.residual_interval(test, T.residual_quantiles(held, ["regime", "horizon"]), ["regime", "horizon"]).toPandas()

    def pinball(t):
        return sum(np.maximum(q * (t["y"] - t[c]), (q - 1) * (t["y"] - t[c])).mean() for q, c in ((0.1, "prediction_lower"), (0.9, "prediction_upper")))

    inside = ((leaves["y"] >= leaves["prediction_lower"]) & (leaves["y"] <= leaves["prediction_upper"])).mean()
    assert abs(inside - 0.8) <= 0.03 and pinball(leaves) < pinball(flat)
    assert (leaves["prediction_lower"] <= leaves["prediction"]).all() and (leaves["prediction"] <= leaves["prediction_upper"]).all()
    assert (leaves["prediction_lower"] >= 0).all()
    none = BD.LeafBands([], None, [{}])
    assert none.table == [{}]


def test_ensemble_without_a_validation_window_is_its_point_model(spark, supervised):
    short = supervised.where("week_start < '2020-02-24'").withColumns(
        {"zero_frac_26": F.lit(0.0), "cv_13": F.lit(0.1), "units_roll_mean_13": F.col("level")})
    panel = short.where("horizon = 1").select("sku_id", "week_start", F.col("y").alias("units"))
    model = E.fit_ensemble(short, panel, lambda rows: Constant(7))
    out = model.predict(short).select("prediction", "prediction_lower", "prediction_upper").toPandas()
    assert (out["prediction"] == 7).all() and model.scale == 1.0 and model.weights.count() == 0
    assert (out["prediction_lower"] <= 7).all() and (out["prediction_upper"] >= 7).all()
    with pytest.raises(Exception, match="no training rows"):
        E.fit_ensemble(short.where("false"), panel, lambda rows: Constant(7))
