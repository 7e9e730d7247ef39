"""Rolling-origin backtest and chronological holdout (BT-*, GATE-2..4)."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stockloom.contracts import DEFAULTS, InsufficientHistoryError, Settings
from stockloom.functions import metrics as M
from stockloom.models.baseline import seasonal_naive, with_baselines
from stockloom.models.ensemble import validation_split
from stockloom.models.trees import Fitted, Prepared
from stockloom.operators import features as X
from stockloom.operators.lookup import union_all
from stockloom.session import cut
from stockloom.sources.shelf import Shelf, side_by_side

STALE_WEEKS = 13
ROWS = ["sku_id", "week_start", "target_week", "horizon", "category", "subcategory"]


def split_fold(supervised: DataFrame, origin) -> tuple[DataFrame, DataFrame]:
    """GATE-2: train on targets observed by the origin, test at the origin.

    Filtering training rows by their *origin* week would let targets from beyond
    the split into the training set.
    """
    train = supervised.filter(F.col("target_week") <= F.lit(origin))
    test = supervised.filter(F.col("week_start") == F.lit(origin))
    return train, test


def select_origins(weeks: Sequence, horizon: int, folds: int, step: int,
                   min_train: int) -> list:
    """GATE-3: evenly spaced origins, the last one ``horizon`` weeks before the end."""
    ordered = sorted(weeks)
    last = len(ordered) - 1 - horizon
    picks = [last - i * step for i in range(folds)]
    if last < 0 or picks[-1] < min_train:
        raise InsufficientHistoryError(
            f"the earliest origin would be week {picks[-1]}, the first {min_train} are reserved"
        )
    return [ordered[i] for i in reversed(picks)]


def backtest_origins(panel_weeks: Sequence, settings: Settings = DEFAULTS) -> list:
    """Origins over the labelled weeks: every panel week but the last has a label."""
    return select_origins(
        sorted(panel_weeks)[:-1], settings.horizon_weeks, settings.backtest_folds,
        settings.backtest_step_weeks, settings.min_train_weeks,
    )


def staleness_weeks(panel: DataFrame, trained_to) -> DataFrame:
    """GATE-4: whole weeks between the training cutoff and the latest panel week."""
    last = panel.agg(F.max("week_start").alias("last_week"))
    behind = F.floor(F.datediff("last_week", F.lit(trained_to)) / F.lit(7))
    return last.select(
        "last_week", behind.alias("weeks_behind"), (behind >= STALE_WEEKS).alias("stale")
    )


def model_free_frame(panel: DataFrame, week_dim: DataFrame, origins: Sequence,
                     horizons: Sequence[int]) -> DataFrame:
    """Test rows of every fold with both baselines, in one plan.

    Folds without a fit need no loop.  The panel is cut to the weeks the lags of the
    first origin can reach, so a long history is not windowed for six origins.
    """
    reach = min(origins) - dt.timedelta(weeks=X.SEASON_WEEKS)
    top = max(origins) + dt.timedelta(weeks=max(horizons))
    near = panel.filter(F.col("week_start").between(F.lit(reach), F.lit(top)))
    base = X.add_rolling(X.add_lags(near))
    rows = X.expand_horizons(base, horizons, labelled=True).filter(
        F.col("week_start").isin(*origins)
    )
    fold = F.lit(None).cast("int")
    for i, origin in enumerate(sorted(origins), start=1):
        fold = F.when(F.col("week_start") == F.lit(origin), i).otherwise(fold)
    return with_baselines(rows).withColumns({"fold": fold, "origin_week": F.col("week_start")})


KEY = ["sku_id", "week_start", "horizon"]


class Fold:
    """One origin of a backtest: its rows, one preprocessing, and a shelf for what is fitted on it."""

    def __init__(self, number: int, origin, supervised: DataFrame, shelf: Shelf, spec: X.FeatureSpec):
        self.number, self.origin, self.shelf, self.spec = number, origin, shelf, spec
        self.train, self.test = split_fold(supervised, origin)
        self._prepared: dict[str, Prepared] = {}

    def rows(self, part: str = "train") -> DataFrame:
        """The training rows, or (``early``) those before the validation weeks, or (``late``) these weeks."""
        return self.train if part == "train" else validation_split(self.train)[part == "late"]

    def prepared(self, part: str = "train") -> Prepared:
        """The preprocessing of ``rows(part)``, fitted when it is first asked for."""
        if part not in self._prepared:
            self._prepared[part] = Prepared(self.rows(part), self.spec)
        return self._prepared[part]

    def model(self, name: str, fit: Callable, part: str = "train") -> Fitted:
        """``fit(rows, prepared)`` on one part of the fold, or the same model from the shelf."""
        return self.shelf.model(f"models/{name}/{part}/fold={self.number}", lambda: fit(self.rows(part), self.prepared(part)), Fitted.load)


def backtest(supervised: DataFrame, candidates: dict[str, Callable], origins: Sequence, keep: Sequence[str] = (),
             shelf: Shelf | None = None, spec: X.FeatureSpec | None = None, at_once: int = 3) -> DataFrame:
    """BT-1: out-of-sample predictions of every candidate on identical rows.

    A candidate is ``fit(fold) -> object with predict(rows)``.  Folds run ``at_once`` side by side;
    the candidates of a fold share its preprocessing.  The scores of a (candidate, fold) are written
    to the shelf as soon as they are there, so a run that broke off, or one with one more candidate,
    fits only what is missing.  A candidate that does not score every test row is an error.
    """
    spark = supervised.sparkSession
    shelf, spec = shelf or Shelf.of(supervised), spec or X.feature_spec()

    def score(numbered: tuple[int, object]) -> None:
        fold = Fold(*numbered, supervised, shelf, spec)
        for name, fit in candidates.items():
            def scored(name: str = name, fit: Callable = fit) -> DataFrame:
                out = fit(fold).predict(fold.test)
                own = {"prediction": name, "prediction_lower": f"{name}_lower", "prediction_upper": f"{name}_upper"}
                picks = [F.col(a).alias(b) for a, b in own.items() if a in out.columns]
                picks += [F.col("regime").alias(f"{name}_regime")] if "regime" in out.columns else []
                return out.select(*KEY, *picks)

            shelf.table(f"scores/{name}/fold={fold.number}", scored)

    numbered = list(enumerate(sorted(origins), start=1))
    side_by_side(score, numbered, spark, at_once)
    parts = []
    for number, origin in numbered:
        rows = with_baselines(split_fold(supervised, origin)[1])
        extra = [c for c in keep if c not in (*ROWS, "y", "weeks_since_launch")]
        parts.append(rows.select(*ROWS, "y", "weeks_since_launch", *extra, "baseline", "naive", F.lit(number).alias("fold"), F.lit(origin).alias("origin_week")))
    out = union_all(parts)
    for name in candidates:
        scores = union_all([spark.read.parquet(shelf.path(f"scores/{name}/fold={n}")) for n, _ in numbered])
        out = out.join(scores, KEY, "left")
    out = cut(out)
    gaps = out.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in candidates]).first().asDict()
    if any(gaps.values()):
        raise ValueError("test rows without a score: " + ", ".join(f"{c} {n}" for c, n in gaps.items() if n))
    regimes = [f"{c}_regime" for c in candidates if f"{c}_regime" in out.columns]
    return out.withColumn("regime", F.coalesce(*regimes)).drop(*regimes) if regimes else out


# --------------------------------------------------------------------------- #
# FC-10
# --------------------------------------------------------------------------- #
def tune(supervised: DataFrame, candidates: dict[str, Callable], origins: Sequence, shelf: Shelf | None = None,
         at_once: int = 3) -> DataFrame:
    """FC-10: every candidate on the same rolling folds, best first.

    Folds are split by target week, never at random.  Beside the pooled WAPE, each candidate is
    compared with the winner fold by fold: the mean difference of their fold WAPEs and its
    standard error say whether the difference is more than the folds' own noise.
    """
    return rank_candidates(backtest(supervised, candidates, origins, shelf=shelf, at_once=at_once), list(candidates))


def rank_candidates(predictions: DataFrame, names: Sequence[str]) -> DataFrame:
    """(place, candidate, wape, bias_relative, folds, gap, gap_se, within_one_se) of scored folds."""
    _, relative = M.bias("y", "prediction")
    long = unpivot_models(predictions, names, ["fold"]).withColumnRenamed("model", "candidate")
    pooled = long.groupBy("candidate").agg(M.wape("y", "prediction").alias("wape"), relative.alias("bias_relative"))
    by_fold = long.groupBy("candidate", "fold").agg(M.wape("y", "prediction").alias("fold_wape"))
    best = pooled.agg(F.min_by("candidate", F.struct("wape", "candidate")).alias("best"))  # one row
    lead = by_fold.join(F.broadcast(best), F.col("candidate") == F.col("best")).select("fold", F.col("fold_wape").alias("best_wape"))
    paired = by_fold.join(lead, "fold").groupBy("candidate").agg(
        F.count(F.lit(1)).alias("folds"), F.avg(F.col("fold_wape") - F.col("best_wape")).alias("gap"),
        (F.stddev_samp(F.col("fold_wape") - F.col("best_wape")) / F.sqrt(F.count(F.lit(1)))).alias("gap_se"),
    )
    place = F.row_number().over(Window.orderBy("wape", "candidate"))  # one row for each candidate of a grid
    return pooled.join(paired, "candidate").select(
        place.alias("place"), "candidate", "wape", "bias_relative", "folds", "gap", "gap_se", (F.col("gap") <= F.coalesce("gap_se", F.lit(0.0))).alias("within_one_se"))


def unpivot_models(predictions: DataFrame, models: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Predictions as rows ``keep..., y, model, prediction``."""
    return predictions.select(*keep, "y", *models).unpivot(
        [*keep, "y"], list(models), "model", "prediction"
    )


def fold_table(predictions: DataFrame, models: Sequence[str]) -> DataFrame:
    """BT-2: WAPE and bias per fold and model."""
    long = unpivot_models(predictions, models, ["fold", "origin_week"])
    _, relative = M.bias("y", "prediction")
    return long.groupBy("fold", "origin_week", "model").agg(
        F.count(F.lit(1)).alias("test_rows"),
        M.wape("y", "prediction").alias("wape"),
        relative.alias("bias_relative"),
    )


def model_table(predictions: DataFrame, models: Sequence[str],
                notes: dict[str, str] | None = None) -> DataFrame:
    """BT-4: one row per model, plus rows for models not judged by WAPE."""
    long = unpivot_models(predictions, models, [])
    _, relative = M.bias("y", "prediction")
    table = long.groupBy("model").agg(
        M.wape("y", "prediction").alias("wape"),
        relative.alias("bias_relative"),
        F.count(F.lit(1)).alias("n_observations"),
    ).withColumn("note", F.lit(None).cast("string"))
    if notes:
        extra = predictions.sparkSession.createDataFrame(
            [(m, None, None, None, n) for m, n in notes.items()],
            "model string, wape double, bias_relative double, n_observations long, note string",
        )
        table = table.unionByName(extra)
    return table


def select_model(table: DataFrame, baseline: str = "baseline",
                 eligible: Sequence[str] | None = None) -> DataFrame:
    """BT-2: lowest finite WAPE ships, the baseline included; improvement over it."""
    rows = table.filter(F.col("model").isin(*eligible)) if eligible else table
    rows = rows.filter(F.col("wape").isNotNull())
    picked = rows.agg(
        F.min_by("model", F.struct("wape", "model")).alias("selected_model"),
        F.min("wape").alias("selected_wape"),
        F.max(F.when(F.col("model") == baseline, F.col("wape"))).alias("baseline_wape"),
    )
    return picked.withColumns(
        {
            "improvement": F.try_divide(
                F.col("baseline_wape") - F.col("selected_wape"), F.col("baseline_wape")
            ),
            "beats_baseline": F.col("selected_model") != baseline,
        }
    )


def breakdowns(predictions: DataFrame, models: Sequence[str], by: str) -> DataFrame:
    """BT-3: one row per group with every model's WAPE side by side."""
    return predictions.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_observations"),
        F.sum("y").alias("total_actual"),
        *[M.wape("y", m).alias(f"{m}_wape") for m in models],
    )


# --------------------------------------------------------------------------- #
# BT-5
# --------------------------------------------------------------------------- #
def holdout_split(weeks: Sequence, fraction: float = 0.3, settings: Settings = DEFAULTS):
    """Split week, holdout weeks and the origins that cover them once each."""
    if not 0.05 <= fraction <= 0.6:
        raise ValueError("the holdout fraction must lie between 0.05 and 0.6")
    ordered = sorted(weeks)
    split = int(round(len(ordered) * (1.0 - fraction)))
    if split < settings.min_train_weeks or len(ordered) - split < settings.horizon_weeks:
        raise InsufficientHistoryError("one side of the holdout split is too short")
    origins = ordered[split - 1 : len(ordered) - 1 : settings.horizon_weeks]
    return ordered[split - 1], ordered[split:], origins


def holdout_scored(forecast: DataFrame, panel: DataFrame, split_week) -> DataFrame:
    """Forecast and outcome side by side, one row per SKU and holdout week.

    The freshest origin that reaches a week is the earliest one after the previous
    block, so the smallest horizon wins.
    """
    ahead = forecast.filter(F.col("target_week") > F.lit(split_week))
    rest = [c for c in ahead.columns if c not in ("sku_id", "target_week")]
    one = ahead.groupBy("sku_id", "target_week").agg(
        F.min_by(F.struct(*rest), "origin_week").alias("_r")
    ).select("sku_id", "target_week", "_r.*")
    actual = panel.filter(F.col("week_start") > F.lit(split_week)).select(
        "sku_id", F.col("week_start").alias("target_week"), F.col("units").alias("actual")
    )
    scored = one.join(actual, ["sku_id", "target_week"])
    inside = F.col("actual").between(F.col("prediction_lower"), F.col("prediction_upper"))
    return scored.withColumns(
        {
            "baseline": seasonal_naive(),
            "error": F.col("prediction") - F.col("actual"),
            "abs_error": F.abs(F.col("prediction") - F.col("actual")),
            "within_interval": inside.cast("int"),
        }
    )


def holdout(panel: DataFrame, week_dim: DataFrame, weeks: Sequence, fit: Callable,
            fraction: float = 0.3, settings: Settings = DEFAULTS) -> DataFrame:
    """BT-5: train on the earliest weeks, forecast and score the most recent ones.

    All origins of the holdout are scored in one plan.
    """
    split_week, _, origins = holdout_split(weeks, fraction, settings)
    base = X.base_features(panel)
    train = X.supervised_frame(base, week_dim, settings.horizons).filter(
        F.col("target_week") <= F.lit(split_week)
    )
    model = fit(train)
    rows = X.inference_frame(base, week_dim, origins, settings.horizons, check=False)
    scored = model.predict(rows).withColumn("origin_week", F.col("week_start"))
    keep = [*ROWS, "origin_week", "prediction", "prediction_lower", "prediction_upper",
            "units_seasonal_lag", "units_roll_mean_4"]
    return holdout_scored(scored.select(*keep), panel, split_week).drop(
        "units_seasonal_lag", "units_roll_mean_4"
    )
