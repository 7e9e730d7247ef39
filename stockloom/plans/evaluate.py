"""Scoring supplied actuals, and stress scenarios on real holdouts (EVL-1, SCN-*, JN-3/4/9/10)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockloom.contracts import UNCLASSIFIED
from stockloom.functions import metrics as M
from stockloom.functions import scalar as S

FORECAST = ["sku_id", "target_week", "horizon", "prediction", "prediction_lower",
            "prediction_upper"]
SEASON_DAYS = 364
# Which source is believed first.
PRIORITY = {"forward_forecast": 1, "holdout": 2, "backtest": 3}


def prioritise_sources(forward: DataFrame | None = None, holdout: DataFrame | None = None,
                       backtest: DataFrame | None = None) -> DataFrame:
    """JN-9: one forecast per SKU and week, the most independent source first.

    Within a source the backtest's latest origin wins; a holdout or forward row is
    unique already, or its shortest horizon counts.
    """
    parts = []
    for name, frame in (("forward_forecast", forward), ("holdout", holdout),
                        ("backtest", backtest)):
        if frame is None:
            continue
        within = -F.datediff("week_start", F.lit("1970-01-01")) if (
            name == "backtest" and "week_start" in frame.columns
        ) else F.col("horizon").cast("int")
        parts.append(
            frame.select(
                *FORECAST, F.lit(name).alias("source"),
                F.struct(F.lit(PRIORITY[name]).alias("p"), within.alias("w")).alias("_o"),
            )
        )
    if not parts:
        raise ValueError("no forecasts to score against")
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    rest = [c for c in rows.columns if c not in ("sku_id", "target_week", "_o")]
    best = rows.groupBy("sku_id", "target_week").agg(F.min_by(F.struct(*rest), "_o").alias("_r"))
    return best.select("sku_id", "target_week", "_r.*")


def one_actual_per_week(actuals: DataFrame) -> DataFrame:
    """One observation per SKU and week, the last submitted one."""
    seq = "_row_seq" if "_row_seq" in actuals.columns else None
    rows = actuals.select(
        F.upper(F.trim("sku_id")).alias("sku_id"),
        S.week_start("week_starting").alias("target_week"),
        F.col("units").alias("actual"),
        (F.col(seq) if seq else F.struct("week_starting", "units")).alias("_seq"),
    )
    return rows.groupBy("sku_id", "target_week").agg(F.max_by("actual", "_seq").alias("actual"))


def match_actuals(actuals: DataFrame, forecasts: DataFrame) -> DataFrame:
    """JN-3."""
    return actuals.join(forecasts, ["sku_id", "target_week"])


def unmatched(actuals: DataFrame, forecasts: DataFrame, n: int = 8) -> DataFrame:
    """JN-4: actual rows without a forecast, the first ``n``."""
    rest = actuals.join(forecasts, ["sku_id", "target_week"], "left_anti")
    return rest.select("sku_id", "target_week").orderBy("sku_id", "target_week").limit(n)


def seasonal_baseline(matched: DataFrame, panel: DataFrame) -> DataFrame:
    """JN-10: demand of the same week a year before."""
    past = panel.select(
        "sku_id", F.date_add("week_start", SEASON_DAYS).alias("target_week"),
        F.col("units").alias("baseline"),
    )
    return matched.join(past, ["sku_id", "target_week"], "left")


def matched_rows(actuals: DataFrame, forecasts: DataFrame, panel: DataFrame,
                 master: DataFrame | None = None) -> DataFrame:
    out = seasonal_baseline(match_actuals(one_actual_per_week(actuals), forecasts), panel)
    if master is not None:
        out = out.join(master.select("sku_id", "category"), "sku_id", "left").fillna(
            UNCLASSIFIED, ["category"]
        )
    else:
        out = out.withColumn("category", F.lit("All"))
    return out.withColumnRenamed("prediction", "forecast")


def evaluation_summary(matched: DataFrame) -> DataFrame:
    """EVL-1: the headline record of the model and of the baseline on the same rows."""
    _, relative = M.bias("actual", "forecast")
    has = F.col("baseline").isNotNull()
    return matched.agg(
        F.count(F.lit(1)).alias("rows_matched"),
        M.wape("actual", "forecast").alias("wape"),
        relative.alias("bias_relative"),
        M.mae("actual", "forecast").alias("mae"),
        M.rmse("actual", "forecast").alias("rmse"),
        M.coverage("actual", "prediction_lower", "prediction_upper").alias("interval_coverage"),
        M.wape(F.when(has, F.col("actual")), "baseline").alias("baseline_wape"),
        F.avg(has.cast("double")).alias("baseline_coverage"),
    ).withColumn(
        "improvement",
        F.when(
            F.col("baseline_wape") > 0,
            F.try_divide(F.col("baseline_wape") - F.col("wape"), F.col("baseline_wape")),
        ),
    )


def evaluation_by(matched: DataFrame, key: str) -> DataFrame:
    """EVL-1 per horizon or category."""
    _, relative = M.bias("actual", "forecast")
    has = F.col("baseline").isNotNull()
    return matched.groupBy(F.col(key).cast("string").alias("key")).agg(
        F.count(F.lit(1)).alias("n_observations"),
        F.sum(F.abs("actual")).alias("total_actual"),
        M.wape("actual", "forecast").alias("wape"),
        M.wape(F.when(has, F.col("actual")), "baseline").alias("baseline_wape"),
        relative.alias("bias_relative"),
    )


def evaluate_actuals(actuals: DataFrame, panel: DataFrame, master: DataFrame | None = None,
                     forward: DataFrame | None = None, holdout: DataFrame | None = None,
                     backtest: DataFrame | None = None) -> dict[str, DataFrame]:
    """EVL-1: every table of an evaluation, each lazy."""
    from stockloom.operators.insights import error_contributors

    forecasts = prioritise_sources(forward, holdout, backtest)
    matched = matched_rows(actuals, forecasts, panel, master)
    return {
        "summary": evaluation_summary(matched),
        "by_horizon": evaluation_by(matched, "horizon"),
        "by_category": evaluation_by(matched, "category"),
        "sources": matched.groupBy("source").agg(F.count(F.lit(1)).alias("rows")),
        "contributors": error_contributors(matched),
        "unmatched": unmatched(one_actual_per_week(actuals), forecasts),
    }


# --------------------------------------------------------------------------- #
# Scenarios
# --------------------------------------------------------------------------- #
def _with_week_index(scored: DataFrame) -> DataFrame:
    """0-based index of each target week; the week list is one row per week."""
    weeks = scored.select("target_week").distinct()
    w = Window.orderBy("target_week")  # weeks of the holdout only
    numbered = weeks.select(
        "target_week",
        (F.row_number().over(w) - 1).alias("_wi"),
        F.count(F.lit(1)).over(Window.partitionBy()).alias("_wn"),
    )
    return scored.join(F.broadcast(numbered), "target_week")  # at most the holdout's weeks


def apply_shock(scored: DataFrame, up: str, down: str) -> DataFrame:
    """SCN-1: one category surges and another collapses from mid-period, ramped."""
    out = _with_week_index(scored)
    steps = F.greatest(F.col("_wi") - F.floor(F.col("_wn") / 2), F.lit(0))
    factor = (
        F.when(F.col("category") == up, 1.0 + F.least(F.lit(0.80), steps * F.lit(0.06)))
        .when(F.col("category") == down, 1.0 - F.least(F.lit(0.60), steps * F.lit(0.045)))
        .otherwise(F.lit(1.0))
    )
    return (
        out.withColumn("_f", factor)
        .withColumns(
            {"actual": F.rint(F.col("actual") * F.col("_f")), "touched": F.col("_f") != 1.0}
        )
        .drop("_f", "_wi", "_wn")
    )


def burst_weeks(n: int) -> list[int]:
    """Positions of four two-week bursts spread over ``n`` weeks."""
    low, high = 4, n - 6
    starts = [int(low + (high - low) * i / 3.0) for i in range(4)]
    return sorted({s + o for s in starts for o in (0, 1)})


def promoted(sku: str, seed: int) -> tuple[Column, Column]:
    """Whether a SKU joins the bursts (a third do) and its uplift, from a hash."""
    digest = F.xxhash64(F.col(sku), F.lit(seed))
    pick = F.pmod(digest, F.lit(3)) == 0
    lift = F.lit(2.0) + F.pmod(F.shiftright(digest, 8), F.lit(2501)) / F.lit(1000.0)
    return pick, lift


def apply_promo_bursts(scored: DataFrame, seed: int = 7, chosen=promoted,
                       weeks: int | None = None) -> DataFrame:
    """SCN-2: deep discounts on a third of the SKUs in four two-week bursts."""
    out = _with_week_index(scored)
    n = weeks if weeks is not None else scored.select("target_week").distinct().count()
    pick, lift = chosen("sku_id", seed)
    inside = F.col("_wi").isin(*burst_weeks(n))
    return (
        out.withColumn("_f", F.when(pick & inside, lift).otherwise(F.lit(1.0)))
        .withColumns(
            {"actual": F.rint(F.col("actual") * F.col("_f")), "touched": F.col("_f") != 1.0}
        )
        .drop("_f", "_wi", "_wn")
    )


def focus_score(scored: DataFrame, only_touched: bool = True) -> DataFrame:
    """SCN-3: the score of the rows a scenario touched (or of all rows)."""
    rows = scored.filter("touched") if only_touched else scored
    _, relative = M.bias("actual", "prediction")
    return rows.agg(
        F.count(F.lit(1)).alias("rows"),
        M.wape("actual", "prediction").alias("wape"),
        (F.lit(1.0) - M.wape("actual", "prediction")).alias("accuracy"),
        relative.alias("bias_relative"),
        M.coverage("actual", "prediction_lower", "prediction_upper").alias("interval_coverage"),
    )


def scenario_table(control: DataFrame, scenarios: dict[str, DataFrame]) -> DataFrame:
    """SCN-3: every scenario against the untouched control."""
    base = focus_score(control, only_touched=False).select(F.lit("steady").alias("scenario"), "*")
    out = base
    for name, frame in scenarios.items():
        for part, touched in ((name, False), (f"{name}_focus", True)):
            row = focus_score(frame, touched).select(F.lit(part).alias("scenario"), "*")
            out = out.unionByName(row)
    return out


def pick_categories(categories: Sequence[str]) -> tuple[str, str]:
    """The two categories of a shock: first and last in order."""
    ordered = sorted(categories)
    return ordered[0], ordered[-1]
