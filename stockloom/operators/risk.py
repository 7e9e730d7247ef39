"""Stockout and overstock risk with the money at stake (RSK-*).

Everything is row arithmetic after one aggregation of the forecast per SKU and one
join with the stock position, so the whole table is a single shuffle on ``sku_id``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockloom.contracts import ACTION_LABELS, ACTION_RATIONALE, DEFAULTS, Settings
from stockloom.functions import scalar as S
from stockloom.operators.lookup import latest_position
from stockloom.operators.ranking import ordered

# Thresholds of the risk layer.
TINY = 1e-9
LOW_CONFIDENCE_WEEKS = 26
LOW_CONFIDENCE_CV = 1.0
VOLATILE_CV = 0.75
LEAST_WEEKLY_DEMAND = 0.5
NO_DEMAND_COVER = 999.0


def week_sigma(forecast: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """RSK-1: weekly standard deviation recovered from the interval width."""
    width = S.clip(F.col("prediction_upper") - F.col("prediction_lower"), low=0.0)
    return forecast.withColumn("week_sigma", width / F.lit(2.0 * settings.coverage_z))


def lead_weights(forecast: DataFrame, position: DataFrame) -> DataFrame:
    """RSK-2: share of each forecast week that falls inside the lead time."""
    lead = position.select(
        "sku_id", F.greatest(F.col("lead_time_days") / 7.0, F.lit(0.1)).alias("_lead")
    )
    weighted = forecast.join(lead, "sku_id", "left")
    return weighted.withColumn(
        "lead_weight", S.clip(F.col("_lead") - (F.col("horizon") - 1), 0.0, 1.0)
    )


def lead_time_summary(weighted: DataFrame, extend: bool = False) -> DataFrame:
    """RSK-3: lead-time demand and spread, horizon demand, mean weekly spread.

    Lead times beyond the forecast horizon are truncated, as published.  With
    ``extend`` the weeks beyond it are filled with the mean weekly rate.
    """
    w = F.col("lead_weight")
    out = weighted.groupBy("sku_id").agg(
        F.sum(F.col("prediction") * w).alias("lead_time_demand"),
        F.sqrt(F.sum(F.pow(F.col("week_sigma") * w, F.lit(2.0)))).alias("lead_time_sigma"),
        F.sum("prediction").alias("horizon_demand"),
        F.avg("week_sigma").alias("weekly_sigma"),
        F.max("horizon").alias("horizon_weeks"),
        F.max("_lead").alias("_lead"),
    )
    if extend:
        beyond = F.greatest(F.col("_lead") - F.col("horizon_weeks"), F.lit(0.0))
        rate = F.col("horizon_demand") / F.col("horizon_weeks")
        out = out.withColumns(
            {
                "lead_time_demand": F.col("lead_time_demand") + beyond * rate,
                "lead_time_sigma": F.sqrt(
                    F.pow("lead_time_sigma", F.lit(2.0))
                    + beyond * F.pow("weekly_sigma", F.lit(2.0))
                ),
            }
        )
    return out.drop("_lead")


def assemble_risk(summary: DataFrame, position: DataFrame, master: DataFrame) -> DataFrame:
    """JN-8: forecast summary, stock position and product attributes, one row per SKU."""
    attributes = master.select("sku_id", "category", "subcategory", "unit_cost", "list_price")
    return (
        summary.join(position, "sku_id")
        .join(attributes, "sku_id", "left")
        .withColumns(
            {
                "lead_time_weeks": F.col("lead_time_days") / 7.0,
                "available_units": F.col("on_hand_units") + F.col("on_order_units"),
                "mean_weekly_forecast": F.col("horizon_demand")
                / F.col("horizon_weeks").cast("double"),
            }
        )
    )


def score_stockout(df: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """RSK-4."""
    mu, sigma, have = (F.col(c) for c in ("lead_time_demand", "lead_time_sigma", "available_units"))
    spread = F.greatest(sigma, F.lit(TINY))
    score = F.when(
        sigma > TINY, F.lit(1.0) - S.norm_cdf((have - mu) / spread)
    ).otherwise((mu > have).cast("double"))
    safety = S.clip(F.lit(settings.service_z) * sigma, low=0.0)
    return df.withColumns(
        {
            "stockout_score": S.clip(score, 0.0, 1.0),
            "safety_stock_units": safety,
            "target_stock_units": mu + safety,
            "recommended_order_units": F.ceil(S.clip(mu + safety - have, low=0.0)).cast("double"),
            "expected_lost_units": S.normal_loss(mu, sigma, have, TINY),
        }
    )


def score_overstock(df: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """RSK-5."""
    have, weekly = F.col("available_units"), F.col("mean_weekly_forecast")
    demand = weekly * F.lit(settings.overstock_cover_weeks)
    sigma = F.col("weekly_sigma") * F.lit(math.sqrt(settings.overstock_cover_weeks))
    cover = (
        F.when(have <= TINY, 0.0)
        .when(weekly > TINY, F.try_divide(have, weekly))
        .otherwise(NO_DEMAND_COVER)
    )
    score = F.when(
        sigma > TINY, S.norm_cdf((have - demand) / F.greatest(sigma, F.lit(TINY)))
    ).otherwise((have > demand).cast("double"))
    return df.withColumns(
        {
            "cover_weeks": cover,
            "cover_window_demand": demand,
            "overstock_score": F.when(have <= TINY, 0.0).otherwise(S.clip(score, 0.0, 1.0)),
            "excess_units": F.ceil(S.clip(have - demand, low=0.0)).cast("double"),
        }
    )


def money_at_risk(df: DataFrame) -> DataFrame:
    """RSK-6."""
    out = df.withColumn(
        "unit_margin", S.clip(F.col("list_price") - F.col("unit_cost"), low=0.0)
    ).withColumns(
        {
            "revenue_at_risk": S.round_even(F.col("expected_lost_units") * F.col("list_price"), 2),
            "margin_at_risk": S.round_even(F.col("expected_lost_units") * F.col("unit_margin"), 2),
            "locked_capital": S.round_even(F.col("excess_units") * F.col("unit_cost"), 2),
        }
    )
    return out.withColumn("value_at_stake", F.greatest("revenue_at_risk", "locked_capital"))


def volatility(df: DataFrame) -> DataFrame:
    """RSK-7."""
    weekly = F.col("mean_weekly_forecast")
    cv = F.when(
        weekly > LEAST_WEEKLY_DEMAND, F.try_divide(F.col("weekly_sigma"), weekly)
    ).otherwise(0.0)
    return df.withColumn("forecast_cv", cv).withColumn(
        "volatility_score", S.clip(F.col("forecast_cv") / VOLATILE_CV, 0.0, 1.0)
    )


def _text(action: Column, mapping: dict[str, str]) -> Column:
    out = None
    for key, text in mapping.items():
        out = F.when(action == key, text) if out is None else out.when(action == key, text)
    return out


def assign_action(df: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """RSK-8: volatile and exposed first, then the quadrant of the two scores."""
    high = settings.risk_high_threshold
    out_risk, over_risk = F.col("stockout_score"), F.col("overstock_score")
    erratic = (F.col("forecast_cv") >= VOLATILE_CV) & (
        (out_risk >= high / 2.0) | (over_risk >= high / 2.0)
    )
    action = (
        F.when(erratic, "watch_volatile")
        .when((out_risk >= high) & (over_risk < high), "reorder_now")
        .when((over_risk >= high) & (out_risk < high), "markdown_clear")
        .when((out_risk >= high) & (over_risk >= high), "watch_volatile")
        .otherwise("healthy")
    )
    return df.withColumn("action", action).withColumns(
        {
            "action_label": _text(F.col("action"), ACTION_LABELS),
            "action_rationale": _text(F.col("action"), ACTION_RATIONALE),
            "stockout_level": S.risk_level("stockout_score"),
            "overstock_level": S.risk_level("overstock_score"),
        }
    )


def confidence(df: DataFrame, features: DataFrame | None) -> DataFrame:
    """RSK-9: low for a thin history, medium for an erratic one.

    ``features`` needs ``sku_id, week_start, weeks_since_launch, cv_13``; the last
    week of each SKU counts.
    """
    if features is None:
        return df.withColumn("forecast_confidence", F.lit("high"))
    latest = features.groupBy("sku_id").agg(
        F.max_by(F.struct("weeks_since_launch", "cv_13"), "week_start").alias("_f")
    ).select("sku_id", "_f.*")
    young = F.coalesce(F.col("weeks_since_launch"), F.lit(999)) < LOW_CONFIDENCE_WEEKS
    erratic = F.coalesce(F.col("cv_13"), F.lit(0.0)) >= LOW_CONFIDENCE_CV
    return df.join(latest, "sku_id", "left").withColumn(
        "forecast_confidence", F.when(young, "low").when(erratic, "medium").otherwise("high")
    )


def priority_rank(risk: DataFrame) -> DataFrame:
    """WIN-20: rank by value at stake over the whole catalogue, by distributed sort."""
    placed = ordered(risk, F.desc("value_at_stake"), "sku_id")
    return placed.withColumnRenamed("position", "priority_rank")


def score_risk(forecast: DataFrame, inventory: DataFrame, master: DataFrame,
               settings: Settings = DEFAULTS, features: DataFrame | None = None,
               rank: bool = True, position: DataFrame | None = None) -> DataFrame:
    """The risk table: one row per SKU, every intermediate quantity kept."""
    needed = {"sku_id", "horizon", "prediction", "prediction_lower", "prediction_upper"}
    missing = sorted(needed - set(forecast.columns))
    if missing:
        raise ValueError(f"forecast lacks {missing}")
    position = latest_position(inventory) if position is None else position
    weighted = lead_weights(week_sigma(forecast, settings), position)
    table = assemble_risk(lead_time_summary(weighted, settings.extend_lead_time), position, master)
    table = score_overstock(score_stockout(table, settings), settings)
    table = assign_action(volatility(money_at_risk(table)), settings)
    table = confidence(table, features).withColumns(
        {
            "service_level": F.lit(settings.service_level),
            "overstock_threshold_weeks": F.lit(settings.overstock_cover_weeks),
        }
    )
    return priority_rank(table) if rank else table


def rescore(positions: DataFrame, stored: DataFrame, forecast: DataFrame, master: DataFrame,
            settings: Settings = DEFAULTS, rank: bool = True) -> DataFrame:
    """RSK-10: risk against supplied stock positions.

    ``positions`` carries ``sku_id, on_hand_units`` and optionally ``on_order_units``
    and ``lead_time_days``; what it omits comes from the stored risk table, and the
    confidence is carried over.  A duplicated product is the caller's mistake.
    """
    given = positions.withColumn("sku_id", F.upper(F.trim("sku_id")))
    optional = {
        c: (F.col(f"_g_{c}") if c in positions.columns else F.lit(None).cast("double"))
        for c in ("on_order_units", "lead_time_days")
    }
    given = given.select(
        "sku_id", "on_hand_units",
        *[F.col(c).alias(f"_g_{c}") for c in optional if c in positions.columns],
    )
    held = stored.select(
        "sku_id",
        F.col("on_order_units").alias("_s_order"),
        F.col("lead_time_days").alias("_s_lead"),
        "reorder_point",
        F.col("forecast_confidence").alias("_confidence"),
        "inventory_as_of",
    )
    position = given.join(held, "sku_id").select(
        "sku_id",
        "inventory_as_of",
        F.col("on_hand_units").cast("double").alias("on_hand_units"),
        F.coalesce(optional["on_order_units"], F.col("_s_order")).alias("on_order_units"),
        F.coalesce(optional["lead_time_days"], F.col("_s_lead")).alias("lead_time_days"),
        "reorder_point",
        "_confidence",
    )
    wanted = forecast.join(position.select("sku_id"), "sku_id", "left_semi")
    table = score_risk(wanted, None, master, settings, None, rank, position)
    return table.withColumn("forecast_confidence", F.coalesce("_confidence", F.lit("high"))).drop(
        "_confidence"
    )


def unknown_positions(positions: DataFrame, stored: DataFrame) -> DataFrame:
    """RSK-10: supplied products the stored plan does not know."""
    given = positions.select(F.upper(F.trim("sku_id")).alias("sku_id"))
    return given.join(stored.select("sku_id"), "sku_id", "left_anti")


GRID = ["sku_id", "category", "subcategory", "stockout_score", "overstock_score", "action",
        "action_label", "value_at_stake", "revenue_at_risk", "locked_capital", "cover_weeks",
        "available_units", "forecast_confidence"]


def decision_grid(risk: DataFrame) -> DataFrame:
    """RSK-11: the grid projection with the dominant risk and the suggested quantity."""
    over = F.col("overstock_score") > F.col("stockout_score")
    quantity = (
        F.when(F.col("recommended_order_units") > 0, F.col("recommended_order_units"))
        .when(F.col("excess_units") > 0, -F.col("excess_units"))
        .otherwise(0.0)
    )
    return risk.select(
        *GRID,
        F.when(over, "overstock").otherwise("stockout").alias("dominant_risk"),
        F.greatest("overstock_score", "stockout_score").alias("dominant_score"),
        quantity.alias("suggested_units"),
    )
