"""Forecasts that need no fit (FC-1, FC-2) and the per-series benchmark (FC-9)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockloom.functions import scalar as S

# Fewest points a smoothing model is fitted on.
LEAST_POINTS = 10


def seasonal_naive() -> Column:
    """FC-1: demand of the same week a year before, else the 4-week mean, else 0."""
    return F.greatest(
        F.coalesce("units_seasonal_lag", "units_roll_mean_4", F.lit(0.0)), F.lit(0.0)
    )


def fallback_rate() -> Column:
    """FC-1: share of rows without a seasonal lag."""
    return F.avg(F.col("units_seasonal_lag").isNull().cast("double"))


def last_value() -> Column:
    """FC-2."""
    return F.greatest(F.coalesce("units_lag_0", F.lit(0.0)), F.lit(0.0))


def with_baselines(df: DataFrame) -> DataFrame:
    return df.withColumns({"baseline": seasonal_naive(), "naive": last_value()})


def smoothing_grid() -> list[tuple[float, float, float]]:
    """Level, trend and damping constants to try."""
    levels, trends, damping = (0.1, 0.3, 0.5, 0.8), (0.05, 0.2), (0.85, 0.98)
    return [(a, b, d) for a in levels for b in trends for d in damping]


def damped_smoothing(panel: DataFrame, origin, horizons) -> DataFrame:
    """FC-9: damped-trend smoothing per SKU, constants chosen by one-step error.

    Each SKU's series up to the origin becomes one array (bounded by the weeks of
    history) and every constant is run over it with ``aggregate``; the best one by
    squared error forecasts.  Series under ten points repeat their last value.
    """
    history = panel.filter(F.col("week_start") <= F.lit(origin))
    series = history.groupBy("sku_id").agg(
        F.array_sort(F.collect_list(F.struct("week_start", "units"))).alias("_s")
    )
    values = F.transform("_s", lambda x: x["units"])
    series = series.select("sku_id", values.alias("_v"))

    def run(a: float, b: float, d: float) -> Column:
        start = F.struct(
            F.element_at("_v", 1).alias("l"), F.lit(0.0).alias("t"), F.lit(0.0).alias("e")
        )

        def step(state, y):
            guess = state["l"] + F.lit(d) * state["t"]
            level = guess + F.lit(a) * (y - guess)
            trend = F.lit(d) * state["t"] + F.lit(a * b) * (y - guess)
            return F.struct(
                level.alias("l"), trend.alias("t"),
                (state["e"] + (y - guess) * (y - guess)).alias("e"),
            )

        rest = F.slice("_v", 2, F.greatest(F.size("_v") - 1, F.lit(0)))
        out = F.aggregate(rest, start, step)
        return F.struct(
            out["e"].alias("e"), F.lit(d).alias("d"), out["l"].alias("l"), out["t"].alias("t")
        )

    tried = series.withColumn(
        "_best", F.array_min(F.array(*[run(*c) for c in smoothing_grid()]))
    )
    rows = tried.withColumn("horizon", F.explode(F.array(*[F.lit(int(h)) for h in horizons])))
    d, h = F.col("_best.d"), F.col("horizon")
    damped = d * (F.lit(1.0) - F.pow(d, h)) / (F.lit(1.0) - d)
    guess = F.col("_best.l") + F.col("_best.t") * damped
    last = F.element_at("_v", -1)
    return rows.select(
        "sku_id",
        F.lit(origin).alias("week_start"),
        "horizon",
        F.greatest(
            F.when(F.size("_v") < LEAST_POINTS, last).otherwise(guess), F.lit(0.0)
        ).alias("prediction"),
    )


def clip_zero(column: str) -> Column:
    return S.clip(column, low=0.0)
