"""Read operators over stored results (QRY-*)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockloom.functions import scalar as S
from stockloom.operators import insights
from stockloom.operators.lookup import last_n_weeks, latest_origin, normalise_ids, page


def forecast_for(ids: DataFrame, forecast: DataFrame, risk: DataFrame) -> DataFrame:
    """QRY-1: forecast and risk of a list of products; unknown ids stay, without a forecast.

    ``ids`` has ``sku_id`` and ``_row_seq``.
    """
    wanted = normalise_ids(ids).select("sku_id")
    points = forecast.select("sku_id", "horizon", "target_week", "prediction",
                             "prediction_lower", "prediction_upper")
    short = risk.select("sku_id", "action", "value_at_stake")
    return (
        wanted.join(points, "sku_id", "left")
        .join(short, "sku_id", "left")
        .withColumn("found", F.col("horizon").isNotNull())
    )


def sku_detail(sku: str, panel: DataFrame, backtest: DataFrame, forecast: DataFrame,
               risk: DataFrame, weeks: int = 104) -> dict[str, DataFrame]:
    """QRY-2: history, backtest (latest origin per week), forecast and risk of one product.

    The filter comes first, so only that product's files or row groups are read.
    """
    def at(df: DataFrame) -> DataFrame:
        return df.filter(F.col("sku_id") == sku.strip().upper())

    return {
        "history": last_n_weeks(at(panel), weeks).select(
            "sku_id", "week_start", "units", "revenue", "promo_days"
        ),
        "backtest": latest_origin(at(backtest)),
        "forecast": at(forecast).orderBy("horizon"),
        "risk": at(risk),
    }


def worklist(risk: DataFrame, action: str | None = None, category: str | None = None,
             search: str | None = None, limit: int = 200, offset: int = 0) -> DataFrame:
    """SRT-2: the prioritised worklist, filtered and paged."""
    rows = risk
    if action:
        rows = rows.filter(F.col("action") == action.strip().lower())
    if category:
        rows = rows.filter(S.same_text("category", category))
    if search:
        rows = rows.filter(S.has_text("sku_id", search))
    return page(rows, [F.asc("priority_rank")], limit, offset)


def portfolio_summary(risk: DataFrame, selection: DataFrame) -> DataFrame:
    """QRY-3: impact of the plan beside the accuracy of the model behind it."""
    return insights.aggregate_impact(risk).crossJoin(selection)  # one row each
