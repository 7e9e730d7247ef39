"""Portfolio aggregates over the weekly panel and the risk table (AGG-*, WIN-17/18)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockloom.functions import metrics as M
from stockloom.functions import scalar as S
from stockloom.operators.lookup import page
from stockloom.operators.ranking import exact_percentile, ordered
from stockloom.session import cut

DEAD_WEEKS = 8
MOVER_WEEKS = 8
MOVERS = 10
CONCENTRATION = (0.1, 0.2, 0.5)


def category_totals(panel: DataFrame, category: str | None = None) -> DataFrame:
    """AGG-1: totals per category."""
    rows = panel.filter(S.same_text("category", category)) if category else panel
    return rows.groupBy("category").agg(
        F.sum("units").alias("units"),
        F.sum("revenue").alias("revenue"),
        F.count_distinct("sku_id").alias("sku_count"),
    )


def sales_trend(panel: DataFrame, category: str | None = None, weeks: int = 104) -> DataFrame:
    """AGG-1: totals of the last ``weeks`` weeks, oldest first.

    The panel holds one row per SKU and week, so a plain count is the number of
    distinct SKUs.
    """
    rows = panel.filter(S.same_text("category", category)) if category else panel
    weekly = rows.groupBy("week_start").agg(
        F.sum("units").alias("units"),
        F.sum("revenue").alias("revenue"),
        F.count(F.lit(1)).alias("sku_count"),
    )
    return weekly.orderBy(F.desc("week_start")).limit(weeks).orderBy("week_start")


def category_summary(panel: DataFrame) -> DataFrame:
    """AGG-2."""
    return panel.groupBy("category").agg(
        F.count_distinct("sku_id").alias("skus"),
        F.sum("units").alias("total_units"),
        F.sum("revenue").alias("total_revenue"),
        F.avg("units").alias("mean_weekly_units"),
        F.avg(F.when(F.col("units") <= 0, 1.0).otherwise(0.0)).alias("zero_week_share"),
    )


def seasonal_index(panel: DataFrame) -> DataFrame:
    """AGG-3: mean of category and ISO week over the category's mean.

    The category mean is rolled up from the category-week sums (at most 53 rows
    per category), so no window spans a whole category.
    """
    cells = panel.groupBy("category", S.iso_week("week_start").alias("iso_week")).agg(
        F.sum("units").alias("_s"), F.count(F.lit(1)).alias("_n")
    )
    w = Window.partitionBy("category")
    mean = F.sum("_s").over(w) / F.sum("_n").over(w)
    return cells.select(
        "category",
        "iso_week",
        (F.col("_s") / F.col("_n")).alias("mean_units"),
        (F.col("_s") / F.col("_n") / F.greatest(mean, F.lit(1e-9))).alias("seasonal_index"),
    )


def promo_effect(panel: DataFrame) -> DataFrame:
    """AGG-4: mean units off and on promotion per category, and the uplift."""
    pivoted = (
        panel.withColumn("_on", F.col("promo_days") > 0)
        .groupBy("category")
        .pivot("_on", [False, True])
        .agg(F.avg("units"))
        .withColumnsRenamed({"false": "off_promo", "true": "on_promo"})
    )
    return pivoted.withColumn(
        "uplift_pct", S.ratio_or_null("on_promo", "off_promo") - F.lit(1.0)
    )


def revenue_by_sku(panel: DataFrame) -> DataFrame:
    return panel.groupBy("sku_id").agg(F.sum("revenue").alias("revenue"))


def pareto(panel: DataFrame) -> DataFrame:
    """AGG-5: SKUs by revenue with rank, SKU share and cumulative revenue share.

    Positions and running totals come from the distributed sort; the two grand
    totals are one row.
    """
    per_sku = revenue_by_sku(panel)
    placed = ordered(per_sku, F.desc("revenue"), "sku_id", totals={"_cum": "revenue"})
    grand = placed.agg(F.sum("revenue").alias("_total"), F.count(F.lit(1)).alias("_skus"))
    return placed.crossJoin(F.broadcast(grand)).select(  # one row
        "sku_id",
        "revenue",
        F.col("position").alias("rank"),
        (F.col("position") / F.col("_skus")).alias("sku_share"),
        S.ratio_or_null("_cum", "_total").alias("cumulative_share"),
    )


def pareto_figures(curve: DataFrame, cuts=(0.5, 0.8, 0.9)) -> DataFrame:
    """AGG-5/AGG-9: share of the top fifth of SKUs, and SKUs needed per revenue cut."""
    return curve.agg(
        F.max(F.when(F.col("sku_share") <= 0.20, F.col("cumulative_share"))).alias(
            "revenue_share_of_top_20pct_skus"
        ),
        *[
            (F.count_if(F.col("cumulative_share") <= c) + 1).alias(f"skus_for_{int(c * 100)}pct")
            for c in cuts
        ],
        F.count(F.lit(1)).alias("skus_total"),
    )


def revenue_concentration(panel: DataFrame, fractions=CONCENTRATION) -> DataFrame:
    """AGG-6: revenue share of the top fraction of SKUs."""
    curve = pareto(panel)
    picks = curve.sparkSession.createDataFrame(
        [(float(f),) for f in fractions], "sku_fraction double"
    )
    size = curve.agg(F.max("rank").alias("_n"))
    wanted = picks.crossJoin(size).select(
        "sku_fraction",
        F.greatest(F.lit(1), F.bround(F.col("_n") * F.col("sku_fraction"), 0).cast("long")).alias(
            "rank"
        ),
    )
    return (
        curve.join(F.broadcast(wanted), "rank")  # one row per fraction
        .select("sku_fraction", F.col("rank").alias("sku_count"),
                F.col("cumulative_share").alias("revenue_share"))
    )


def demand_decline(panel: DataFrame, n: int = 15) -> DataFrame:
    """AGG-7: last 13 weeks against the same 13 a year before, steepest first."""
    last = panel.agg(F.max("week_start").alias("_last"))
    aged = panel.select("sku_id", "week_start", "units").crossJoin(F.broadcast(last))  # one row
    recent = F.col("week_start") > F.date_sub("_last", 91)
    prior = (F.col("week_start") > F.date_sub("_last", 455)) & (
        F.col("week_start") <= F.date_sub("_last", 364)
    )
    both = aged.groupBy("sku_id").agg(
        F.avg(F.when(recent, F.col("units"))).alias("recent_weekly_units"),
        F.avg(F.when(prior, F.col("units"))).alias("prior_weekly_units"),
    )
    return (
        both.filter("recent_weekly_units IS NOT NULL AND prior_weekly_units > 0")
        .withColumn(
            "decline_pct",
            F.lit(1.0) - F.col("recent_weekly_units") / F.col("prior_weekly_units"),
        )
        .orderBy(F.desc("decline_pct"), "sku_id")
        .limit(n)
    )


def headline_figures(panel: DataFrame) -> DataFrame:
    """AGG-8: peak and trough week, swing, intermittent share, promotion lift."""
    weekly = panel.groupBy("week_start").agg(F.sum("units").alias("units"))
    peaks = weekly.agg(
        F.max_by("week_start", F.struct("units", -F.datediff("week_start", F.lit("1970-01-01")))).alias("peak_week"),
        F.max("units").alias("peak_units"),
        F.min_by("week_start", F.struct("units", "week_start")).alias("trough_week"),
        F.min("units").alias("trough_units"),
        F.max("week_start").alias("_last"),
    )
    last = peaks.select("_last")
    recent = panel.crossJoin(F.broadcast(last)).filter(  # one row
        F.col("week_start") > F.date_sub("_last", 91)
    )
    zero = recent.groupBy("sku_id").agg(
        F.avg(F.when(F.col("units") <= 0, 1.0).otherwise(0.0)).alias("z")
    )
    share = zero.agg(F.avg((F.col("z") >= 0.35).cast("double")).alias("intermittent_share"))
    lift = panel.agg(
        (
            F.try_divide(
                F.avg(F.when(F.col("promo_days") > 0, F.col("units"))),
                F.greatest(F.avg(F.when(F.col("promo_days") == 0, F.col("units"))), F.lit(1e-9)),
            )
            - 1.0
        ).alias("promo_lift")
    )
    return (
        peaks.withColumn(
            "swing", F.col("peak_units") / F.greatest(F.col("trough_units"), F.lit(1.0))
        )
        .drop("_last")
        .crossJoin(share)
        .crossJoin(lift)
    )


def tail_profile(panel: DataFrame) -> DataFrame:
    """AGG-9: median share of zero weeks per SKU and SKUs at or above 35%."""
    # One number per SKU, read by the median's sort and by the counts.
    zero = cut(panel.groupBy("sku_id").agg(
        F.avg(F.when(F.col("units") <= 0, 1.0).otherwise(0.0)).alias("zero_share")
    ))
    median = exact_percentile(zero, [], "zero_share", 0.5, "median_zero_share")
    heavy = zero.agg(
        F.count_if(F.col("zero_share") >= 0.35).alias("skus_heavy"),
        F.count(F.lit(1)).alias("skus"),
    )
    return median.drop("n").crossJoin(heavy)


def peak_week(index: DataFrame) -> DataFrame:
    """AGG-9: ISO week of the highest seasonal index per category."""
    return index.groupBy("category").agg(
        F.max_by("iso_week", F.struct("seasonal_index", -F.col("iso_week"))).alias(
            "peak_iso_week"
        )
    )


def top_skus(panel: DataFrame, n: int = 15) -> DataFrame:
    """SRT-1: best sellers by revenue."""
    return (
        panel.groupBy("sku_id", "category")
        .agg(F.sum("units").alias("total_units"), F.sum("revenue").alias("total_revenue"))
        .orderBy(F.desc("total_revenue"), "sku_id")
        .limit(n)
    )


def dead_stock(panel: DataFrame, least: int = DEAD_WEEKS) -> DataFrame:
    """WIN-17: SKUs whose series ends in at least ``least`` weeks without a sale."""
    sold = F.col("units") > 0
    per_sku = panel.groupBy("sku_id", "category", "subcategory").agg(
        F.max(F.when(sold, F.col("week_start"))).alias("last_sale_week"),
        F.max("week_start").alias("_last"),
        F.count(F.lit(1)).alias("_rows"),
    )
    # The panel has no gaps, so the rows after the last sale are the weeks since it.
    quiet = F.when(
        F.col("last_sale_week").isNull(), F.col("_rows")
    ).otherwise((F.datediff("_last", "last_sale_week") / 7).cast("long"))
    return (
        per_sku.withColumn("consecutive_zero_weeks", quiet)
        .filter(F.col("consecutive_zero_weeks") >= least)
        .select("sku_id", "category", "subcategory", "consecutive_zero_weeks", "last_sale_week")
    )


def _recent_and_prior(panel: DataFrame, weeks: int) -> DataFrame:
    w = Window.partitionBy("sku_id").orderBy(F.desc("week_start"))
    numbered = panel.withColumn("_rn", F.row_number().over(w))
    rn = F.col("_rn")
    return numbered.groupBy("sku_id", "category").agg(
        F.count(F.lit(1)).alias("_rows"),
        F.sum(F.when(rn <= weeks, F.col("revenue")).otherwise(0.0)).alias("recent_revenue"),
        F.sum(
            F.when((rn > weeks) & (rn <= 2 * weeks), F.col("revenue")).otherwise(0.0)
        ).alias("prior_revenue"),
    )


def movers(panel: DataFrame, weeks: int = MOVER_WEEKS) -> DataFrame:
    both = _recent_and_prior(panel, weeks)
    return both.filter((F.col("_rows") >= 2 * weeks) & (F.col("prior_revenue") > 0)).select(
        "sku_id",
        "category",
        "recent_revenue",
        "prior_revenue",
        ((F.col("recent_revenue") - F.col("prior_revenue")) / F.col("prior_revenue")).alias(
            "change_pct"
        ),
    )


def top_movers(panel: DataFrame, weeks: int = MOVER_WEEKS, n: int = MOVERS) -> DataFrame:
    """WIN-18: the strongest gainers and decliners."""
    table = movers(panel, weeks)
    up = table.orderBy(F.desc("change_pct"), "sku_id").limit(n).withColumn(
        "direction", F.lit("gainer")
    )
    down = table.orderBy("change_pct", "sku_id").limit(n).withColumn(
        "direction", F.lit("decliner")
    )
    return up.unionByName(down)


# The orders a product table may be read in.
PERFORMANCE_ORDERS = {
    "revenue_desc": ("total_revenue", False),
    "units_desc": ("total_units", False),
    "trend_desc": ("recent_trend_pct", False),
    "trend_asc": ("recent_trend_pct", True),
    "value_at_stake_desc": ("value_at_stake", False),
}


def product_table(panel: DataFrame, risk: DataFrame | None = None) -> DataFrame:
    """AGG-16: revenue, units, share, trend and current action of every SKU."""
    w = Window.partitionBy("sku_id").orderBy(F.desc("week_start"))
    rn = F.col("_rn")
    n = MOVER_WEEKS
    totals = cut(  # a row per SKU, read for itself and for the grand total
        panel.withColumn("_rn", F.row_number().over(w))
        .groupBy("sku_id", "category", "subcategory")
        .agg(
            F.sum("revenue").alias("total_revenue"),
            F.sum("units").alias("total_units"),
            F.count(F.lit(1)).alias("_rows"),
            F.sum(F.when(rn <= n, F.col("revenue")).otherwise(0.0)).alias("_recent"),
            F.sum(F.when((rn > n) & (rn <= 2 * n), F.col("revenue")).otherwise(0.0)).alias(
                "_prior"
            ),
        )
    )
    grand = totals.agg(F.sum("total_revenue").alias("_all"))
    trend = F.when(
        (F.col("_rows") >= 2 * n) & (F.col("_prior") > 0),
        F.try_divide(F.col("_recent") - F.col("_prior"), F.col("_prior")),
    ).otherwise(0.0)
    table = totals.crossJoin(F.broadcast(grand)).select(  # one row
        "sku_id", "category", "subcategory", "total_revenue", "total_units",
        F.coalesce(S.ratio_or_null("total_revenue", "_all"), F.lit(0.0)).alias("revenue_share"),
        trend.alias("recent_trend_pct"),
    )
    if risk is None:
        return table.withColumns(
            {"action": F.lit("unknown"), "action_label": F.lit("Unknown"),
             "value_at_stake": F.lit(0.0)}
        )
    known = risk.select("sku_id", "action", "action_label", "value_at_stake")
    return table.join(known, "sku_id", "left").fillna(
        {"action": "unknown", "action_label": "Unknown", "value_at_stake": 0.0}
    )


def product_performance(panel: DataFrame, risk: DataFrame | None = None,
                        sort: str = "revenue_desc", limit: int = 200, offset: int = 0,
                        category: str | None = None) -> DataFrame:
    """AGG-16 / SRT-2: one page of the product table."""
    if sort not in PERFORMANCE_ORDERS:
        raise ValueError(f"unknown sort '{sort}'; valid: {sorted(PERFORMANCE_ORDERS)}")
    column, ascending = PERFORMANCE_ORDERS[sort]
    table = product_table(panel, risk)
    if category:
        table = table.filter(S.same_text("category", category))
    first = F.asc(column) if ascending else F.desc(column)
    return page(table, [first, F.col("sku_id")], limit, offset)


# --------------------------------------------------------------------------- #
# Over the risk table
# --------------------------------------------------------------------------- #
_IMPACT = ("revenue_at_risk", "margin_at_risk", "locked_capital", "expected_lost_units",
           "excess_units")


def impact_by_action(risk: DataFrame) -> DataFrame:
    """AGG-13: counts and sums per recommended action."""
    return risk.groupBy("action").agg(
        F.count("sku_id").alias("skus"), *[F.sum(c).alias(c) for c in _IMPACT]
    )


def aggregate_impact(risk: DataFrame) -> DataFrame:
    """AGG-13: the one-row portfolio impact."""

    def of(action: str, value: Column) -> Column:
        return F.coalesce(F.sum(F.when(F.col("action") == action, value)), F.lit(0.0))

    def count(action: str) -> Column:
        return F.count_if(F.col("action") == action)

    top = (
        risk.select("sku_id", "revenue_at_risk")
        .orderBy(F.desc("revenue_at_risk"), "sku_id")
        .limit(10)
        .agg(F.sum("revenue_at_risk").alias("_top"))
    )
    totals = risk.agg(
        F.count(F.lit(1)).alias("total_skus"),
        F.max("horizon_weeks").alias("horizon_weeks"),
        *[F.sum(c).alias(f"{c}_total") for c in _IMPACT],
        count("reorder_now").alias("reorder_now_skus"),
        of("reorder_now", F.col("revenue_at_risk")).alias("reorder_now_revenue_at_risk"),
        of("reorder_now", F.col("recommended_order_units")).alias("reorder_now_order_units"),
        count("markdown_clear").alias("markdown_skus"),
        of("markdown_clear", F.col("locked_capital")).alias("markdown_locked_capital"),
        count("watch_volatile").alias("watch_skus"),
        count("healthy").alias("healthy_skus"),
        F.count_if(F.col("forecast_confidence") == "low").alias("low_confidence_skus"),
    )
    return (
        totals.crossJoin(top)
        .withColumn(
            "top_10_share_of_revenue_at_risk",
            F.col("_top") / F.greatest(F.col("revenue_at_risk_total"), F.lit(1e-9)),
        )
        .drop("_top")
    )


# --------------------------------------------------------------------------- #
# Over scored forecasts
# --------------------------------------------------------------------------- #
def accuracy_views(predictions: DataFrame, models=("ensemble", "reconciled")) -> DataFrame:
    """AGG-12: accuracy at the grains a planner commits to."""
    month = F.trunc("target_week", "month").alias("month")
    views = {
        "sku_month": ["sku_id", month],
        "sku_full_horizon": ["sku_id", "week_start"],
        "category_week": ["category", "target_week"],
        "portfolio_week": ["target_week"],
    }
    out = None
    for name, keys in views.items():
        rolled = predictions.groupBy(*keys).agg(
            F.sum("y").alias("y"), *[F.sum(m).alias(m) for m in models]
        )
        row = rolled.agg(
            *[(F.lit(1.0) - M.wape("y", m)).alias(f"{m}_accuracy") for m in models]
        ).select(F.lit(name).alias("view"), *[f"{m}_accuracy" for m in models])
        out = row if out is None else out.unionByName(row)
    return out


def accuracy_by_age(predictions: DataFrame, models) -> DataFrame:
    """CLD-7: accuracy per age band of the origin week."""
    age = F.col("weeks_since_launch")
    # The bands.
    band = (
        F.when(age <= 4, "0-4 weeks").when(age <= 8, "5-8 weeks").when(age <= 13, "9-13 weeks")
        .when(age <= 26, "14-26 weeks").otherwise("27+ weeks")
    )
    total = predictions.agg(F.sum("y").alias("_all"))
    grouped = predictions.groupBy(band.alias("age_band")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("y").alias("_y"),
        *[M.wape("y", m).alias(f"{m}_wape") for m in models],
    )
    return grouped.crossJoin(F.broadcast(total)).select(  # one row
        "age_band", "rows", S.ratio_or_null("_y", "_all").alias("units_share"),
        *[f"{m}_wape" for m in models],
    )


def holdout_by_week(scored: DataFrame) -> DataFrame:
    """AGG-14: one row per holdout week."""
    return scored.groupBy("target_week").agg(
        F.sum("actual").alias("actual"),
        F.sum("prediction").alias("predicted"),
        F.sum("baseline").alias("baseline"),
        F.sum("prediction_lower").alias("lower"),
        F.sum("prediction_upper").alias("upper"),
        F.count_distinct("sku_id").alias("skus"),
        F.avg("within_interval").alias("covered"),
    ).withColumn(
        "error_pct", S.ratio_or_null(F.col("predicted") - F.col("actual"), "actual")
    )


def holdout_by_category(scored: DataFrame) -> DataFrame:
    """AGG-14: per category, with its share of units."""
    total = scored.agg(F.sum(F.abs("actual")).alias("_all"))
    grouped = scored.groupBy("category").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("actual").alias("actual"),
        F.sum("prediction").alias("predicted"),
        M.wape("actual", "prediction").alias("wape"),
    )
    return grouped.crossJoin(F.broadcast(total)).select(  # one row
        "category", "rows", "actual", "predicted", "wape",
        (F.lit(1.0) - F.col("wape")).alias("accuracy"),
        F.coalesce(S.ratio_or_null("actual", "_all"), F.lit(0.0)).alias("share_of_units"),
    )


def holdout_by_horizon(scored: DataFrame) -> DataFrame:
    """AGG-14: per horizon."""
    return scored.groupBy("horizon").agg(
        F.count(F.lit(1)).alias("rows"),
        M.wape("actual", "prediction").alias("wape"),
        F.avg("within_interval").alias("coverage"),
    ).withColumn("accuracy", F.lit(1.0) - F.col("wape"))


def holdout_by_sku(scored: DataFrame) -> DataFrame:
    """AGG-14: per SKU, most units mis-forecast first."""
    grouped = scored.groupBy("sku_id", "category").agg(
        F.count(F.lit(1)).alias("weeks"),
        F.sum("actual").alias("actual"),
        F.sum("prediction").alias("predicted"),
        F.sum("abs_error").alias("abs_error"),
        F.avg("within_interval").alias("coverage"),
    )
    return grouped.withColumns(
        {
            "wape": S.ratio_or_null("abs_error", "actual"),
            "bias": S.ratio_or_null(F.col("predicted") - F.col("actual"), "actual"),
        }
    ).withColumn("accuracy", F.lit(1.0) - F.col("wape"))


def error_contributors(matched: DataFrame, n: int = 200) -> DataFrame:
    """AGG-15: absolute error per SKU and its share of the total."""
    error = F.abs(F.col("forecast") - F.col("actual"))
    total = matched.agg(F.sum(error).alias("_all"))
    grouped = matched.groupBy("sku_id").agg(
        F.count(F.lit(1)).alias("n_observations"),
        F.sum("actual").alias("total_actual"),
        F.sum("forecast").alias("total_forecast"),
        F.sum(error).alias("absolute_error"),
    )
    return (
        grouped.crossJoin(F.broadcast(total))  # one row
        .withColumn(
            "share_of_total_error",
            F.coalesce(S.ratio_or_null("absolute_error", "_all"), F.lit(0.0)),
        )
        .drop("_all")
        .orderBy(F.desc("absolute_error"), "sku_id")
        .limit(n)
    )


def coverage_by_regime(df: DataFrame, low: str, high: str, actual: str = "y") -> DataFrame:
    """AGG-17: interval coverage per demand regime."""
    return df.groupBy("regime").agg(
        F.count(F.lit(1)).alias("rows"), M.coverage(actual, low, high).alias("coverage")
    )
