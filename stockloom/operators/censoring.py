"""Demand hidden by stockouts (CEN-*, WIN-16)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockloom.contracts import InsufficientHistoryError
from stockloom.functions import scalar as S
from stockloom.operators.features import series
from stockloom.session import cut, small_side

# Thresholds of the recovery.
SERVED = 0.97
BLACKOUT = 0.05
LEAST_AVAILABILITY = 0.15
MAX_UPLIFT = 5.0
PASSES = 3
TINY = 1e-6


def implied_receipts(panel: DataFrame, inventory: DataFrame) -> DataFrame:
    """WIN-16: opening stock of the week and what must have arrived during it."""
    opening = inventory.groupBy("sku_id", F.col("date").cast("date").alias("week_start")).agg(
        F.max_by("on_hand_units", "date").alias("on_hand_start")
    )
    joined = panel.join(opening, ["sku_id", "week_start"], "left")
    closing = F.lead("on_hand_start").over(series())
    receipts = F.coalesce(
        S.clip(closing - F.col("on_hand_start") + F.col("units"), low=0.0), F.lit(0.0)
    )
    return joined.withColumn("receipts", receipts).withColumn(
        "available_units",
        F.greatest(F.coalesce("on_hand_start", F.lit(0.0)) + F.col("receipts"), F.lit(0.0)),
    )


def _availability(expected: Column) -> Column:
    have, sold = F.col("available_units"), F.col("units")
    share = S.clip(have / F.greatest(expected, F.lit(TINY)), 0.0, 1.0)
    share = F.when(F.col("on_hand_start").isNotNull(), share).otherwise(1.0)
    sold_share = sold / F.greatest(have, F.lit(TINY))
    lifted = (sold > 0) & (sold_share <= 1.0) & (share < 1.0)
    return F.when(lifted, F.greatest(share, sold_share)).otherwise(share)


def attach_availability(panel: DataFrame, inventory: DataFrame,
                        expected: str | None = None) -> DataFrame:
    """CEN-1: sellable share of every SKU-week.

    ``expected`` names a column with the demand rate to compare stock with; by
    default the SKU's own mean sales.
    """
    stocked = implied_receipts(panel, inventory)
    whole = Window.partitionBy("sku_id")
    rate = F.col(expected) if expected else F.avg("units").over(whole)
    return stocked.withColumn("_rate", rate).withColumn(
        "availability", _availability(F.col("_rate"))
    ).drop("_rate")


def blackout_fallback(df: DataFrame) -> DataFrame:
    """CEN-2: expected demand of a week in which nothing could sell.

    Level of the SKU's served weeks times the category's week shape (clipped
    0.25-4).  The shape table has at most 53 rows per category; its means are
    computed by grouping, not by windows over whole categories.
    """
    is_served = F.col("availability") >= SERVED
    # A row per category and week of the year: all that other SKUs say to a row.
    cells = cut(df.filter(is_served).groupBy("category", S.iso_week("week_start").alias("_week")).agg(
        F.sum("units").alias("_s"), F.count("units").alias("_known"), F.count(F.lit(1)).alias("_n")
    ))
    overall = cells.agg(F.try_divide(F.sum("_s"), F.sum("_known")).alias("_overall"))
    whole = Window.partitionBy("sku_id")
    level = F.when(F.col("sku_id").isNotNull(), F.avg(F.when(is_served, F.col("units"))).over(whole))
    means = cells.groupBy("category").agg((F.sum("_s") / F.sum("_n")).alias("_mean"))
    shape = cells.join(small_side(means), "category").select(
        "category", "_week",
        S.clip(S.ratio_or_null(F.col("_s") / F.col("_n"), "_mean"), 0.25, 4.0).alias("_shape"),
    )
    return (
        df.withColumn("_week", S.iso_week("week_start"))
        .withColumn("_level", level)
        .join(small_side(shape), ["category", "_week"], "left")
        .crossJoin(F.broadcast(overall))  # one row
        .withColumn(
            "fallback",
            F.coalesce(
                F.col("_level"), F.col("_overall"),
                F.avg("units").over(whole),
            )
            * F.coalesce("_shape", F.lit(1.0)),
        )
        .drop("_week", "_level", "_shape", "_overall")
    )


def _recovered(df: DataFrame, cap: float) -> DataFrame:
    seen, share = F.col("units"), F.col("availability")
    guess = F.when(share <= BLACKOUT, F.col("fallback")).otherwise(
        seen / F.greatest(share, F.lit(LEAST_AVAILABILITY))
    )
    ceiling = F.greatest(
        F.when(seen > 0, seen * cap).otherwise(F.col("fallback") * cap), F.lit(TINY)
    )
    demand = S.clip(F.least(F.greatest(guess, seen), ceiling), low=0.0)
    return df.withColumn("units_demand", F.when(share >= SERVED, seen).otherwise(demand))


def recover_demand(panel: DataFrame, inventory: DataFrame, passes: int = PASSES,
                   cap: float = MAX_UPLIFT) -> DataFrame:
    """CEN-3: alternate between demand and availability.

    Each pass re-reads the stocked panel with a better demand rate.  The frame is
    written out between passes, so the plan stays as long as one pass and a lost
    executor replays one pass only.
    """
    if passes < 1:
        raise InsufficientHistoryError("passes must be at least 1")
    stocked = cut(implied_receipts(panel, inventory))
    whole = Window.partitionBy("sku_id")
    state = stocked.withColumn("units_demand", F.col("units"))
    for turn in range(passes):
        rate = F.avg("units_demand").over(whole)
        state = state.withColumn("_rate", rate).withColumn(
            "availability", _availability(F.col("_rate"))
        ).drop("_rate", "units_demand")
        state = _recovered(blackout_fallback(state), cap).drop("fallback")
        if turn < passes - 1:
            state = cut(state)
    return state.withColumns(
        {
            "is_censored": (F.col("availability") < SERVED).cast("int"),
            "censoring_uplift": F.col("units_demand") - F.col("units"),
        }
    )


def censoring_summary(df: DataFrame) -> DataFrame:
    """CEN-4."""
    hit = F.col("is_censored") == 1
    return df.agg(
        F.count(F.lit(1)).alias("total_weeks"),
        F.count_if(hit).alias("censored_weeks"),
        F.count_if(F.col("availability") <= BLACKOUT).alias("blackout_weeks"),
        F.avg(hit.cast("double")).alias("censored_share"),
        F.sum("units").alias("observed_units"),
        F.sum("units_demand").alias("recovered_units"),
        F.coalesce(
            S.ratio_or_null(F.sum("units_demand") - F.sum("units"), F.sum("units")), F.lit(0.0)
        ).alias("uplift_share"),
        F.count_distinct(F.when(hit, F.col("sku_id"))).alias("skus_affected"),
    )
