"""Split-conformal interval widths per demand regime (CNF-*)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockloom.functions import scalar as S
from stockloom.operators.lookup import POOLED, lookup_pooled
from stockloom.operators.ranking import exact_percentile

# Thresholds and bounds.
LEAST_ROWS = 30
LEAST_HALF_WIDTH = 1e-6
SCALE_BOUNDS = (0.25, 6.0)


def _half(low: str, high: str):
    return F.greatest((F.col(high) - F.col(low)) / 2.0, F.lit(LEAST_HALF_WIDTH))


def fit_conformal(df: DataFrame, target: float = 0.8, point: str = "ensemble",
                  low: str = "ensemble_lower", high: str = "ensemble_upper") -> DataFrame:
    """CNF-1: width scale per regime (30 rows or more) and pooled.

    The quantile level ``min(1, ceil((n+1) target) / n)`` depends on the group's own
    size, so ranks are picked from a distributed sort.
    """
    rows = df.select("regime", (F.abs(F.col("y") - F.col(point)) / _half(low, high)).alias("_s"))
    level = F.least(F.lit(1.0), F.ceil((F.col("n") + 1) * F.lit(target)) / F.col("n"))
    own = exact_percentile(rows, ["regime"], "_s", level, "scale", few_keys=True)
    pooled = exact_percentile(rows, [], "_s", level, "scale").select(
        F.lit(POOLED).alias("regime"), "n", "scale"
    )
    out = own.filter(F.col("n") >= LEAST_ROWS).unionByName(pooled)
    return out.select("regime", F.col("n").alias("rows"), S.clip("scale", *SCALE_BOUNDS).alias("scale"))


def apply_conformal(df: DataFrame, scales: DataFrame, point: str = "ensemble",
                    low: str = "ensemble_lower", high: str = "ensemble_upper") -> DataFrame:
    """CNF-2: symmetric interval around the point at the row's regime scale, 1 without any calibration."""
    out = lookup_pooled(df, scales.select("regime", "scale"), "regime", ["scale"])
    half = _half(low, high) * F.coalesce("scale", F.lit(1.0))
    return out.withColumns(
        {
            "recalibrated_lower": F.greatest(F.col(point) - half, F.lit(0.0)),
            "recalibrated_upper": F.col(point) + half,
        }
    ).drop("scale")
