"""Processed tables and artifacts as Parquet, CSV exports (SRC-10, SNK-*)."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The processed tables of a run.
OUTPUTS = (
    "analysis_ready", "weekly_panel", "calendar", "inventory_clean", "sku_master_clean",
    "cleaning_report", "marketing_clean", "market_conditions_clean",
)
#: Large tables are laid out by month, so date filters prune files.
MONTHLY = {"analysis_ready": "date", "weekly_panel": "week_start"}
#: What a backtest leaves behind.
BACKTEST_OUTPUTS = (
    "backtest_predictions", "metrics", "metrics_by_horizon", "metrics_by_category", "metrics_by_regime",
    "feature_importance",
)
REQUIRED = ("weekly_panel", "sku_master_clean", "forecast", "risk_table")


def write_outputs(tables: dict[str, DataFrame], folder: str) -> list[str]:
    """SNK-1: the processed tables that were produced."""
    written = []
    for name in OUTPUTS:
        df = tables.get(name)
        if df is None:
            continue
        writer = df
        if name in MONTHLY:
            month = F.date_format(F.col(MONTHLY[name]), "yyyy-MM")
            # Rebalancing gathers a month into few files and splits one that is too large.
            writer = df.withColumn("month_of", month).hint("rebalance", "month_of")
            writer.write.mode("overwrite").partitionBy("month_of").parquet(f"{folder}/{name}")
        else:
            writer.write.mode("overwrite").parquet(f"{folder}/{name}")
        written.append(name)
    return written


_TAG = re.compile(r"[A-Za-z][A-Za-z0-9_.-]*")


def write_run(tables: dict[str, DataFrame], folder: str, tag: str) -> None:
    """Tables of one run, each a ``run_tag`` partition of its table.

    A rerun replaces the partition of its own tag and no other; a table without rows empties it.
    Tags begin with a letter, so that no reader takes them for numbers.
    """
    if not _TAG.fullmatch(tag):
        raise ValueError("a run tag begins with a letter and holds letters, digits, '_', '.' and '-'")
    for name, df in tables.items():
        if df is None:
            continue
        if df.isEmpty():  # a dynamic overwrite touches only partitions that it has rows for
            df.write.mode("overwrite").parquet(f"{folder}/{name}/run_tag={tag}")
            continue
        tagged = df.withColumn("run_tag", F.lit(tag))
        tagged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_tag").parquet(f"{folder}/{name}")


def read_run(spark: SparkSession, folder: str, name: str, tag: str | None = None) -> DataFrame:
    """A table of one run, or of all with their tag; the tag's partition alone is listed and read."""
    rows = spark.read.parquet(f"{folder}/{name}")
    return rows if tag is None else rows.where(F.col("run_tag") == tag).drop("run_tag")


def write_backtest(tables: dict[str, DataFrame], folder: str, tag: str = "default") -> None:
    """SNK-2: predictions, breakdowns, importances and metrics of a backtest; tagged runs coexist."""
    unknown = sorted(set(tables) - set(BACKTEST_OUTPUTS))
    if unknown:
        raise ValueError(f"not an artifact of a backtest: {', '.join(unknown)}")
    write_run(tables, folder, tag)


def write_plan(forecast: DataFrame, risk: DataFrame, impact: DataFrame, folder: str, tag: str = "default") -> None:
    """SNK-3: forecast, risk table and impact summary of one run."""
    write_run({"forecast": forecast, "risk_table": risk, "impact": impact}, folder, tag)


def write_csv(df: DataFrame, path: str) -> None:
    """SNK-4: dates as ISO text, with a header."""
    df.write.mode("overwrite").option("dateFormat", "yyyy-MM-dd").csv(path, header=True)


def read_artifacts(spark: SparkSession, folder: str, required=REQUIRED,
                   optional=()) -> dict[str, DataFrame | None]:
    """SRC-10: stored tables by name; a missing optional one is ``None``."""
    out: dict[str, DataFrame | None] = {}
    for name in (*required, *optional):
        try:
            out[name] = spark.read.parquet(f"{folder}/{name}")
        except AnalysisException:
            if name in required:
                raise FileNotFoundError(f"required artifact '{name}' is missing") from None
            out[name] = None
    return out
