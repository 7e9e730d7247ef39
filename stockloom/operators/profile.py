"""Arrival profile of a raw table (PRF-*)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SAMPLES = 5


def profile(df: DataFrame, exact: bool = True) -> DataFrame:
    """PRF-1: one row per column: rows, nulls, distinct values, first five values.

    The columns become rows ``(column, value)`` that are grouped by value, so a
    distinct count is a count of groups and no group holds a whole column.
    ``exact=False`` uses a sketch instead for very wide or very distinct tables.
    """
    text = df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])
    long = text.select(
        F.inline(
            F.array(
                *[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in df.columns]
            )
        )
    )
    if exact:
        values = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("_n"))
        counts = values.groupBy("column").agg(
            F.sum("_n").alias("rows"),
            F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("_n"))), F.lit(0)).alias(
                "nulls"
            ),
            F.count("value").alias("distinct"),
        )
    else:
        values = long
        counts = long.groupBy("column").agg(
            F.count(F.lit(1)).alias("rows"),
            F.count_if(F.col("value").isNull()).alias("nulls"),
            F.approx_count_distinct("value").alias("distinct"),
        )
    # Five smallest values per column: smallest of 64 slices first, then of those.
    seen = values.filter(F.col("value").isNotNull()).select("column", "value").distinct()
    sliced = seen.withColumn("_s", F.pmod(F.xxhash64("value"), F.lit(64)))
    near = Window.partitionBy("column", "_s").orderBy("value")
    few = sliced.withColumn("_r", F.row_number().over(near)).filter(F.col("_r") <= SAMPLES)
    all_ = Window.partitionBy("column").orderBy("value")
    first = (
        few.withColumn("_r", F.row_number().over(all_))
        .filter(F.col("_r") <= SAMPLES)
        .groupBy("column")
        .agg(F.concat_ws(", ", F.sort_array(F.collect_list("value"))).alias("samples"))
    )
    share = F.round(100.0 * F.col("nulls") / F.col("rows"), 3)
    return counts.join(first, "column", "left").withColumn("null_pct", share)


def duplicate_rows(df: DataFrame) -> DataFrame:
    """PRF-1: rows beyond the first of every set of identical rows."""
    sets = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    return sets.agg(
        F.sum("_n").alias("rows"), F.sum(F.col("_n") - 1).alias("exact_duplicate_rows")
    ).withColumn("columns", F.lit(len(df.columns)))


def preflight(tables: dict[str, DataFrame], worst: int = 3) -> DataFrame:
    """PRF-2: the three columns with the most nulls of every table."""
    out = None
    for name, df in tables.items():
        p = profile(df).select(F.lit(name).alias("table"), "column", "rows", "null_pct")
        out = p if out is None else out.unionByName(p)
    w = Window.partitionBy("table").orderBy(F.desc("null_pct"), "column")  # a table's columns
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= worst)
