"""Order statistics that never put a whole table or a whole group in one task.

``Window.orderBy`` without a partition sends every row to one task, and
``percentile`` keeps every distinct value of a group in one buffer.  Both are
fine for one SKU's weekly series (a few thousand points) and wrong for "all
SKUs" or "all rows of a category".  Here a range-partitioned sort gives each
row a slot, the sorted rows are checkpointed so that slots cannot move, and only
one small row per partition is needed to turn slots into global positions and
running totals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockloom.session import cut, small_side

_SLOT_BITS = 33


def ordered(df: DataFrame, *order: Column | str, totals: dict[str, str] | None = None) -> DataFrame:
    """Add ``position`` (1-based, global) and running totals under ``order``.

    ``totals`` maps an output name to the column it accumulates.  The order
    must be total (end it with a key) for the result to be deterministic.
    """
    totals = totals or {}
    kept = cut(df.orderBy(*order).withColumn("_slot", F.monotonically_increasing_id()))
    kept = kept.withColumn("_part", F.shiftright("_slot", _SLOT_BITS))
    sums = [F.sum(F.col(c)).alias(f"_sum_{o}") for o, c in totals.items()]
    # One row per sort partition: its size is the partition count, not the data.
    parts = kept.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"), *sums)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(
        "_part",
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows_before"),
        *[
            F.coalesce(F.sum(f"_sum_{o}").over(before), F.lit(0)).alias(f"_before_{o}")
            for o in totals
        ],
    )
    inside = Window.partitionBy("_part").orderBy("_slot").rowsBetween(Window.unboundedPreceding, 0)
    out = kept.join(small_side(offsets), "_part")
    out = out.withColumn(
        "position",
        F.col("_rows_before") + F.col("_slot").bitwiseAND(F.lit((1 << _SLOT_BITS) - 1)) + 1,
    )
    for o, c in totals.items():
        out = out.withColumn(o, F.col(f"_before_{o}") + F.sum(F.col(c)).over(inside))
    return out.drop("_slot", "_part", "_rows_before", *[f"_before_{o}" for o in totals])


def exact_percentile(
    df: DataFrame,
    keys: list[str],
    value: str,
    level: float | Column,
    name: str = "value",
    few_keys: bool = False,
) -> DataFrame:
    """Exact linear-interpolated percentile of ``value`` per ``keys``.

    ``level`` may be a constant or an expression over ``n`` (the group's count
    of non-null values).  Equal values are counted before anything is sorted, and
    a group of any size is spread over the sort's partitions.  ``few_keys`` lets
    the per-group row ride as a broadcast when its count has been checked.
    """
    level = F.lit(level) if isinstance(level, (int, float)) else level
    grouped = [F.lit(0).alias("_all")] if not keys else [F.col(k) for k in keys]
    names = keys or ["_all"]
    counted = (
        df.filter(F.col(value).isNotNull())
        .select(*grouped, F.col(value).cast("double").alias("_v"))
        .groupBy(*names, "_v")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    placed = ordered(counted, *names, "_v", totals={"_end": "_n"})
    placed = placed.withColumn("_begin", F.col("_end") - F.col("_n"))
    spans = placed.groupBy(*names).agg(
        F.min("_begin").alias("_first"), F.sum("_n").alias("n")
    )
    spans = spans.withColumn("_at", level * (F.col("n") - 1)).select(
        *names, "n", "_first", "_at",
        F.floor("_at").alias("_lo"), F.ceil("_at").alias("_hi"),
    )
    if few_keys or not keys:
        spans = small_side(spans)
    hit = placed.join(spans, names)
    start, end = F.col("_begin") - F.col("_first"), F.col("_end") - F.col("_first")
    lo = (start <= F.col("_lo")) & (F.col("_lo") < end)
    hi = (start <= F.col("_hi")) & (F.col("_hi") < end)
    out = (
        hit.filter(lo | hi)
        .groupBy(*names)
        .agg(
            F.max("n").alias("n"),
            F.max(F.when(lo, F.col("_v"))).alias("_a"),
            F.max(F.when(hi, F.col("_v"))).alias("_b"),
            F.max(F.col("_at") - F.col("_lo")).alias("_f"),
        )
        .withColumn(name, F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_f"))
    )
    return out.select(*keys, "n", name)


def avg_pct_rank(df: DataFrame, value: str, partition: str, name: str = "pct_rank") -> DataFrame:
    """WIN-19: percentile rank with ties averaged, (average rank) / n.

    Equal values of a partition are counted first; positions come from the
    distributed sort, so one very large partition is not one task.
    """
    counted = df.groupBy(partition, value).agg(F.count(F.lit(1)).alias("_n"))
    placed = ordered(counted, partition, value, totals={"_end": "_n"})
    spans = placed.groupBy(partition).agg(
        F.min(F.col("_end") - F.col("_n")).alias("_first"), F.sum("_n").alias("_size")
    )
    ranks = placed.join(spans, partition).select(
        partition,
        value,
        (
            (F.col("_end") - F.col("_n") - F.col("_first") + 1 + (F.col("_n") - 1) / 2.0)
            / F.col("_size")
        ).alias(name),
    )
    return df.join(ranks, [partition, value])
