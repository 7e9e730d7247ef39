"""Lookups with fallbacks, latest-per-key, paging and set operations (JN-*, SRT-*, SET-*)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockloom.functions import scalar as S
from stockloom.session import small_side

POOLED = "__POOLED__"


def lookup_pooled(df: DataFrame, coefs: DataFrame, key: str, values: list[str]) -> DataFrame:
    """JN-1: coefficients of the row's own group, else of the pooled row.

    ``coefs`` has one row per group plus a ``__POOLED__`` row.  Without a pooled row the
    values of unknown groups are null; every row of ``df`` stays.
    """
    own = coefs.filter(F.col(key) != POOLED)
    pooled = coefs.filter(F.col(key) == POOLED).agg(
        *[F.max(v).alias(f"_p_{v}") for v in values]
    )
    out = df.join(small_side(own.select(key, *values)), key, "left").crossJoin(
        F.broadcast(pooled)  # a global aggregate is one row, also over nothing
    )
    return out.withColumns({v: F.coalesce(F.col(v), F.col(f"_p_{v}")) for v in values}).drop(
        *[f"_p_{v}" for v in values]
    )


def lookup_seasonal(df: DataFrame, by_category: DataFrame, by_week: DataFrame, week: str,
                    name: str) -> DataFrame:
    """JN-2: index of category and week, else of the week, else 1."""
    a = by_category.select("category", F.col("iso_week").alias(week), F.col("index").alias("_c"))
    b = by_week.select(F.col("iso_week").alias(week), F.col("index").alias("_w"))
    return (
        df.join(small_side(a), ["category", week], "left")
        .join(small_side(b), week, "left")
        .withColumn(name, F.coalesce("_c", "_w", F.lit(1.0)))
        .drop("_c", "_w")
    )


def latest_position(inventory: DataFrame) -> DataFrame:
    """JN-6: most recent snapshot per SKU."""
    rest = [c for c in inventory.columns if c != "sku_id"]
    latest = inventory.groupBy("sku_id").agg(F.max_by(F.struct(*rest), "date").alias("_r"))
    return latest.select("sku_id", "_r.*").withColumnRenamed("date", "inventory_as_of")


def latest_origin(predictions: DataFrame) -> DataFrame:
    """SRT-3: the most recent origin's row of every (SKU, target week)."""
    rest = [c for c in predictions.columns if c not in ("sku_id", "target_week")]
    best = predictions.groupBy("sku_id", "target_week").agg(
        F.max_by(F.struct(*rest), "origin_week").alias("_r")
    )
    return best.select("sku_id", "target_week", "_r.*")


def last_n_weeks(panel: DataFrame, n: int) -> DataFrame:
    """SRT-3: the last ``n`` rows of each SKU's series."""
    w = Window.partitionBy("sku_id").orderBy(F.desc("week_start"))
    return panel.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def top_n(df: DataFrame, column: str, n: int, key: str = "sku_id") -> DataFrame:
    """SRT-1: the ``n`` largest, ties by key."""
    return df.orderBy(F.desc(column), key).limit(n)


def page(df: DataFrame, order: list[Column], limit: int = 200, offset: int = 0) -> DataFrame:
    """SRT-2: one page of an ordered table."""
    return df.orderBy(*order).offset(offset).limit(limit)


def union_all(frames: list[DataFrame]) -> DataFrame:
    """SET-1."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def common_keys(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """SET-2."""
    return a.select(*key).intersect(b.select(*key))


def difference(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """SET-3: rows of ``a`` whose key is not in ``b``."""
    return a.join(b.select(*key), key, "left_anti")


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """SET-4 / AGG-18."""
    return df.select(column).distinct().orderBy(column)


def catalogue(master: DataFrame, category: str | None = None,
              search: str | None = None) -> DataFrame:
    """AGG-18 / FN-18: catalogue listing with optional filters."""
    out = master.select("sku_id", "category", "subcategory")
    if category:
        out = out.filter(S.same_text("category", category))
    if search:
        out = out.filter(S.has_text("sku_id", search) | S.has_text("subcategory", search))
    return out.orderBy("sku_id")


def normalise_ids(df: DataFrame, column: str = "sku_id", seq: str = "_row_seq") -> DataFrame:
    """QRY-5: trimmed, upper-cased, distinct ids in first-seen order."""
    ids = df.select(F.upper(F.trim(column)).alias("sku_id"), F.col(seq)).filter("sku_id <> ''")
    return ids.groupBy("sku_id").agg(F.min(seq).alias(seq)).orderBy(seq)
