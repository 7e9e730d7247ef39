"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of shuffled documents, served once per epoch.  A copy of a document
gets virtual tags: the words of its source before and after it, divided by the source's
target.  The copies are range-sorted by finish tag over the whole cluster and the stream is
cut at the budget.  Fair queueing shares a fluid: at the cut, which is virtual time 1, every
source has been served its target, and the copy then in service has been served in part.

Running sums never gather a source in one task: rows are range-partitioned by (source,
shuffle key), each (partition, source) hands on one sum, and windows stay inside those cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import parts, stored

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
EPOCHS = 3


def running(df: DataFrame, group: str, order: list[str], value: str, name: str) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over the rows before, by (``group``, ``order``).

    The rows are range-sorted and written, so partition numbers stay what they are.
    """
    placed = stored(df.repartitionByRange(parts(df.sparkSession), group, *order)
                    .withColumn("_pid", F.spark_partition_id()), "running")
    sums = placed.groupBy("_pid", group).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_pid", group, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    cell = Window.partitionBy("_pid", group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (placed.join(offsets, ["_pid", group])
            .withColumn(name, F.col("_offset") + F.coalesce(F.sum(value).over(cell), F.lit(0)))
            .drop("_pid", "_offset"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS,
            budget: int | None = None) -> DataFrame:
    """(source, rank, source_size, target) for a table (source, source_size).

    Sources by code point, null last, take the weights in turn.  A target stops at ``epochs``
    times its source's size and the excess is shared again by weight: the level ``t`` solves
    sum(min(weight * t, epochs * size)) = budget.  Each step is one aggregate row; the capped
    set only grows, so the steps end.
    """
    ordered = running(sizes.withColumn("_all", F.lit(0)).withColumn("_one", F.lit(1))
                      .withColumn("_null", F.col("source").isNull()), "_all", ["_null", "source"], "_one", "rank")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = stored(ordered.select("source", F.col("rank").cast("long"), "source_size",
                                   weight.cast("double").alias("weight"),
                                   (F.col("source_size") * epochs).cast("double").alias("most")), "sources")
    if budget is None:
        budget = ranked.agg(F.sum("source_size").alias("n")).first()["n"] or 0
    level = 0.0
    while True:
        full = F.col("most") <= F.col("weight") * F.lit(level)
        row = ranked.agg(F.sum(F.when(full, F.col("most"))).alias("spent"),
                         F.sum(F.when(~full, F.col("weight"))).alias("open")).first()
        if not row["open"]:
            break
        new = (budget - (row["spent"] or 0.0)) / row["open"]
        if new <= level:
            break
        level = new
    return ranked.select("source", "rank", "source_size",
                         F.least("most", F.col("weight") * F.lit(level)).alias("target"))


def count_words(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, budget: int | None = None,
        seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """(documents, stream) of the mixture of ``docs`` (doc_id, source, text; other columns are ignored).

    documents: one row per row of ``docs``: doc_id, source, size, source_size, target, taken.
    stream: one row per served copy: doc_id, epoch, words served, finish tag, position in the
    mixed stream.  Null or blank text has size 0 and is never served.  Null is a source of its
    own.  Rows that repeat are documents of their own.  An empty table gives empty tables.
    The order within a source is a keyed hash of (doc_id, size), so reruns agree; rows alike
    in source, doc_id and size are interchangeable.
    """
    rows = stored(docs.select("doc_id", "source", count_words("text").alias("size"))
                  .withColumn("_row", F.monotonically_increasing_id()), "sizes")
    aims = stored(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, epochs, budget), "targets")
    total = budget if budget is not None else (aims.agg(F.sum("source_size").alias("n")).first()["n"] or 0)
    lines = rows.join(aims.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))) \
        .drop("_source").withColumn("_key", F.xxhash64("doc_id", "size", F.lit(seed)))
    queued = stored(running(lines, "rank", ["_key", "doc_id", "size", "_row"], "size", "_before"), "queued")
    limit = F.round("target").cast("long")
    start = F.col("epoch") * F.col("source_size") + F.col("_before")
    served = F.greatest(F.lit(0), F.least(F.col("size"), limit - start))
    copies = (queued.where("size > 0").withColumn("epoch", F.explode(F.array(*[F.lit(i).cast("long") for i in range(epochs)])))
              .withColumn("served", served).where("served > 0")
              .select("_row", "doc_id", "epoch", "served", "rank", F.lit(0).alias("_all"),
                      ((start + F.col("size")) / F.col("target")).alias("finish")))
    placed = running(copies, "_all", ["finish", "rank", "_row", "epoch"], "served", "position")
    stream = stored(placed.withColumn("served", F.least(F.col("served"), F.lit(total) - F.col("position")))
                    .where("served > 0").drop("_all", "rank"), "stream")
    taken = stream.groupBy("_row").agg(F.sum("served").alias("taken"))
    documents = (queued.join(taken, "_row", "left")
                 .select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")))
    return documents, stream.drop("_row")
