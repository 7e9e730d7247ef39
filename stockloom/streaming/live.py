"""Streaming forms of the live re-score and the accuracy monitor (STR-*)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stockloom.contracts import DEFAULTS, Settings
from stockloom.functions import metrics as M
from stockloom.operators.risk import rescore

#: Weeks start on Monday; the epoch was a Thursday.
MONDAY_OFFSET = "4 days"


def latest_positions(stream: DataFrame) -> DataFrame:
    """The latest position of each SKU over all that has arrived.

    An event counts by its own time, in whichever batch it comes; repeats change nothing.
    The state is one row per SKU, so it follows the catalogue.
    """
    fields = [c for c in stream.columns if c not in ("sku_id", "event_id")]
    latest = stream.groupBy("sku_id").agg(
        F.max_by(F.struct(*fields), F.struct("event_time", "event_id")).alias("_p")
    )
    return latest.select("sku_id", "_p.*")


def stream_rescore(positions: DataFrame, stored: DataFrame, forecast: DataFrame,
                   master: DataFrame, out: str, checkpoint: str,
                   settings: Settings = DEFAULTS, trigger: dict | None = None) -> StreamingQuery:
    """STR-1: re-score the products whose stock moved.

    The forecast and the stored plan are static tables.  Each micro-batch scores the
    products that it touched at their latest position so far and writes them to
    ``out`` under the batch id, so a replayed batch overwrites itself.  The current
    state of a product is its row of the highest batch.  Positions of products that
    the stored plan does not hold go to ``out`` + ``_unknown``.
    """
    def score(batch: DataFrame, batch_id: int) -> None:
        named = batch.withColumn("sku_id", F.upper(F.trim("sku_id"))).persist()
        table = rescore(named, stored, forecast, master, settings, rank=False)
        table.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")
        scored = stored.select(F.col("sku_id").alias("_known"))
        strange = named.join(scored, F.col("sku_id") == F.col("_known"), "left").filter("_known is null")
        strange.drop("_known").write.mode("overwrite").parquet(f"{out}_unknown/batch_id={batch_id}")
        named.unpersist()

    writer = latest_positions(positions).writeStream.outputMode("update").foreachBatch(score)
    return (
        writer.option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def accuracy_windows(actuals: DataFrame, forecast: DataFrame,
                     watermark: str = "14 days") -> DataFrame:
    """STR-2: WAPE, bias and coverage per Monday week and category.

    Late actuals still count within the watermark; of several actuals for a SKU and
    week the last by ``event_time`` counts, so restatements and repeats count once.
    ``actuals`` has ``event_time`` (a time in the week), ``sku_id`` and ``units``; the
    same function serves a batch.
    """
    timed = actuals.withWatermark("event_time", watermark) if actuals.isStreaming else actuals
    week = F.window("event_time", "7 days", "7 days", MONDAY_OFFSET).alias("w")
    last = timed.groupBy(week, "sku_id").agg(F.max_by("units", "event_time").alias("units"))
    keyed = last.withColumn("target_week", F.col("w.start").cast("date"))
    scored = keyed.join(forecast, ["sku_id", "target_week"])
    _, relative = M.bias("units", "prediction")
    return (
        scored.groupBy("w", "category")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            M.wape("units", "prediction").alias("wape"),
            relative.alias("bias_relative"),
            M.coverage("units", "prediction_lower", "prediction_upper").alias("coverage"),
        )
        .select(F.col("w.start").cast("date").alias("week_start"), "category", "rows", "wape",
                "bias_relative", "coverage")
    )


def stream_accuracy(actuals: DataFrame, forecast: DataFrame, out: str, checkpoint: str,
                    watermark: str = "14 days", trigger: dict | None = None) -> StreamingQuery:
    """STR-2 as a running query; a week is written once its watermark has passed."""
    return (
        accuracy_windows(actuals, forecast, watermark)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
