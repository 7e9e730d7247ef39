"""The cleaning audit trail (AUD-*).

A cleaning step registers *how to count* the rows it touched, as an aggregate
over the frame it worked on.  :meth:`AuditTrail.to_df` runs one aggregate per
frame (all its decisions share the pass) and turns the counts into rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockloom.contracts import SEVERITY_ORDER
from stockloom.session import cut

AUDIT_SCHEMA = T.StructType(
    [
        T.StructField("table", T.StringType()),
        T.StructField("issue", T.StringType()),
        T.StructField("detection", T.StringType()),
        T.StructField("rows_affected", T.LongType()),
        T.StructField("resolution", T.StringType()),
        T.StructField("rationale", T.StringType()),
        T.StructField("severity", T.StringType()),
    ]
)


@dataclass
class AuditTrail:
    """Decisions in the order they were taken."""

    notes: list[dict] = field(default_factory=list)

    def add(
        self,
        table: str,
        issue: str,
        frame: DataFrame,
        rows: Column,
        detection: str,
        resolution: str,
        rationale: str,
        severity: str = "info",
    ) -> None:
        """``{n}`` in ``issue`` stands for the counted rows."""
        self.notes.append(
            dict(table=table, issue=issue, frame=frame, rows=rows, detection=detection,
                 resolution=resolution, rationale=rationale, severity=severity)
        )

    def to_df(self, spark: SparkSession) -> DataFrame:
        """One row per decision that touched at least one row."""
        if not self.notes:
            return spark.createDataFrame([], AUDIT_SCHEMA)
        by_frame: dict[int, list[tuple[int, dict]]] = {}
        for order, note in enumerate(self.notes):
            by_frame.setdefault(id(note["frame"]), []).append((order, note))
        parts = []
        for group in by_frame.values():
            # One row, counted now: the shuffles of one frame are gone before the next is counted.
            counts = cut(group[0][1]["frame"].agg(
                *[F.coalesce(n["rows"], F.lit(0)).cast("long").alias(f"c{i}") for i, n in group]
            ))
            entries = [
                F.struct(
                    F.lit(i).alias("step"),
                    F.lit(n["table"]).alias("table"),
                    F.replace(
                        F.lit(n["issue"]), F.lit("{n}"), F.col(f"c{i}").cast("string")
                    ).alias("issue"),
                    F.lit(n["detection"]).alias("detection"),
                    F.col(f"c{i}").alias("rows_affected"),
                    F.lit(n["resolution"]).alias("resolution"),
                    F.lit(n["rationale"]).alias("rationale"),
                    F.lit(n["severity"]).alias("severity"),
                )
                for i, n in group
            ]
            parts.append(counts.select(F.inline(F.array(*entries))))
        rows = reduce(DataFrame.unionByName, parts)
        return rows.filter("rows_affected > 0").orderBy("step").drop("step")


def by_severity(audit: DataFrame) -> DataFrame:
    """AUD-2: most severe first, then most rows."""
    rank = F.lit(3)
    for name, order in SEVERITY_ORDER.items():
        rank = F.when(F.col("severity") == name, order).otherwise(rank)
    return audit.orderBy(rank, F.desc("rows_affected"), "table", "issue")


def audit_totals(audit: DataFrame) -> DataFrame:
    """AUD-2: rows touched in total and the number of critical decisions."""
    return audit.agg(
        F.count(F.lit(1)).alias("decisions"),
        F.coalesce(F.sum("rows_affected"), F.lit(0)).alias("rows_touched"),
        F.count_if(F.col("severity") == "critical").alias("critical"),
    )
