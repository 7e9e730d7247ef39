"""Prediction intervals by quantile trees: leaves from fitted trees, quantiles from held-out rows (FC-4).

MLlib has no quantile loss.  A small forest is fitted to the size of held-out errors, so its leaves
gather rows whose errors are alike; each leaf's exact error quantiles are then taken anew from the
held-out rows that fall into it, and a forecast gets the mean of its leaves' quantiles.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockloom.contracts import DEFAULTS, Settings
from stockloom.models.trees import Prepared, _inputs
from stockloom.operators.ranking import exact_percentile

#: Trees, their depth, and the fewest held-out rows of a leaf.
BAND_TREES, BAND_DEPTH, BAND_LEAF = 8, 5, 200


def _leaves(df: DataFrame, steps: Sequence, prepared: Prepared) -> DataFrame:
    """``df`` with ``_leaf``: the leaf number of each tree."""
    named = {c: f"_kept_{c}" for c in ("y", "prediction") if c in df.columns}
    rows = PipelineModel(list(steps)).transform(_inputs(df, prepared.spec).withColumnsRenamed(named))
    rows = rows.withColumn("_leaf", vector_to_array("leaf").cast("array<int>"))
    return rows.select(*[F.col(named.get(c, c)).alias(c) for c in df.columns], "_leaf")


class LeafBands:
    """Error quantiles of every leaf; ``table[tree]`` maps a leaf to (low, high)."""

    def __init__(self, steps: Sequence, prepared: Prepared, table: list[dict[int, tuple[float, float]]]):
        self.steps, self.prepared, self.table = steps, prepared, table

    def _mean(self, side: int) -> Column:
        looked = []
        for tree, leaves in enumerate(self.table):
            # At most 2**depth leaves a tree; one without held-out rows takes no part.
            values = [leaves[i][side] if i in leaves else None for i in range(max(leaves, default=0) + 1)]
            looked.append(F.get(F.array(*[F.lit(v).cast("double") for v in values]), F.get("_leaf", F.lit(tree))))
        known = F.filter(F.array(*looked), lambda x: x.isNotNull())
        total = F.aggregate(known, F.lit(0.0), lambda a, x: a + x)
        return F.when(F.size(known) > 0, total / F.size(known)).otherwise(0.0)

    def interval(self, scored: DataFrame) -> DataFrame:
        """``scored`` (with ``prediction``) and bounds, sorted so that lower <= point <= upper."""
        out = _leaves(scored, self.steps, self.prepared)
        p, zero = F.col("prediction"), F.lit(0.0)
        low, high = F.greatest(p + self._mean(0), zero), F.greatest(p + self._mean(1), zero)
        return out.withColumns({"prediction_lower": F.least(low, p, high), "prediction_upper": F.greatest(low, p, high)}).drop("_leaf")


def fit_bands(held: DataFrame, prepared: Prepared, coverage: float = 0.8, trees: int = BAND_TREES, depth: int = BAND_DEPTH,
              least: int = BAND_LEAF, settings: Settings = DEFAULTS) -> LeafBands:
    """Bands from held-out rows with ``y`` and ``prediction``, which the point model has not seen."""
    rows = held.withColumn("_r", F.col("y") - F.col("prediction"))
    sized = prepared.vectors(rows.withColumn("y", F.abs("_r"))).persist()
    forest = RandomForestRegressor(labelCol="y", numTrees=trees, maxDepth=depth, minInstancesPerNode=least, seed=settings.random_seed, leafCol="leaf")
    try:
        steps = [*prepared.steps(False), forest.fit(sized)]
    finally:
        sized.unpersist()
    cells = _leaves(rows, steps, prepared).select("_r", F.posexplode("_leaf").alias("tree", "leaf"))
    tail = (1.0 - coverage) / 2.0
    table: list[dict[int, tuple[float, float]]] = [{} for _ in range(trees)]
    low = exact_percentile(cells, ["tree", "leaf"], "_r", tail, "low", few_keys=True).drop("n")
    high = exact_percentile(cells, ["tree", "leaf"], "_r", 1.0 - tail, "high", few_keys=True).drop("n")
    for r in low.join(high, ["tree", "leaf"]).collect():  # trees * 2**depth rows at most
        table[r["tree"]][r["leaf"]] = (r["low"], r["high"])
    return LeafBands(steps, prepared, table)
