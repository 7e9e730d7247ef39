"""Accuracy measures as aggregate Columns (MET-*).

Each function returns an aggregate expression, so any grouping, window or
streaming aggregation can use it and several measures share one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockloom.functions.scalar import col

_TINY = 1e-12


def _finite(*columns: Column) -> Column:
    ok = F.lit(True)
    for c in columns:
        ok = ok & c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    return ok


def _pair(a, p) -> tuple[Column, Column, Column]:
    a, p = col(a).cast("double"), col(p).cast("double")
    return a, p, _finite(a, p)


def wape(a, p) -> Column:
    """MET-1: sum of absolute errors over sum of absolute actuals; null on no demand."""
    a, p, ok = _pair(a, p)
    total = F.sum(F.when(ok, F.abs(a)))
    return F.try_divide(F.sum(F.when(ok, F.abs(a - p))), F.when(total > _TINY, total))


def mape(a, p) -> tuple[Column, Column]:
    """MET-2: mean absolute percentage error on non-zero actuals, and their share."""
    a, p, ok = _pair(a, p)
    usable = ok & (F.abs(a) > _TINY)
    value = F.avg(F.when(usable, F.abs(F.try_divide(a - p, a))))
    share = F.coalesce(
        F.try_divide(F.count_if(usable), F.count_if(ok)), F.lit(0.0)
    )
    return value, share


def bias(a, p) -> tuple[Column, Column]:
    """MET-3: mean signed error and the error as a share of demand."""
    a, p, ok = _pair(a, p)
    total = F.sum(F.when(ok, F.abs(a)))
    error = F.when(ok, p - a)
    return F.avg(error), F.try_divide(F.sum(error), F.when(total > _TINY, total))


def pinball(a, p, q: float) -> Column:
    """MET-4: quantile loss."""
    if not 0.0 < q < 1.0:
        raise ValueError("quantile must lie strictly between 0 and 1")
    a, p, ok = _pair(a, p)
    d = a - p
    return F.avg(F.when(ok, F.greatest(F.lit(q) * d, F.lit(q - 1.0) * d)))


def coverage(a, low, high) -> Column:
    """MET-5: share of actuals inside the interval."""
    a, low, high = (col(x).cast("double") for x in (a, low, high))
    ok = _finite(a, low, high)
    return F.avg(F.when(ok, ((a >= low) & (a <= high)).cast("double")))


def mae(a, p) -> Column:
    a, p, ok = _pair(a, p)
    return F.avg(F.when(ok, F.abs(p - a)))


def rmse(a, p) -> Column:
    a, p, ok = _pair(a, p)
    return F.sqrt(F.avg(F.when(ok, (p - a) * (p - a))))


def record(a, p) -> list[Column]:
    """MET-6: the full metric set as named aggregates."""
    x, y, ok = _pair(a, p)
    mape_value, mape_share = mape(a, p)
    bias_units, bias_relative = bias(a, p)
    return [
        F.count_if(ok).alias("n_observations"),
        F.sum(F.when(ok, x)).alias("total_actual"),
        F.sum(F.when(ok, y)).alias("total_predicted"),
        wape(a, p).alias("wape"),
        mape_value.alias("mape"),
        mape_share.alias("mape_coverage"),
        bias_units.alias("bias_units"),
        bias_relative.alias("bias_relative"),
        mae(a, p).alias("mae"),
        rmse(a, p).alias("rmse"),
    ]


def evaluate(df: DataFrame, a: str = "y", p: str = "prediction") -> DataFrame:
    """MET-6 over a whole frame."""
    return df.agg(*record(a, p))


def metrics_by(df: DataFrame, group, a: str = "y", p: str = "prediction") -> DataFrame:
    """MET-7: volume, WAPE and bias per group."""
    keys = [group] if isinstance(group, str) else list(group)
    bias_units, bias_relative = bias(a, p)
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_observations"),
        F.sum(col(a)).alias("total_actual"),
        wape(a, p).alias("wape"),
        bias_relative.alias("bias_relative"),
        bias_units.alias("bias_units"),
    )
