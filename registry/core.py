"""Registration of queries and their equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockloom.sources.retail import Retail

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, dir)``; ``sql`` is the same result in plain SQL."""

    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def fx(column, places: int):
    """Half-up rounding that both engines compute alike, ties nudged upwards."""
    c = F.col(column) if isinstance(column, str) else column
    scale = float(10**places)
    return F.floor(c * F.lit(scale) + F.lit(0.500001)) / F.lit(scale)


def rounded(df: DataFrame, **places: int) -> DataFrame:
    """Round the named columns."""
    return df.withColumns({c: fx(c, n) for c, n in places.items()})


def q(expr: str, places: int) -> str:
    """:func:`fx` as SQL."""
    return f"(floor(({expr})*1e{places}+0.500001)/1e{places})"


def style(spark: SparkSession, d: str) -> Retail:
    return Retail(spark, d, "style")


def part(spark: SparkSession, d: str) -> Retail:
    return Retail(spark, d, "part")
