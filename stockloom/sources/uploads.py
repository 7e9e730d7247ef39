"""Files of actuals and forecasts with free header spellings (SRC-5..SRC-9)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockloom.contracts import DataQualityError
from stockloom.functions import scalar as S

# Accepted header spellings.
ALIASES = {
    "sku_id": (
        "sku_id", "sku", "skuid", "sku_code", "product", "product_id", "product_code", "item",
        "item_id", "item_code", "code", "article",
    ),
    "week_starting": (
        "week_starting", "week_start", "week", "date", "period", "week_beginning",
        "week_commencing", "week_ending", "week_of", "wc",
    ),
    "units": (
        "units", "units_sold", "unit_sold", "actual", "actuals", "actual_units", "demand", "qty",
        "qty_sold", "quantity", "quantity_sold", "sales", "sales_units", "sold", "volume",
    ),
}
TOKENS = {
    "sku_id": ("sku", "product", "item", "article", "code"),
    "week_starting": ("week", "date", "period", "month"),
    "units": ("unit", "qty", "quantity", "sold", "sales", "demand", "actual", "volume"),
}
FORECAST_VALUE = (
    "prediction", "predicted", "predicted_units", "forecast", "forecast_units", "forecast_qty",
    "yhat", "fcst", "expected_units",
)
FORECAST_LOWER = (
    "prediction_lower", "forecast_lower", "lower", "lower_bound", "lo", "p10",
)
FORECAST_UPPER = (
    "prediction_upper", "forecast_upper", "upper", "upper_bound", "hi", "p90",
)
FORECAST_HORIZON = ("horizon", "h", "weeks_ahead", "lead_weeks", "step")
FORECAST_TARGET = (
    "target_week", "target_date", "forecast_week", "week_starting", "week_start", "week", "date",
    "period",
)


def _headers(columns: Sequence[str]) -> dict[str, str]:
    return {
        c.strip().lower().replace(" ", "_").replace("-", "_"): c
        for c in columns
        if c != "_row_seq"
    }


def resolve_headers(columns: Sequence[str]) -> dict[str, str]:
    """SRC-5: canonical name -> column; exact spellings first, then parts of words."""
    known = _headers(columns)
    chosen: dict[str, str] = {}

    def free(header: str) -> bool:
        return known[header] not in chosen.values()

    for name, spellings in ALIASES.items():
        hits = [s for s in spellings if s in known and free(s)]
        if hits:
            chosen[name] = known[hits[0]]
    for name in ALIASES:
        if name in chosen:
            continue
        hits = [h for token in TOKENS[name] for h in known if token in h and free(h)]
        if hits:
            chosen[name] = known[hits[0]]
    missing = [name for name in ALIASES if name not in chosen]
    if missing:
        raise DataQualityError(
            f"no column for {', '.join(missing)}; found {', '.join(list(known.values())[:12])}"
        )
    return chosen


def classify_table(columns: Sequence[str]) -> str:
    """SRC-6: a predictive value column makes a forecast, anything else is actuals."""
    return "forecast" if any(h in FORECAST_VALUE for h in _headers(columns)) else "actuals"


def _number(column: str) -> Column:
    return S.to_number(F.col(column).cast("string"))


def _day(column: str) -> Column:
    return S.parse_dates(F.col(column).cast("string"), S.UPLOAD_DATE_LAYOUTS)


def parse_actuals(df: DataFrame) -> DataFrame:
    """SRC-7: readable rows only, ids upper-cased, returns clipped to zero."""
    chosen = resolve_headers(df.columns)
    rows = df.select(
        F.upper(F.trim(F.col(chosen["sku_id"]))).alias("sku_id"),
        _day(chosen["week_starting"]).alias("week_starting"),
        _number(chosen["units"]).alias("units"),
        *([F.col("_row_seq")] if "_row_seq" in df.columns else []),
    )
    return rows.dropna(subset=["sku_id", "week_starting", "units"]).withColumn(
        "units", F.greatest("units", F.lit(0.0))
    )


def parse_forecast(df: DataFrame) -> DataFrame:
    """SRC-8: one forecast per SKU and Monday week, the last row of the file wins."""
    known = _headers(df.columns)

    def pick(spellings: Sequence[str]) -> str | None:
        return next((known[s] for s in spellings if s in known), None)

    sku, week, value = pick(ALIASES["sku_id"]), pick(FORECAST_TARGET), pick(FORECAST_VALUE)
    missing = [
        label
        for label, c in (("a product", sku), ("a target week", week), ("a forecast", value))
        if c is None
    ]
    if missing:
        raise DataQualityError("the forecast has no column for " + ", ".join(missing))
    point = _number(value)
    horizon, low, high = pick(FORECAST_HORIZON), pick(FORECAST_LOWER), pick(FORECAST_UPPER)
    seq = F.col("_row_seq") if "_row_seq" in df.columns else F.monotonically_increasing_id()
    rows = df.select(
        F.upper(F.trim(F.col(sku))).alias("sku_id"),
        S.week_start(_day(week)).alias("target_week"),
        (F.coalesce(_number(horizon), F.lit(1.0)) if horizon else F.lit(1.0))
        .cast("long")
        .alias("horizon"),
        point.alias("prediction"),
        (F.coalesce(_number(low), point) if low else point).alias("prediction_lower"),
        (F.coalesce(_number(high), point) if high else point).alias("prediction_upper"),
        seq.alias("_seq"),
    ).dropna(subset=["sku_id", "target_week", "prediction"])
    rest = ["horizon", "prediction", "prediction_lower", "prediction_upper"]
    last = rows.groupBy("sku_id", "target_week").agg(
        F.max_by(F.struct(*rest), "_seq").alias("_r")
    )
    return last.select("sku_id", "target_week", "_r.*")


def combine_uploads(frames: Sequence[DataFrame]) -> tuple[DataFrame, DataFrame | None]:
    """SRC-9: all actuals as one, the last row of the last file wins; at most one forecast.

    Each file is reduced by its own sequence, whatever its type; a file without
    ``_row_seq`` is in the order of its scan.
    """
    actuals, forecast = None, None
    for i, df in enumerate(frames):
        if classify_table(df.columns) == "forecast":
            if forecast is not None:
                raise DataQualityError("two forecast files were supplied; one is allowed")
            forecast = parse_forecast(df)
            continue
        if "_row_seq" not in df.columns:
            df = df.withColumn("_row_seq", F.monotonically_increasing_id())
        part = parse_actuals(df).groupBy("sku_id", "week_starting").agg(
            F.max_by("units", "_row_seq").alias("units")
        ).withColumn("_file", F.lit(i))
        actuals = part if actuals is None else actuals.unionByName(part)
    if actuals is None:
        raise DataQualityError("only a forecast was supplied; add a file of actual demand")
    one = actuals.groupBy("sku_id", "week_starting").agg(F.max_by("units", "_file").alias("units"))
    return one, forecast
