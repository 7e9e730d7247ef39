"""History features, horizon expansion and the leakage gate (WIN-*, GATE-1).

All windows are partitioned by ``sku_id`` and ordered by ``week_start``, so Spark
plans them behind a single exchange and sort.  A window covers one SKU's weekly
series, which is bounded by the weeks of history.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockloom.contracts import InsufficientHistoryError, LeakageError
from stockloom.functions import scalar as S
from stockloom.operators.panel import DRIVER_DEFAULTS
from stockloom.session import small_side

# The feature vocabulary.
LAGS = (0, 1, 2, 3, 4, 8, 13, 26, 52)
ROLLS = (4, 8, 13, 26, 52)
SEASON_WEEKS = 52

ORIGIN_NUMERIC = (
    *(f"units_lag_{k}" for k in LAGS),
    *(f"units_roll_mean_{w}" for w in ROLLS),
    *(f"units_roll_std_{w}" for w in ROLLS),
    "units_roll_max_13", "zero_frac_8", "zero_frac_26", "trend_ratio_4_13",
    "trend_ratio_13_52", "cv_13", "avg_price", "price_roll_mean_4", "price_vs_list",
    "discount_depth", "gross_margin_per_unit", "unit_cost", "list_price",
    "promo_days_roll_4", "promo_days_roll_13", "weeks_since_launch",
)
TARGET_NUMERIC = (
    "horizon", "units_seasonal_lag", "target_week_sin", "target_week_cos", "target_month",
    "target_holiday_days", "target_has_promo_event",
)
DRIVER_ORIGIN = (
    "media_spend_roll_4", "media_spend_roll_13", "sessions_roll_4", "sessions_roll_13",
    "add_to_cart_roll_4", "discount_roll_4", "sessions_trend_4_13", "cart_conversion_4",
    "units_per_session_4", "media_trend_4_13", "log_media_spend", "competitor_price_index",
    "weather_anomaly",
)
DRIVER_TARGET = ("target_media_spend_log", "target_media_ratio", "target_planned_discount")
CATEGORICAL = ("category", "subcategory")
OBSERVED = (
    "units", "avg_price", "revenue", "promo_days", "sessions", "add_to_cart", "discount_pct",
    "media_spend", "impressions", "email_sends", "competitor_price_index", "weather_anomaly",
)


@dataclass(frozen=True)
class FeatureSpec:
    """WIN-13: the columns a model was trained on."""

    numeric: tuple[str, ...]
    categorical: tuple[str, ...] = CATEGORICAL

    @property
    def columns(self) -> tuple[str, ...]:
        return self.numeric + self.categorical


def feature_spec(use_drivers: bool = False) -> FeatureSpec:
    extra = DRIVER_ORIGIN + DRIVER_TARGET if use_drivers else ()
    return FeatureSpec(ORIGIN_NUMERIC + TARGET_NUMERIC + extra)


def series() -> Window:
    return Window.partitionBy("sku_id").orderBy("week_start")


def trailing(weeks: int) -> Window:
    return series().rowsBetween(-(weeks - 1), 0)


def rolled(agg: Callable[[Column], Column], value: str | Column, weeks: int,
           least: int) -> Column:
    """``agg`` over the last ``weeks`` rows, null below ``least`` observations."""
    w = trailing(weeks)
    value = S.col(value)
    return F.when(F.count(value).over(w) >= least, agg(value).over(w))


def _least(weeks: int) -> int:
    return max(2, weeks // 4)


# A sliding frame re-adds its whole buffer for every row, so a 52-week mean costs 52
# additions a row.  Running totals cost one: the sum of the last w rows is the
# difference of two running totals.  Units are whole numbers, for which these sums
# (and sums of squares) are exact in a double.
def running_totals(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Add ``_rn`` and one running total ``_cs_<name>`` per value."""
    grow = series().rowsBetween(Window.unboundedPreceding, 0)
    out = {"_rn": F.row_number().over(series())}
    for name, value in values.items():
        out[f"_cs_{name}"] = F.sum(value.cast("double")).over(grow)
    return df.withColumns(out)


def last_sum(name: str, weeks: int) -> Column:
    total = F.col(f"_cs_{name}")
    return total - F.coalesce(F.lag(total, weeks).over(series()), F.lit(0.0))


def last_rows(weeks: int) -> Column:
    return F.least(F.col("_rn"), F.lit(weeks))


def last_mean(name: str, weeks: int, least: int) -> Column:
    n = last_rows(weeks)
    return F.when(n >= least, last_sum(name, weeks) / n)


def drop_totals(df: DataFrame) -> DataFrame:
    return df.drop("_rn", *[c for c in df.columns if c.startswith("_cs_")])


def add_lags(panel: DataFrame) -> DataFrame:
    """WIN-1."""
    return panel.withColumns({f"units_lag_{k}": F.lag("units", k).over(series()) for k in LAGS})


def add_rolling(panel: DataFrame) -> DataFrame:
    """WIN-2, WIN-3, WIN-4."""
    units = F.col("units")
    out = running_totals(
        panel,
        {"u": units, "q": units * units, "z": F.when(units <= 0, 1.0).otherwise(0.0)},
    )
    cols: dict[str, Column] = {}
    for w in ROLLS:
        n, total, squares = last_rows(w), last_sum("u", w), last_sum("q", w)
        spread = F.greatest(squares - total * total / n, F.lit(0.0))
        cols[f"units_roll_mean_{w}"] = last_mean("u", w, _least(w))
        cols[f"units_roll_std_{w}"] = F.when(n >= _least(w), F.sqrt(spread / (n - 1)))
    cols["units_roll_max_13"] = rolled(F.max, "units", 13, 3)
    for w in (8, 26):
        cols[f"zero_frac_{w}"] = last_mean("z", w, _least(w))
    return drop_totals(out.withColumns(cols))


def add_shape(features: DataFrame) -> DataFrame:
    """WIN-5: over the rolling means of :func:`add_rolling`."""
    return features.withColumns(
        {
            "trend_ratio_4_13": S.ratio("units_roll_mean_4", "units_roll_mean_13"),
            "trend_ratio_13_52": S.ratio("units_roll_mean_13", "units_roll_mean_52"),
            "cv_13": S.ratio("units_roll_std_13", "units_roll_mean_13"),
        }
    )


def add_price_features(panel: DataFrame) -> DataFrame:
    """WIN-6."""
    vs_list = S.ratio("avg_price", "list_price")
    return panel.withColumns(
        {
            "price_roll_mean_4": rolled(F.avg, "avg_price", 4, 1),
            "price_vs_list": vs_list,
            "discount_depth": S.clip(F.lit(1.0) - vs_list, low=0.0),
            "gross_margin_per_unit": F.col("list_price") - F.col("unit_cost"),
        }
    )


def add_promo_history(panel: DataFrame) -> DataFrame:
    """WIN-7."""
    out = running_totals(panel, {"p": F.col("promo_days")})
    return drop_totals(
        out.withColumns({f"promo_days_roll_{w}": last_sum("p", w) for w in (4, 13)})
    )


def neutral_drivers(panel: DataFrame) -> DataFrame:
    return panel.withColumns(
        {
            c: (F.coalesce(F.col(c).cast("double"), F.lit(d)) if c in panel.columns else F.lit(d))
            for c, d in DRIVER_DEFAULTS.items()
        }
    )


def add_driver_features(features: DataFrame) -> DataFrame:
    """WIN-8: needs ``units_roll_mean_4``."""
    out = running_totals(
        neutral_drivers(features),
        {c: F.col(c) for c in ("media_spend", "sessions", "add_to_cart", "discount_pct")},
    )
    out = drop_totals(
        out.withColumns(
            {
                "media_spend_roll_4": last_mean("media_spend", 4, 1),
                "media_spend_roll_13": last_mean("media_spend", 13, 1),
                "sessions_roll_4": last_mean("sessions", 4, 1),
                "sessions_roll_13": last_mean("sessions", 13, 1),
                "add_to_cart_roll_4": last_mean("add_to_cart", 4, 1),
                "discount_roll_4": last_mean("discount_pct", 4, 1),
            }
        )
    )
    return out.withColumns(
        {
            "sessions_trend_4_13": S.ratio("sessions_roll_4", "sessions_roll_13"),
            "cart_conversion_4": S.ratio("add_to_cart_roll_4", "sessions_roll_4"),
            "units_per_session_4": S.ratio("units_roll_mean_4", "sessions_roll_4"),
            "media_trend_4_13": S.ratio("media_spend_roll_4", "media_spend_roll_13"),
            "log_media_spend": F.log1p(F.greatest(F.col("media_spend"), F.lit(0.0))),
        }
    )


def base_features(panel: DataFrame, use_drivers: bool = False) -> DataFrame:
    """Every origin-side feature of every SKU-week."""
    out = add_shape(add_rolling(add_lags(panel)))
    out = add_promo_history(add_price_features(out))
    return add_driver_features(out) if use_drivers else out


def attach_target_week(df: DataFrame, week_dim: DataFrame) -> DataFrame:
    """WIN-10: published attributes of the target week (one row per week, broadcast)."""
    dim = week_dim.select(
        F.col("week_start").alias("target_week"),
        F.col("week_sin").alias("target_week_sin"),
        F.col("week_cos").alias("target_week_cos"),
        F.col("month").alias("target_month"),
        F.col("holiday_days").alias("target_holiday_days"),
        F.col("has_promo_event").alias("target_has_promo_event"),
    )
    return df.join(small_side(dim), "target_week", "left")


def attach_target_drivers(df: DataFrame, plan: DataFrame | None,
                          week_dim: DataFrame) -> DataFrame:
    """WIN-11: committed spend and published discount of the target week."""
    out = df
    if plan is not None:
        committed = plan.select(
            "sku_id", F.col("week_start").alias("target_week"),
            F.col("media_spend").alias("target_media_spend"),
        )
        out = out.join(committed, ["sku_id", "target_week"], "left")
    spend = (
        F.coalesce(F.col("target_media_spend"), F.lit(0.0)) if plan is not None else F.lit(0.0)
    )
    published = small_side(
        week_dim.select(
            F.col("week_start").alias("target_week"),
            F.col("planned_discount").alias("target_planned_discount"),
        )
    )
    norm = (
        F.try_divide(spend + S.EPSILON, F.col("media_spend_roll_13") + S.EPSILON)
        if "media_spend_roll_13" in df.columns
        else F.lit(1.0)
    )
    return (
        out.withColumns(
            {
                "target_media_spend": spend,
                "target_media_spend_log": F.log1p(F.greatest(spend, F.lit(0.0))),
                "target_media_ratio": S.clip(norm, 0.0, 20.0),
            }
        )
        .join(published, "target_week", "left")
        .withColumn(
            "target_planned_discount", F.coalesce("target_planned_discount", F.lit(0.0))
        )
    )


def expand_horizons(base: DataFrame, horizons: Sequence[int], labelled: bool) -> DataFrame:
    """WIN-9: label and seasonal lag of each horizon in one pass, then one row each."""
    if not horizons:
        raise ValueError("horizons must not be empty")
    pairs = [
        F.struct(
            F.lit(int(h)).alias("horizon"),
            F.lead("units", int(h)).over(series()).alias("y"),
            F.lag("units", SEASON_WEEKS - int(h)).over(series()).alias("units_seasonal_lag"),
        )
        for h in horizons
    ]
    out = base.withColumn("_h", F.array(*pairs))
    out = out.withColumn("_h", F.explode("_h")).select(
        *[c for c in base.columns],
        F.col("_h.horizon").alias("horizon"),
        F.col("_h.y").alias("y"),
        F.col("_h.units_seasonal_lag").alias("units_seasonal_lag"),
    )
    out = out.withColumn("target_week", F.date_add("week_start", F.col("horizon") * 7))
    return out.filter(F.col("y").isNotNull()) if labelled else out


def supervised_frame(base: DataFrame, week_dim: DataFrame, horizons: Sequence[int],
                     use_drivers: bool = False, plan: DataFrame | None = None) -> DataFrame:
    """WIN-9/10/11: one labelled row per SKU, origin week and horizon."""
    out = attach_target_week(expand_horizons(base, horizons, labelled=True), week_dim)
    return attach_target_drivers(out, plan, week_dim) if use_drivers else out


def inference_frame(base: DataFrame, week_dim: DataFrame, origins, horizons: Sequence[int],
                    use_drivers: bool = False, plan: DataFrame | None = None,
                    check: bool = True) -> DataFrame:
    """WIN-12: unlabelled rows of one or several origins.

    The lags are windows over the whole series, so the origin filter comes after
    them and before the joins.
    """
    wanted = list(origins) if isinstance(origins, (list, tuple, set)) else [origins]
    at = F.col("week_start").isin(*wanted)
    if check and base.filter(at).limit(1).count() == 0:
        raise InsufficientHistoryError(f"no panel rows at origin {wanted[0]}")
    rows = expand_horizons(base, horizons, labelled=False).drop("y").filter(at)
    out = attach_target_week(rows, week_dim)
    return attach_target_drivers(out, plan, week_dim) if use_drivers else out


# --------------------------------------------------------------------------- #
# GATE-1
# --------------------------------------------------------------------------- #
def panel_weeks(panel: DataFrame) -> list:
    """The week list (one value per week of history) on the driver."""
    return [r[0] for r in panel.select("week_start").distinct().orderBy("week_start").collect()]


def corrupt_after(panel: DataFrame, cutoff) -> DataFrame:
    """Replace every observation after ``cutoff`` by hash noise on another scale."""
    after = F.col("week_start") > F.lit(cutoff)

    def noise(name: str) -> Column:
        digest = F.xxhash64(F.col("sku_id"), F.col("week_start"), F.lit(name))
        return F.lit(5000.0) + F.pmod(digest, F.lit(5_000_000)) / F.lit(1000.0)

    return panel.withColumns(
        {
            c: F.when(after, noise(c)).otherwise(F.col(c).cast("double"))
            for c in OBSERVED
            if c in panel.columns
        }
    )


def leakage_report(panel: DataFrame, week_dim: DataFrame, horizons: Sequence[int],
                   quantile: float = 0.7, use_drivers: bool = False,
                   plan: DataFrame | None = None,
                   build: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """One row per numeric feature: rows compared and rows that moved.

    Features at origins up to the cutoff are built twice, from the real panel and
    from one whose later observations are noise.  A value that moves was read from
    the future.
    """
    weeks = panel_weeks(panel)
    if len(weeks) < 10:
        raise InsufficientHistoryError("too few weeks for a leakage check")
    cutoff = weeks[int(len(weeks) * quantile)]
    make = build or (lambda p: base_features(p, use_drivers))
    names = [c for c in feature_spec(use_drivers).numeric]
    key = ["sku_id", "week_start", "horizon"]

    def rows(source: DataFrame) -> DataFrame:
        built = supervised_frame(make(source), week_dim, horizons, use_drivers, plan)
        return built.filter(F.col("week_start") <= F.lit(cutoff))

    honest, noisy = rows(panel), rows(corrupt_after(panel, cutoff))
    names = [c for c in names if c in honest.columns and c not in key]
    left = honest.select(*key, *[F.col(c).cast("double").alias(f"a_{c}") for c in names])
    right = noisy.select(*key, *[F.col(c).cast("double").alias(f"b_{c}") for c in names])

    def moved(c: str) -> Column:
        a, b = F.col(f"a_{c}"), F.col(f"b_{c}")
        close = F.abs(a - b) <= F.lit(1e-9) + F.lit(1e-9) * F.abs(b)
        return ~(F.coalesce(close, F.lit(False)) | (a.isNull() & b.isNull()))

    joined = left.join(right, key)
    counts = joined.agg(
        F.count(F.lit(1)).alias("rows_compared"),
        *[F.count_if(moved(c)).alias(f"m_{c}") for c in names],
    )
    return counts.select(
        "rows_compared",
        F.inline(
            F.array(
                *[F.struct(F.lit(c).alias("feature"), F.col(f"m_{c}").alias("rows_moved"))
                  for c in names]
            )
        ),
    ).select("feature", "rows_compared", "rows_moved")


def assert_no_leakage(panel: DataFrame, week_dim: DataFrame, horizons: Sequence[int],
                      **options) -> int:
    """Raise :class:`LeakageError` naming the offenders; return the rows compared."""
    report = leakage_report(panel, week_dim, horizons, **options).collect()
    if not report or report[0]["rows_compared"] == 0:
        raise InsufficientHistoryError("the leakage check compared no rows")
    offenders = sorted(r["feature"] for r in report if r["rows_moved"])
    if offenders:
        raise LeakageError("features read the future: " + ", ".join(offenders))
    return report[0]["rows_compared"]
