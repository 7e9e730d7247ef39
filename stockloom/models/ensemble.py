"""Demand regimes, TSB smoothing, seasonal profile and blending (ENS-*, BLD-*, SEA-1)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockloom.contracts import DEFAULTS, InsufficientHistoryError, Settings
from stockloom.functions import scalar as S
from stockloom.operators.features import series
from stockloom.operators.lookup import POOLED, lookup_seasonal
from stockloom.session import cut, small_side

# Thresholds and constants of the blend.
COMPONENTS = ("gbm", "tsb", "seasonal_profile")
TSB_ALPHA = 0.12
TSB_BETA = 0.06
SEED_WEEKS = 26
VALIDATION_WEEKS = 12
NEW_WEEKS = 26
INTERMITTENT_SHARE = 0.35
VOLATILE_CV = 0.80
LEAST_ROWS = 30
TICKS = 10
RATIO_BOUNDS = (0.2, 5.0)
PROFILE_WEEKS = 13
BARRED = {"new": ("tsb",)}


def regime() -> Column:
    """ENS-1: new, then intermittent, then volatile, then steady."""
    zero = F.lit(0.0)
    return (
        F.when(F.coalesce("weeks_since_launch", F.lit(0)) < NEW_WEEKS, "new")
        .when(F.coalesce("zero_frac_26", zero) >= INTERMITTENT_SHARE, "intermittent")
        .when(F.coalesce("cv_13", zero) >= VOLATILE_CV, "volatile")
        .otherwise("steady")
    )


def assign_regime(df: DataFrame) -> DataFrame:
    return df.withColumn("regime", regime())


def tsb_levels(panel: DataFrame, alpha: float = TSB_ALPHA, beta: float = TSB_BETA,
               whole_series_seed: bool = False) -> DataFrame:
    """ENS-2: smoothed size times smoothed sale probability, known at each week.

    Both recursions are linear, so each state is a running sum with a geometric
    weight: ``s_n = (1-a)^n (s_0 + sum a y_i (1-a)^-i)``.  Size is updated on sale
    weeks only, so its exponent counts sales.  The weights stay within a double for
    series of about 5,000 sale weeks, a century.

    The start values come from the first 26 weeks; ``whole_series_seed`` uses the
    whole series instead, which lets early levels see later weeks.
    """
    whole, grow = Window.partitionBy("sku_id"), series().rowsBetween(Window.unboundedPreceding, 0)
    sold = F.col("units") > 0
    out = panel.select("sku_id", "week_start", "units").withColumns(
        {"_t": F.row_number().over(series()), "_n": F.sum(sold.cast("long")).over(grow)}
    )
    head = F.lit(True) if whole_series_seed else F.col("_t") <= SEED_WEEKS
    size, chance = F.lit(1.0 - alpha), F.lit(1.0 - beta)
    out = out.withColumns(
        {
            "_z0": F.coalesce(
                F.avg(F.when(head & sold, F.col("units"))).over(whole), F.lit(0.0)
            ),
            "_p0": F.avg(F.when(head, sold.cast("double"))).over(whole),
            "_z": F.sum(
                F.when(sold, F.col("units") * alpha / F.pow(size, F.col("_n"))).otherwise(0.0)
            ).over(grow),
            "_p": F.sum(
                F.when(sold, F.lit(beta) / F.pow(chance, F.col("_t"))).otherwise(0.0)
            ).over(grow),
        }
    )
    z = F.pow(size, F.col("_n")) * (F.col("_z0") + F.col("_z"))
    p = F.pow(chance, F.col("_t")) * (F.col("_p0") + F.col("_p"))
    return out.select("sku_id", "week_start", (z * p).alias("tsb_level"))


def fit_seasonal_profile(train: DataFrame) -> tuple[DataFrame, DataFrame]:
    """ENS-3: index per category and ISO week, and per ISO week overall.

    Means over training targets; rows are horizon-expanded, so a week counts once
    per (origin, horizon) that reaches it.
    """
    cells = train.groupBy("category", S.iso_week("target_week").alias("iso_week")).agg(
        F.sum("y").alias("_s"), F.count("y").alias("_n")
    )
    w = Window.partitionBy("category")  # at most 53 rows
    mean = F.sum("_s").over(w) / F.sum("_n").over(w)
    by_category = (
        cells.withColumn("_mean", mean)
        .filter(F.col("_mean") > 1e-9)
        .select("category", "iso_week", (F.col("_s") / F.col("_n") / F.col("_mean")).alias("index"))
    )
    weeks = cells.groupBy("iso_week").agg(F.sum("_s").alias("_s"), F.sum("_n").alias("_n"))
    grand = weeks.agg((F.sum("_s") / F.sum("_n")).alias("_mean"))
    by_week = (
        weeks.crossJoin(F.broadcast(grand))  # one row
        .filter(F.col("_mean") > 1e-9)
        .select("iso_week", (F.col("_s") / F.col("_n") / F.col("_mean")).alias("index"))
    )
    return by_category, by_week


def seasonal_index_table(by_category: DataFrame, by_week: DataFrame) -> DataFrame:
    """SEA-1: the profile as one product table."""
    return by_category.unionByName(
        by_week.select(F.lit("__GLOBAL__").alias("category"), "iso_week", "index")
    )


def origin_index(df: DataFrame, by_category: DataFrame, by_week: DataFrame) -> DataFrame:
    """ENS-4: mean index of the 13 weeks to each (category, origin week).

    Computed once per distinct pair, a few thousand rows, not per forecast row.
    """
    pairs = df.select("category", "week_start").distinct()
    weeks = pairs.withColumn(
        "_i", F.explode(F.sequence(F.lit(0), F.lit(PROFILE_WEEKS - 1)))
    ).withColumn("_iso", S.iso_week(F.date_sub("week_start", F.col("_i") * 7)))
    looked = lookup_seasonal(weeks, by_category, by_week, "_iso", "_x")
    return looked.groupBy("category", "week_start").agg(F.avg("_x").alias("origin_index"))


def seasonal_profile_predict(df: DataFrame, profile: tuple[DataFrame, DataFrame]) -> DataFrame:
    """ENS-4: own level, re-seasonalised by the category's profile."""
    by_category, by_week = profile
    index = origin_index(df, by_category, by_week)
    out = lookup_seasonal(
        df.withColumn("_iso", S.iso_week("target_week")), by_category, by_week, "_iso", "_target"
    ).join(small_side(index), ["category", "week_start"], "left")
    level = F.coalesce("units_roll_mean_13", "units_roll_mean_4", F.lit(0.0))
    base = F.when(F.col("origin_index") > 1e-9, F.col("origin_index")).otherwise(1.0)
    value = S.clip(level * S.clip(F.col("_target") / base, *RATIO_BOUNDS), low=0.0)
    return out.withColumn("seasonal_profile", value).drop("_iso", "_target", "origin_index")


def tsb_predict(df: DataFrame, levels: DataFrame) -> DataFrame:
    """The TSB level at the origin, else the 4-week mean."""
    return (
        df.join(levels, ["sku_id", "week_start"], "left")
        .withColumn(
            "tsb",
            F.greatest(F.coalesce("tsb_level", "units_roll_mean_4", F.lit(0.0)), F.lit(0.0)),
        )
        .drop("tsb_level")
    )


def simplex(components: int = 3, ticks: int = TICKS) -> list[tuple[float, ...]]:
    """Every convex weight vector on the grid, in search order."""
    def extend(prefix: tuple[int, ...], left: int, slots: int):
        if slots == 1:
            yield (*prefix, left)
            return
        for take in range(left + 1):
            yield from extend((*prefix, take), left - take, slots - 1)

    return [tuple(v / ticks for v in w) for w in extend((), ticks, components)]


def blend_errors(validation: DataFrame, components: Sequence[str], by: str | None) -> DataFrame:
    """Error of every weight vector per group: ``group, w_id, rows, abs_error, demand``.

    The 66 errors of a row are added up inside one aggregation (66 sums), so the
    validation rows are neither multiplied nor shuffled.
    """
    grid = simplex(len(components))
    group = F.col(by) if by else F.lit(POOLED)
    sums = []
    for i, weights in enumerate(grid):
        mixed = sum((F.col(c) * w for c, w in zip(components, weights) if w > 0), F.lit(0.0))
        sums.append(F.sum(F.abs(F.col("y") - mixed)).alias(f"e{i}"))
    wide = validation.groupBy(group.alias("group")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.abs("y")).alias("demand"), *sums
    )
    entries = [
        F.struct(
            F.lit(i).alias("w_id"),
            *[F.lit(w).alias(c) for c, w in zip(components, weights)],
            F.col(f"e{i}").alias("abs_error"),
        )
        for i, weights in enumerate(grid)
    ]
    return wide.select("group", "rows", "demand", F.inline(F.array(*entries)))


def fit_blend(validation: DataFrame, components: Sequence[str] = COMPONENTS,
              by: str | None = None, pooled: bool = False, barred: dict | None = None,
              default: Sequence[float] = (1.0, 0.0, 0.0)) -> DataFrame:
    """ENS-5, BLD-1, BLD-2: the weights with the lowest WAPE per group.

    Ties go to the earlier grid point.  Groups under 30 rows take ``default``, or
    the pooled weights when ``pooled``.
    """
    errors = blend_errors(validation, components, by).filter(F.col("demand") > 1e-12)
    for name, names in (barred or {}).items():
        for c in names:
            errors = errors.filter((F.col("group") != name) | (F.col(c) == 0.0))
    if by:
        enough = errors.filter(F.col("rows") >= LEAST_ROWS)
        if pooled:
            enough = enough.unionByName(blend_errors(validation, components, None))
    else:
        enough = errors
    wape = F.col("abs_error") / F.col("demand")
    best = enough.groupBy("group", "rows").agg(
        F.min_by(F.struct(*components, wape.alias("wape")), F.struct(wape, "w_id")).alias("_b")
    ).select("group", "rows", "_b.*")
    if not by or pooled:
        return best
    thin = errors.filter(F.col("rows") < LEAST_ROWS).select("group", "rows").distinct().select(
        "group", "rows", *[F.lit(d).alias(c) for c, d in zip(components, default)],
        F.lit(None).cast("double").alias("wape"),
    )
    return best.unionByName(thin)


def blend(df: DataFrame, weights: DataFrame, components: Sequence[str] = COMPONENTS,
          by: str | None = "regime", name: str = "ensemble",
          default: Sequence[float] = (1.0, 0.0, 0.0)) -> DataFrame:
    """ENS-7: weighted sum of the components by the row's group."""
    cols = [F.col(c).alias(f"_w_{c}") for c in components]
    own = weights.filter(F.col("group") != POOLED)
    pooled = weights.filter(F.col("group") == POOLED)
    out = df
    if by:
        out = out.join(small_side(own.select(F.col("group").alias(by), *cols)), by, "left")
    else:
        out = out.withColumns({f"_w_{c}": F.lit(None).cast("double") for c in components})
    spare = pooled.agg(*[F.max(c).alias(f"_q_{c}") for c in components])
    out = out.crossJoin(F.broadcast(spare))  # one row
    mixed = sum(
        (
            F.coalesce(F.col(f"_w_{c}"), F.col(f"_q_{c}"), F.lit(float(d))) * F.col(c)
            for c, d in zip(components, default)
        ),
        F.lit(0.0),
    )
    return out.withColumn(name, F.greatest(mixed, F.lit(0.0))).drop(
        *[f"_w_{c}" for c in components], *[f"_q_{c}" for c in components]
    )


def interval_scale(validation: DataFrame, target: float = 0.8, point: str = "ensemble",
                   low: str = "low_gap", high: str = "high_gap") -> DataFrame:
    """ENS-6: smallest width factor in 0.50, 0.55 .. 5.00 that reaches ``target``.

    The 91 coverages are 91 counts of one pass, not 91 copies of the rows.
    """
    grid = [0.5 + 0.05 * i for i in range(91)]
    y, p = F.col("y"), F.col(point)
    counts = validation.agg(
        F.count(F.lit(1)).alias("n"),
        *[
            F.count_if((y >= p - F.col(low) * s) & (y <= p + F.col(high) * s)).alias(f"k{i}")
            for i, s in enumerate(grid)
        ],
    )
    rows = F.array(
        *[F.struct(F.lit(s).alias("scale"), F.col(f"k{i}").alias("k")) for i, s in enumerate(grid)]
    )
    listed = counts.select("n", F.inline(rows))
    return listed.agg(
        F.coalesce(
            F.min(F.when(F.col("k") >= F.lit(target) * F.col("n"), F.col("scale"))), F.lit(5.0)
        ).alias("interval_scale")
    )


def recentre(df: DataFrame, scale: float, point: str = "ensemble") -> DataFrame:
    """ENS-7: the component interval around the blended point, widened by ``scale``."""
    low = F.greatest(F.col("gbm") - F.col("prediction_lower"), F.lit(0.0)) * scale
    high = F.greatest(F.col("prediction_upper") - F.col("gbm"), F.lit(0.0)) * scale
    return df.withColumns(
        {
            f"{point}_lower": F.greatest(F.col(point) - low, F.lit(0.0)),
            f"{point}_upper": F.col(point) + high,
        }
    )


def validation_split(supervised: DataFrame, weeks: int = VALIDATION_WEEKS):
    """ENS-8: the last 12 target weeks are held out for weights and width."""
    last = supervised.agg(F.max("target_week").alias("m")).first()["m"]
    if last is None:
        raise InsufficientHistoryError("no training rows")
    start = F.date_sub(F.lit(last), weeks * 7)
    return (
        supervised.filter(F.col("target_week") <= start),
        supervised.filter(F.col("target_week") > start),
    )


class Ensemble:
    """ENS-8: component models with per-regime weights and a calibrated width.

    ``fit_point(train)`` returns an object with ``predict(rows)`` giving
    ``prediction`` (and, if available, ``prediction_lower``/``prediction_upper``).
    """

    def __init__(self, point, profile, levels, weights: DataFrame, scale: float, quantiles=None):
        self.point, self.profile, self.levels = point, profile, levels
        self.weights, self.scale, self.quantiles = weights, scale, quantiles

    def components(self, df: DataFrame, scored: DataFrame | None = None) -> DataFrame:
        from stockloom.models.trees import residual_interval

        # The model's own columns make a long plan; its scores are written once.
        out = cut(assign_regime(self.point.predict(df))) if scored is None else scored
        if "prediction_lower" not in out.columns:
            out = residual_interval(out, self.quantiles, ["regime", "horizon"])
        out = out.withColumnRenamed("prediction", "gbm")
        return seasonal_profile_predict(tsb_predict(out, self.levels), self.profile)

    def predict(self, df: DataFrame) -> DataFrame:
        out = recentre(blend(self.components(df), self.weights), self.scale)
        return out.withColumnsRenamed(
            {"prediction_lower": "gbm_lower", "prediction_upper": "gbm_upper"}
        ).withColumnsRenamed(
            {"ensemble": "prediction", "ensemble_lower": "prediction_lower",
             "ensemble_upper": "prediction_upper"}
        )


def fit_ensemble(train: DataFrame, panel: DataFrame, fit_point, settings: Settings = DEFAULTS,
                 point=None, scoring=None) -> Ensemble:
    """ENS-8: fit everything on a training window.

    ``point`` is a point model already fitted on all of ``train`` and ``scoring`` one fitted on
    its part before the validation weeks; a backtest that has them hands them over, so the
    ensemble is judged on exactly the models that its own row reports.  Without a validation
    window, or with nothing before it, the point model alone is served at its own width.
    """
    from stockloom.models.trees import residual_quantiles

    fit_rows, held = validation_split(train)
    bare = fit_rows.isEmpty() or held.isEmpty()
    if bare:
        fit_rows = held = train
    last = train.agg(F.max("week_start").alias("m")).first()["m"]
    levels = cut(tsb_levels(panel.filter(F.col("week_start") <= F.lit(last))))
    # At most 53 weeks for each category: written, so nothing stays in memory after the fit.
    profile = tuple(cut(t) for t in fit_seasonal_profile(fit_rows))
    point = point or fit_point(train)
    scoring = point if bare else scoring or fit_point(fit_rows)
    seen = cut(assign_regime(scoring.predict(held)))
    quantiles = cut(residual_quantiles(seen, ["regime", "horizon"], settings.interval_coverage))
    if bare:
        return Ensemble(point, profile, levels, _no_weights(train.sparkSession), 1.0, quantiles)
    draft = Ensemble(scoring, profile, levels, None, 1.0, quantiles)
    parts = cut(draft.components(held, seen))
    weights = cut(fit_blend(parts, by="regime", barred=BARRED))
    gaps = blend(parts, weights).withColumns(
        {
            "low_gap": F.greatest(F.col("gbm") - F.col("prediction_lower"), F.lit(0.0)),
            "high_gap": F.greatest(F.col("prediction_upper") - F.col("gbm"), F.lit(0.0)),
        }
    )
    scale = interval_scale(gaps, settings.interval_coverage).first()["interval_scale"]
    return Ensemble(point, profile, levels, weights, scale, quantiles)


def _no_weights(spark) -> DataFrame:
    """No group has weights of its own, so :func:`blend` gives every row the default."""
    columns = ", ".join(f"{c} double" for c in (*COMPONENTS, "wape"))
    return spark.createDataFrame([], f"group string, rows long, {columns}")
