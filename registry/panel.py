"""Panel, features, gates, lookups and ordered reads."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from registry.cleaning import CONDITIONS_SQL, MARKETING_SQL, WEB_SQL
from registry.core import fx, part, q, query, rounded, style
from registry.sql import bias_sql, wape_sql, with_sql
from stockloom.contracts import DEFAULTS
from stockloom.functions import metrics as M
from stockloom.functions import scalar as S
from stockloom.models.baseline import fallback_rate
from stockloom.operators import cleaning as K
from stockloom.operators import features as X
from stockloom.operators import insights as I
from stockloom.operators import lookup as L
from stockloom.operators import panel as P
from stockloom.plans import backtest as B

H = DEFAULTS.horizons


def test_rows(R):
    """The rows of the last six origins with both baselines."""
    origins = B.backtest_origins(R.week_list)
    return B.model_free_frame(R.panel, R.weeks, origins, H)


@query(
    "baseline_wape_by_category",
    with_sql("style", "test", f"SELECT category, count(*) AS n_observations, sum(y) AS total_actual, {q(wape_sql('y', 'baseline'), 6)} AS baseline_wape, {q(wape_sql('y', 'naive'), 6)} AS naive_wape FROM test GROUP BY 1"),
)
def baseline_wape_by_category(spark, d):
    out = B.breakdowns(test_rows(style(spark, d)), ["baseline", "naive"], "category")
    return rounded(out, baseline_wape=6, naive_wape=6)


_PANEL = (f"SELECT sku_id, week_start, units, {q('revenue', 2)} AS revenue, {q('avg_price', 3)} AS avg_price, promo_days, holiday_days, category, subcategory, "
          "unit_cost, list_price, launch_date, weeks_since_launch, is_post_launch FROM {t}")


@query("panel_weekly", with_sql("style", "panel_daily", _PANEL.format(t="panel_daily")))
def panel_weekly(spark, d):
    return rounded(style(spark, d).panel, revenue=2, avg_price=3)


@query("panel_weekly_parts", with_sql("part", "panel_daily", "SELECT year(week_start) AS year, category, count(*) AS rows, sum(units) AS units, "
       f"sum(promo_days) AS promo_days, {q('sum(avg_price)', 1)} AS avg_price FROM panel_daily GROUP BY 1,2"))
def panel_weekly_parts(spark, d):
    out = part(spark, d).panel.groupBy(F.year("week_start").alias("year"), "category").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("units").alias("units"),
        F.sum("promo_days").alias("promo_days"), F.sum("avg_price").alias("avg_price"),
    )
    return rounded(out, avg_price=1)


@query("daily_grid", with_sql("style", "daily", f"SELECT sku_id, \"date\", units_sold, {q('revenue', 2)} AS revenue, {q('unit_price', 3)} AS unit_price, CAST(promo_flag AS INT) AS promo_flag, category, week_start, is_holiday, promo_event, season FROM daily"))
def daily_grid(spark, d):
    R = style(spark, d)
    daily = P.attach_dimensions(P.daily_grid(R.sales, R.master, R.span), R.calendar)
    return rounded(
        daily.select("sku_id", "date", "units_sold", "revenue", "unit_price", "promo_flag",
                    "category", "week_start", "is_holiday", "promo_event", "season"),
        revenue=2, unit_price=3,
    )


@query("panel_from_daily", with_sql("style", "panel_daily", f"SELECT category, week_start, count(*) AS skus, sum(units) AS units, {q('sum(avg_price)', 2)} AS avg_price, sum(holiday_days) AS holiday_days FROM panel_daily GROUP BY 1,2"))
def panel_from_daily(spark, d):
    R = style(spark, d)
    daily = P.attach_dimensions(P.daily_grid(R.sales, R.master, R.span), R.calendar)
    out = P.weekly_from_daily(daily).groupBy("category", "week_start").agg(
        F.count(F.lit(1)).alias("skus"), F.sum("units").alias("units"),
        F.sum("avg_price").alias("avg_price"), F.sum("holiday_days").alias("holiday_days"),
    )
    return rounded(out, avg_price=2)


_DRV = f"""mk AS ({MARKETING_SQL}), wb AS ({WEB_SQL}), cd AS ({CONDITIONS_SQL}),
 wbw AS (SELECT sku_id, CAST(date_trunc('week', "date") AS DATE) AS week_start, sum(sessions) AS sessions, sum(add_to_cart) AS add_to_cart FROM wb GROUP BY 1,2),
 drv AS (SELECT p.*, coalesce(media_spend, 0.0::DOUBLE) AS media_spend, coalesce(impressions, 0.0::DOUBLE) AS impressions, coalesce(email_sends, 0.0::DOUBLE) AS email_sends, coalesce(sessions, 0.0::DOUBLE) AS sessions,
   coalesce(add_to_cart, 0.0::DOUBLE) AS add_to_cart, 0.0::DOUBLE AS discount_pct, coalesce(competitor_price_index, 1.0::DOUBLE) AS competitor_price_index, coalesce(weather_anomaly, 0.0::DOUBLE) AS weather_anomaly
   FROM panel p LEFT JOIN mk ON mk.sku_id = p.sku_id AND mk.week_start = p.week_start LEFT JOIN wbw ON wbw.sku_id = p.sku_id AND wbw.week_start = p.week_start
   LEFT JOIN cd ON cd.category = p.category AND cd.week_start = p.week_start)"""


def with_drivers(R):
    marketing = K.clean_marketing(R.marketing_raw, R.master)
    web = K.clean_web(R.web_raw, R.master)
    panel = P.attach_drivers(R.panel, marketing, K.clean_conditions(R.conditions_raw), web)
    return panel, marketing


@query("panel_with_drivers", with_sql("style", "panel", "SELECT sku_id, week_start, units, media_spend, impressions, email_sends, sessions, add_to_cart, discount_pct, competitor_price_index, weather_anomaly FROM drv", _DRV))
def panel_with_drivers(spark, d):
    panel, _ = with_drivers(style(spark, d))
    return panel.select("sku_id", "week_start", "units", *P.DRIVER_DEFAULTS)


@query("weekly_calendar", with_sql("style", "weeks", "SELECT week_start, iso_week, \"month\", holiday_days, promo_event_days, days_in_week, planned_discount, has_promo_event FROM weeks"))
def weekly_calendar(spark, d):
    return style(spark, d).weeks.drop("week_sin", "week_cos")


@query("panel_gaps", with_sql("part", "panel", "SELECT count(*) AS skus, count(*) FILTER (weeks <> expected) AS skus_with_gaps, sum(weeks)::BIGINT AS weeks FROM (SELECT sku_id, count(*) AS weeks, (max(week_start)-min(week_start))//7+1 AS expected FROM panel GROUP BY 1)"))
def panel_gaps(spark, d):
    panel = part(spark, d).panel
    sizes = panel.agg(F.count_distinct("sku_id").alias("skus"), F.count(F.lit(1)).alias("weeks"))
    return sizes.crossJoin(P.gap_report(panel).agg(F.count(F.lit(1)).alias("skus_with_gaps")))


# --------------------------------------------------------------------------- #
# Features
# --------------------------------------------------------------------------- #
_ROUND = [*(f"units_roll_mean_{w}" for w in X.ROLLS), *(f"units_roll_std_{w}" for w in X.ROLLS),
          "zero_frac_8", "zero_frac_26"]
_ROLL_COLS = ", ".join(f"{q(c, 4)} AS {c}" for c in _ROUND)


@query("features_lags_rolling", with_sql("style", "feat", f"SELECT sku_id, week_start, {', '.join(f'units_lag_{k}' for k in X.LAGS)}, {_ROLL_COLS}, units_roll_max_13 FROM feat"))
def features_lags_rolling(spark, d):
    f = X.add_rolling(X.add_lags(style(spark, d).panel))
    return rounded(
        f.select("sku_id", "week_start", *[f"units_lag_{k}" for k in X.LAGS], *_ROUND, "units_roll_max_13"),
        **{c: 4 for c in _ROUND},
    )


_SUMS = ["units_roll_mean_4", "units_roll_std_13", "units_roll_mean_52", "units_roll_max_13", "zero_frac_8",
         "zero_frac_26", "units_lag_52"]


@query("features_intermittent", with_sql("part", "feat", "SELECT category, year(week_start) AS year, count(*) AS rows, " + ", ".join(f"{q(f'sum({c})', 2)} AS {c}" for c in _SUMS) + " FROM feat GROUP BY 1,2"))
def features_intermittent(spark, d):
    f = X.add_rolling(X.add_lags(part(spark, d).panel))
    out = f.groupBy("category", F.year("week_start").alias("year")).agg(
        F.count(F.lit(1)).alias("rows"), *[F.sum(c).alias(c) for c in _SUMS]
    )
    return rounded(out, **{c: 2 for c in _SUMS})


_SHAPE = ["trend_ratio_4_13", "trend_ratio_13_52", "cv_13", "price_roll_mean_4", "price_vs_list", "discount_depth",
          "gross_margin_per_unit"]


@query("features_shape_price_promo", with_sql("style", "feat", f"SELECT sku_id, week_start, {', '.join(f'{q(c, 3)} AS {c}' for c in _SHAPE)}, promo_days_roll_4, promo_days_roll_13 FROM feat"))
def features_shape_price_promo(spark, d):
    f = X.base_features(style(spark, d).panel)
    return rounded(
        f.select("sku_id", "week_start", *_SHAPE, "promo_days_roll_4", "promo_days_roll_13"),
        **{c: 3 for c in _SHAPE},
    )


_DF = ["media_spend_roll_4", "media_spend_roll_13", "sessions_roll_4", "sessions_roll_13", "add_to_cart_roll_4",
       "discount_roll_4", "sessions_trend_4_13", "cart_conversion_4", "media_trend_4_13", "log_media_spend"]


def _roll(c: str, n: int) -> str:
    return f"avg({c}) OVER (PARTITION BY sku_id ORDER BY week_start ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


_DF_SQL = _DRV + f""", df AS (SELECT *, {_roll('media_spend', 4)} AS media_spend_roll_4, {_roll('media_spend', 13)} AS media_spend_roll_13, {_roll('sessions', 4)} AS sessions_roll_4,
  {_roll('sessions', 13)} AS sessions_roll_13, {_roll('add_to_cart', 4)} AS add_to_cart_roll_4, {_roll('discount_pct', 4)} AS discount_roll_4, ln(1+media_spend) AS log_media_spend FROM drv),
 df2 AS (SELECT *, sessions_roll_4/(sessions_roll_13+1e-6) AS sessions_trend_4_13, add_to_cart_roll_4/(sessions_roll_4+1e-6) AS cart_conversion_4, media_spend_roll_4/(media_spend_roll_13+1e-6) AS media_trend_4_13 FROM df)"""


@query("features_drivers", with_sql("style", "panel", f"SELECT sku_id, week_start, {', '.join(f'{q(c, 3)} AS {c}' for c in _DF)} FROM df2", _DF_SQL))
def features_drivers(spark, d):
    panel, _ = with_drivers(style(spark, d))
    f = X.add_driver_features(X.add_rolling(panel))
    return rounded(f.select("sku_id", "week_start", *_DF), **{c: 3 for c in _DF})


@query("supervised_h8", with_sql("style", ("sup", "weeks"), """SELECT s.sku_id, s.week_start, horizon, target_week, y, units_seasonal_lag, w."month" AS target_month, w.holiday_days AS target_holiday_days, w.has_promo_event AS target_has_promo_event
  FROM sup s LEFT JOIN weeks w ON w.week_start = s.target_week"""))
def supervised_h8(spark, d):
    R = style(spark, d)
    return X.supervised_frame(R.panel, R.weeks, H).select(
        "sku_id", "week_start", "horizon", "target_week", "y", "units_seasonal_lag", "target_month",
        "target_holiday_days", "target_has_promo_event",
    )


@query("supervised_parts", with_sql("part", "sup", "SELECT horizon, category, count(*) AS rows, sum(y) AS y, sum(units_seasonal_lag) AS seasonal, count(units_seasonal_lag) AS seasonal_rows FROM sup GROUP BY 1,2"))
def supervised_parts(spark, d):
    R = part(spark, d)
    return X.expand_horizons(R.panel, H, True).groupBy("horizon", "category").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("y").alias("y"),
        F.sum("units_seasonal_lag").alias("seasonal"),
        F.count("units_seasonal_lag").alias("seasonal_rows"),
    )


def _target_drivers(R, horizons):
    panel, plan = with_drivers(R)
    f = X.add_driver_features(X.add_rolling(panel))
    rows = X.expand_horizons(f, horizons, labelled=False)
    out = X.attach_target_drivers(rows, plan, R.weeks).select(
        "sku_id", "week_start", "horizon", "target_media_spend_log", "target_media_ratio",
        "target_planned_discount",
    )
    return rounded(out, target_media_spend_log=4, target_media_ratio=4)


_DRIVERS_SQL = with_sql("style", ("panel", "weeks"), f"""SELECT d.sku_id, d.week_start, h.horizon, {q('ln(1+coalesce(mk.media_spend, 0.0))', 4)} AS target_media_spend_log,
  {q('least(greatest((coalesce(mk.media_spend, 0.0)+1e-6)/(media_spend_roll_13+1e-6), 0.0), 20.0)', 4)} AS target_media_ratio, coalesce(w.planned_discount, 0.0::DOUBLE) AS target_planned_discount
  FROM df d CROSS JOIN (SELECT unnest(range(1, 9))::INT AS horizon) h LEFT JOIN mk ON mk.sku_id = d.sku_id AND mk.week_start = d.week_start + 7*h.horizon LEFT JOIN weeks w ON w.week_start = d.week_start + 7*h.horizon""", _DF_SQL)


@query("target_week_drivers", _DRIVERS_SQL)
@query("target_week_drivers_all_horizons", _DRIVERS_SQL)
def target_week_drivers_all_horizons(spark, d):
    return _target_drivers(style(spark, d), H)


@query("inference_frame", with_sql("part", ("feat", "weeks"), f"""SELECT f.sku_id, f.week_start, h.horizon, f.week_start + 7*h.horizon AS target_week, {q('units_roll_mean_13', 4)} AS units_roll_mean_13, s.units AS units_seasonal_lag, w.holiday_days AS target_holiday_days
  FROM feat f CROSS JOIN (SELECT unnest(range(1, 9))::INT AS horizon) h LEFT JOIN panel s ON s.sku_id = f.sku_id AND s.week_start = f.week_start - 7*(52-h.horizon) LEFT JOIN weeks w ON w.week_start = f.week_start + 7*h.horizon
  WHERE f.week_start = (SELECT max(week_start) FROM panel)"""))
def inference_frame(spark, d):
    R = part(spark, d)
    rows = X.inference_frame(X.base_features(R.panel), R.weeks, R.last_week, H, check=False)
    return rounded(
        rows.select("sku_id", "week_start", "horizon", "target_week", "units_roll_mean_13",
                    "units_seasonal_lag", "target_holiday_days"),
        units_roll_mean_13=4,
    )


_GATE = [c for c in X.feature_spec().numeric if c != "horizon"]


@query(
    "leakage_gate",
    with_sql("style", ("sup", "wk"), " UNION ALL ".join(
        f"SELECT '{c}' AS feature, (SELECT count(*) FROM sup WHERE week_start <= (SELECT week_start FROM wk WHERE i = CAST(floor(n*0.7) AS BIGINT))) AS rows_compared, CAST(0 AS BIGINT) AS rows_moved" for c in _GATE)),
)
def leakage_gate(spark, d):
    R = style(spark, d)
    return X.leakage_report(R.panel, R.weeks, H)


@query("fold_origins", with_sql("style", "origins", "SELECT CAST(fold AS INT) AS fold, week_start AS origin_week FROM origins"))
def fold_origins(spark, d):
    rows = test_rows(style(spark, d))
    return rows.select("fold", "origin_week").distinct()


@query("fold_split", with_sql("style", ("sup", "origins"), "SELECT CAST(fold AS INT) AS fold, sum(CASE WHEN target_week <= o.week_start THEN 1 ELSE 0 END)::BIGINT AS train_rows, sum(CASE WHEN s.week_start = o.week_start THEN 1 ELSE 0 END)::BIGINT AS test_rows FROM sup s, origins o GROUP BY 1"))
def fold_split(spark, d):
    R = style(spark, d)
    rows = X.expand_horizons(R.panel, H, True)
    counts = []
    for i, origin in enumerate(B.backtest_origins(R.week_list), start=1):
        train, test = B.split_fold(rows, origin)
        counts += [
            train.agg(F.lit(i).alias("fold"), F.count(F.lit(1)).alias("train_rows"), F.lit(0).cast("long").alias("test_rows")),
            test.agg(F.lit(i).alias("fold"), F.lit(0).cast("long").alias("train_rows"), F.count(F.lit(1)).alias("test_rows")),
        ]
    return L.union_all(counts).groupBy("fold").agg(
        F.sum("train_rows").alias("train_rows"), F.sum("test_rows").alias("test_rows")
    )


@query("model_staleness", with_sql("style", "panel", "SELECT max(week_start) AS last_week, (max(week_start) - DATE '2001-06-04')//7 AS weeks_behind, (max(week_start) - DATE '2001-06-04')//7 >= 13 AS stale FROM panel"))
def model_staleness(spark, d):
    return B.staleness_weeks(style(spark, d).panel, dt.date(2001, 6, 4))


# --------------------------------------------------------------------------- #
# Lookups, latest rows, pages, sets
# --------------------------------------------------------------------------- #
@query("latest_position", with_sql("part", "inventory", 'SELECT sku_id, "date" AS inventory_as_of, on_hand_units, on_order_units, lead_time_days, reorder_point FROM (SELECT *, row_number() OVER (PARTITION BY sku_id ORDER BY "date" DESC) AS rn FROM inventory) WHERE rn = 1'))
def latest_position(spark, d):
    return L.latest_position(part(spark, d).inventory)


@query("latest_origin_per_week", with_sql("style", "test", "SELECT sku_id, target_week, horizon, week_start AS origin_week, y, baseline FROM (SELECT *, row_number() OVER (PARTITION BY sku_id, target_week ORDER BY week_start DESC) AS rn FROM test) WHERE rn = 1"))
def latest_origin_per_week(spark, d):
    rows = test_rows(style(spark, d))
    return L.latest_origin(rows).select("sku_id", "target_week", "horizon", "origin_week", "y", "baseline")


@query("last_weeks_of_history", with_sql("part", "panel", "SELECT sku_id, week_start, units, promo_days FROM (SELECT *, row_number() OVER (PARTITION BY sku_id ORDER BY week_start DESC) AS rn FROM panel) WHERE rn <= 8"))
def last_weeks_of_history(spark, d):
    return L.last_n_weeks(part(spark, d).panel, 8).select("sku_id", "week_start", "units", "promo_days")


@query("top_sellers", with_sql("part", "panel", f"SELECT sku_id, category, sum(units) AS total_units, {q('sum(revenue)', 1)} AS total_revenue FROM panel GROUP BY 1,2 ORDER BY sum(revenue) DESC, sku_id LIMIT 15"))
def top_sellers(spark, d):
    return rounded(I.top_skus(part(spark, d).panel), total_revenue=1)


@query("common_feature_keys", with_sql("style", ("sales", "panel"), "SELECT sku_id, week_start FROM panel WHERE units > 0 INTERSECT SELECT sku_id, CAST(date_trunc('week', \"date\") AS DATE) FROM sales"))
def common_feature_keys(spark, d):
    R = style(spark, d)
    sold = R.sales.select("sku_id", S.week_start("date").alias("week_start"))
    return L.common_keys(R.panel.filter("units > 0"), sold, ["sku_id", "week_start"])


@query("weeks_without_sales", with_sql("style", ("sales", "panel"), "SELECT p.sku_id, count(*) AS weeks FROM panel p WHERE NOT EXISTS (SELECT 1 FROM sales s WHERE s.sku_id = p.sku_id AND CAST(date_trunc('week', s.\"date\") AS DATE) = p.week_start) GROUP BY 1"))
def weeks_without_sales(spark, d):
    R = style(spark, d)
    sold = R.sales.select("sku_id", S.week_start("date").alias("week_start")).distinct()
    rest = L.difference(R.panel, sold, ["sku_id", "week_start"])
    return rest.groupBy("sku_id").agg(F.count(F.lit(1)).alias("weeks"))


@query("normalise_id_list", "SELECT upper(trim(c_mktsegment)) AS sku_id, min(c_custkey) AS _row_seq FROM customer GROUP BY 1")
def normalise_id_list(spark, d):
    c = style(spark, d).table("customer")
    ids = c.select(
        F.concat(F.lit(" "), F.lower("c_mktsegment")).alias("sku_id"), F.col("c_custkey").alias("_row_seq")
    )
    return L.normalise_ids(ids)


# --------------------------------------------------------------------------- #
# Metrics
# --------------------------------------------------------------------------- #
@query("metric_record", with_sql("style", "test", f"""SELECT count(*) AS n_observations, sum(y) AS total_actual, {q('sum(baseline)', 2)} AS total_predicted, {q(wape_sql('y', 'baseline'), 6)} AS wape,
  {q('avg(CASE WHEN y <> 0 THEN abs((y-baseline)/y) END)', 6)} AS mape, {q('avg(CASE WHEN y <> 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)', 6)} AS mape_coverage, {q('avg(baseline-y)', 5)} AS bias_units, {q(bias_sql('y', 'baseline'), 6)} AS bias_relative,
  {q('avg(abs(baseline-y))', 5)} AS mae, {q('sqrt(avg((baseline-y)*(baseline-y)))', 5)} AS rmse FROM test"""))
def metric_record(spark, d):
    return rounded(
        M.evaluate(test_rows(style(spark, d)), "y", "baseline"),
        total_predicted=2, wape=6, mape=6, mape_coverage=6, bias_units=5, bias_relative=6, mae=5, rmse=5,
    )


@query("metrics_by_horizon", with_sql("style", "test", f"SELECT horizon, count(*) AS n_observations, sum(y) AS total_actual, {q(wape_sql('y', 'naive'), 6)} AS wape, {q(bias_sql('y', 'naive'), 6)} AS bias_relative, {q('avg(naive-y)', 5)} AS bias_units FROM test GROUP BY 1"))
def metrics_by_horizon(spark, d):
    return rounded(
        M.metrics_by(test_rows(style(spark, d)), "horizon", "y", "naive"),
        wape=6, bias_relative=6, bias_units=5,
    )


@query("pinball_and_coverage", with_sql("part", "test", f"""SELECT category, {q('avg(greatest(0.1::DOUBLE*(y-0.5*baseline), -0.9::DOUBLE*(y-0.5*baseline)))', 6)} AS pinball_lower, {q('avg(greatest(0.9::DOUBLE*(y-2*baseline), -0.1::DOUBLE*(y-2*baseline)))', 6)} AS pinball_upper,
  {q('avg(CASE WHEN y >= 0.5*baseline AND y <= 2*baseline THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)', 6)} AS coverage, {q('avg(CASE WHEN units_seasonal_lag IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)', 6)} AS fallback_rate FROM test GROUP BY 1"""))
def pinball_and_coverage(spark, d):
    rows = test_rows(part(spark, d)).withColumns(
        {"low": F.col("baseline") * 0.5, "high": F.col("baseline") * 2.0}
    )
    return rows.groupBy("category").agg(
        fx(M.pinball("y", "low", 0.1), 6).alias("pinball_lower"),
        fx(M.pinball("y", "high", 0.9), 6).alias("pinball_upper"),
        fx(M.coverage("y", "low", "high"), 6).alias("coverage"),
        fx(fallback_rate(), 6).alias("fallback_rate"),
    )
