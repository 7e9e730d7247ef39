"""Forecasters, blending, calibration, backtests, holdout, evaluation, scenarios."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from registry.core import fx, part, q, query, rounded, style
from registry.panel import H, test_rows
from registry.sql import bias_sql, wape_sql, with_sql
from stockloom.functions import metrics as M
from stockloom.models import bands as BD
from stockloom.models import baseline as BL
from stockloom.models import conformal as CF
from stockloom.models import ensemble as E
from stockloom.models import trees as T
from stockloom.operators import features as X
from stockloom.operators import insights as I
from stockloom.operators.lookup import union_all
from stockloom.plans import backtest as B
from stockloom.plans import evaluate as EV
from stockloom.session import cut
from stockloom.sources.shelf import Shelf, side_by_side

_REGIME = "CASE WHEN weeks_since_launch < 26 THEN 'new' WHEN coalesce(zero_frac_26, 0) >= 0.35 THEN 'intermittent' WHEN coalesce(cv_13, 0) >= 0.8 THEN 'volatile' ELSE 'steady' END"


@query("regime_assignment", with_sql("part", "feat", f"SELECT {_REGIME} AS regime, category, year(week_start) AS year, count(*) AS rows FROM feat GROUP BY 1,2,3"))
def regime_assignment(spark, d):
    f = X.add_shape(X.add_rolling(part(spark, d).panel))
    return E.assign_regime(f).groupBy("regime", "category", F.year("week_start").alias("year")).agg(
        F.count(F.lit(1)).alias("rows")
    )


_TSB = """t1 AS (SELECT sku_id, week_start, units, row_number() OVER w AS t, sum(CASE WHEN units > 0 THEN 1 ELSE 0 END) OVER w AS n FROM panel WINDOW w AS (PARTITION BY sku_id ORDER BY week_start)),
 tsb AS (SELECT sku_id, week_start, pow(0.88::DOUBLE, n)*(z0+zs)*pow(0.94::DOUBLE, t)*(p0+ps) AS tsb_level FROM (SELECT *, coalesce(avg(CASE WHEN t <= 26 AND units > 0 THEN units END) OVER (PARTITION BY sku_id), 0) AS z0,
   avg(CASE WHEN t <= 26 THEN CASE WHEN units > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END) OVER (PARTITION BY sku_id) AS p0,
   sum(CASE WHEN units > 0 THEN units*0.12::DOUBLE/pow(0.88::DOUBLE, n) ELSE 0.0::DOUBLE END) OVER (PARTITION BY sku_id ORDER BY week_start) AS zs, sum(CASE WHEN units > 0 THEN 0.06::DOUBLE/pow(0.94::DOUBLE, t) ELSE 0.0::DOUBLE END) OVER (PARTITION BY sku_id ORDER BY week_start) AS ps FROM t1))"""


@query("tsb_levels", with_sql("part", "panel", f"SELECT sku_id, year(week_start) AS year, count(*) AS weeks, {q('sum(tsb_level)', 3)} AS total, {q('max(tsb_level)', 4)} AS highest FROM tsb GROUP BY 1,2", _TSB))
def tsb_levels(spark, d):
    out = E.tsb_levels(part(spark, d).panel).groupBy("sku_id", F.year("week_start").alias("year")).agg(
        F.count(F.lit(1)).alias("weeks"), F.sum("tsb_level").alias("total"),
        F.max("tsb_level").alias("highest"),
    )
    return rounded(out, total=3, highest=4)


_TSB_WHOLE = (_TSB.replace("FROM panel WINDOW", "FROM panel WHERE week_start <= (SELECT max(week_start) FROM origins) WINDOW")
              .replace("CASE WHEN t <= 26 AND units > 0 THEN units END", "CASE WHEN units > 0 THEN units END")
              .replace("CASE WHEN t <= 26 THEN CASE WHEN units > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END", "CASE WHEN units > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"))


@query("tsb_levels_published", with_sql("part", ("panel", "origins"), f"SELECT sku_id, year(week_start) AS year, count(*) AS weeks, {q('sum(tsb_level)', 3)} AS total, {q('max(tsb_level)', 4)} AS highest FROM tsb GROUP BY 1,2", _TSB_WHOLE))
def tsb_levels_published(spark, d):
    """The published form: start values from all that is visible at the last training origin."""
    R = part(spark, d)
    seen = R.panel.filter(F.col("week_start") <= F.lit(B.backtest_origins(R.week_list)[-1]))
    out = E.tsb_levels(seen, whole_series_seed=True).groupBy("sku_id", F.year("week_start").alias("year")).agg(
        F.count(F.lit(1)).alias("weeks"), F.sum("tsb_level").alias("total"), F.max("tsb_level").alias("highest"),
    )
    return rounded(out, total=3, highest=4)


_PROFILE = """tr AS (SELECT category, weekofyear(target_week) AS iw, y FROM sup WHERE target_week <= (SELECT min(week_start) FROM origins)),
 pc AS (SELECT c.category, c.iw, m/cm AS idx FROM (SELECT category, iw, avg(y) AS m FROM tr GROUP BY 1,2) c JOIN (SELECT category, avg(y) AS cm FROM tr GROUP BY 1) t ON t.category = c.category WHERE cm > 1e-9),
 pw AS (SELECT iw, avg(y)/(SELECT avg(y) FROM tr) AS idx FROM tr GROUP BY 1)"""


def _train(R):
    first = B.backtest_origins(R.week_list)[0]
    return X.expand_horizons(R.panel, H, True).filter(F.col("target_week") <= F.lit(first))


@query("seasonal_profile", with_sql("style", ("sup", "origins"), f"SELECT category, iw AS iso_week, {q('idx', 5)} AS \"index\" FROM pc UNION ALL SELECT '__GLOBAL__', iw, {q('idx', 5)} FROM pw", _PROFILE))
def seasonal_profile(spark, d):
    by_category, by_week = E.fit_seasonal_profile(_train(style(spark, d)))
    return rounded(E.seasonal_index_table(by_category, by_week), index=5)


_PARTS = _PROFILE + ",\n " + _TSB + f""",
 oi AS (SELECT category, week_start, avg(coalesce(pc.idx, pw.idx, 1.0)) AS oidx FROM (SELECT DISTINCT category, week_start FROM test) t CROSS JOIN (SELECT unnest(range(0, 13))::INT AS i) LEFT JOIN pc USING (category) LEFT JOIN pw ON pw.iw = weekofyear(t.week_start - 7*i) WHERE pc.iw = weekofyear(t.week_start - 7*i) GROUP BY 1,2),
 comp AS (SELECT t.sku_id, t.category, t.week_start, t.horizon, t.target_week, t.fold, t.y, t.naive, t.units_roll_std_13, {_REGIME} AS regime, t.baseline AS gbm, greatest(coalesce(tsb_level, units_roll_mean_4, 0), 0) AS tsb,
   greatest(coalesce(units_roll_mean_13, units_roll_mean_4, 0) * least(greatest(coalesce(a.idx, b.idx, 1.0)/(CASE WHEN oidx > 1e-9 THEN oidx ELSE 1.0 END), 0.2), 5.0), 0) AS seasonal_profile
   FROM test t LEFT JOIN tsb ON tsb.sku_id = t.sku_id AND tsb.week_start = t.week_start LEFT JOIN oi ON oi.category = t.category AND oi.week_start = t.week_start
   LEFT JOIN pc a ON a.category = t.category AND a.iw = weekofyear(t.target_week) LEFT JOIN pw b ON b.iw = weekofyear(t.target_week))"""
_NEED = ("sup", "origins", "test")


def components(R):
    """Test rows of six origins with the three components; the trees' place is taken by
    the seasonal-naive forecast, which SQL can reproduce."""
    origins = B.backtest_origins(R.week_list)
    base = X.base_features(R.panel)
    rows = X.expand_horizons(base, H, True).filter(F.col("week_start").isin(*origins))
    fold = F.lit(None).cast("int")
    for i, o in enumerate(origins, start=1):
        fold = F.when(F.col("week_start") == F.lit(o), i).otherwise(fold)
    rows = E.assign_regime(BL.with_baselines(rows)).withColumns(
        {"gbm": F.col("baseline"), "fold": fold}
    )
    rows = E.tsb_predict(rows, E.tsb_levels(R.panel))
    profile = E.fit_seasonal_profile(_train(R))
    out = E.seasonal_profile_predict(rows, profile)
    return cut(out.select("sku_id", "category", "week_start", "horizon", "target_week", "fold", "y",
                          "naive", "units_roll_std_13", "regime", *E.COMPONENTS))


@query("ensemble_components", with_sql("style", _NEED, f"SELECT sku_id, week_start, horizon, regime, {q('gbm', 3)} AS gbm, {q('tsb', 3)} AS tsb, {q('seasonal_profile', 3)} AS seasonal_profile FROM comp", _PARTS))
def ensemble_components(spark, d):
    out = components(style(spark, d))
    return rounded(out.select("sku_id", "week_start", "horizon", "regime", *E.COMPONENTS),
                   gbm=3, tsb=3, seasonal_profile=3)


_GRID = """gr AS (SELECT row_number() OVER (ORDER BY a, b) - 1 AS w_id, a/10.0::DOUBLE AS wa, b/10.0::DOUBLE AS wb, (10-a-b)/10.0::DOUBLE AS wc FROM (SELECT unnest(range(0, 11)) AS a), (SELECT unnest(range(0, 11)) AS b) WHERE a + b <= 10)"""


def _weights_sql(src: str, by: str, name: str, bar: str = "") -> str:
    return f"""{name}_e AS (SELECT {by} AS grp, w_id, wa, wb, wc, count(*) AS rows, sum(abs(y - (wa*gbm+wb*tsb+wc*seasonal_profile)))/nullif(sum(abs(y)), 0) AS wape FROM {src} CROSS JOIN gr GROUP BY ALL),
 {name} AS (SELECT grp, rows, wa AS gbm, wb AS tsb, wc AS seasonal_profile, wape FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY wape, w_id) AS rn FROM {name}_e WHERE wape IS NOT NULL {bar}) WHERE rn = 1)"""


_BLEND = _PARTS + ",\n " + _GRID + ",\n " + _weights_sql("comp", "regime", "bl", "AND NOT (grp = 'new' AND wb > 0)")


@query("blend_weights", with_sql("style", _NEED, f"SELECT grp AS \"group\", rows, CASE WHEN rows >= 30 THEN gbm ELSE 1.0 END AS gbm, CASE WHEN rows >= 30 THEN tsb ELSE 0.0 END AS tsb, CASE WHEN rows >= 30 THEN seasonal_profile ELSE 0.0 END AS seasonal_profile, CASE WHEN rows >= 30 THEN {q('wape', 5)} END AS wape FROM bl", _BLEND))
def blend_weights(spark, d):
    out = E.fit_blend(components(style(spark, d)), by="regime", barred=E.BARRED)
    return rounded(out, wape=5)


_CAL = _PARTS + ",\n " + _GRID + ",\n cal AS (SELECT * FROM comp WHERE fold < 6),\n " + _weights_sql("cal", "'__POOLED__'", "gl") + ",\n " + _weights_sql("cal", "regime", "rg")


@query("blend_global", with_sql("style", _NEED, f"SELECT g.gbm AS w_gbm, g.tsb AS w_tsb, g.seasonal_profile AS w_seasonal, {q('g.wape', 5)} AS calibration_wape, (SELECT {q(wape_sql('y', '(g.gbm*c.gbm+g.tsb*c.tsb+g.seasonal_profile*c.seasonal_profile)'), 5)} FROM comp c WHERE fold = 6) AS held_out_wape FROM gl g", _CAL))
def blend_global(spark, d):
    rows = components(style(spark, d))
    weights = E.fit_blend(rows.filter("fold < 6"))
    held = E.blend(rows.filter("fold = 6"), weights, by=None).agg(E_wape("y", "ensemble").alias("held_out_wape"))
    out = weights.select(
        F.col("gbm").alias("w_gbm"), F.col("tsb").alias("w_tsb"),
        F.col("seasonal_profile").alias("w_seasonal"), F.col("wape").alias("calibration_wape"),
    ).crossJoin(held)
    return rounded(out, calibration_wape=5, held_out_wape=5)


def E_wape(a, p):
    from stockloom.functions.metrics import wape

    return wape(a, p)


_MIX = "(coalesce(r.gbm, p.gbm)*c.gbm + coalesce(r.tsb, p.tsb)*c.tsb + coalesce(r.seasonal_profile, p.seasonal_profile)*c.seasonal_profile)"


@query("blend_by_regime", with_sql("style", _NEED, f"SELECT c.sku_id, c.horizon, c.regime, {q(_MIX, 3)} AS ensemble FROM comp c LEFT JOIN (SELECT * FROM rg WHERE rows >= 30) r ON r.grp = c.regime CROSS JOIN gl p WHERE c.fold = 6", _CAL))
def blend_by_regime(spark, d):
    rows = components(style(spark, d))
    weights = E.fit_blend(rows.filter("fold < 6"), by="regime", pooled=True)
    out = E.blend(rows.filter("fold = 6"), weights)
    return rounded(out.select("sku_id", "horizon", "regime", "ensemble"), ensemble=3)


@query("interval_scale", with_sql("style", _NEED, """SELECT coalesce(min(s), 5.0) AS interval_scale FROM (SELECT s, avg(CASE WHEN y >= gbm - s*g AND y <= gbm + s*g THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS c FROM (SELECT y, gbm, coalesce(units_roll_std_13, 0) AS g FROM comp)
  CROSS JOIN (SELECT 0.5::DOUBLE + 0.05::DOUBLE*unnest(range(0, 91)) AS s) GROUP BY 1) WHERE c >= 0.8""", _PARTS))
def interval_scale(spark, d):
    gap = F.coalesce("units_roll_std_13", F.lit(0.0))
    rows = components(style(spark, d)).withColumns({"low_gap": gap, "high_gap": gap})
    return E.interval_scale(rows, 0.8, point="gbm")


def _banded(rows):
    """An interval around the naive component, for the calibration queries."""
    spread = F.coalesce("units_roll_std_13", F.lit(1.0))
    return rows.withColumns(
        {
            "ensemble": F.col("seasonal_profile"),
            "ensemble_lower": F.greatest(F.col("seasonal_profile") - spread, F.lit(0.0)),
            "ensemble_upper": F.col("seasonal_profile") + spread,
        }
    )


_CONF = _PARTS + """,
 bd AS (SELECT *, seasonal_profile AS e, greatest(seasonal_profile - coalesce(units_roll_std_13, 1.0), 0.0) AS lo, seasonal_profile + coalesce(units_roll_std_13, 1.0) AS hi FROM comp),
 sc AS (SELECT regime, abs(y-e)/greatest((hi-lo)/2.0, 1e-6) AS s FROM bd WHERE fold < 6 UNION ALL SELECT '__POOLED__', abs(y-e)/greatest((hi-lo)/2.0, 1e-6) FROM bd WHERE fold < 6),
 rk AS (SELECT regime, s, row_number() OVER (PARTITION BY regime ORDER BY s) - 1 AS i, count(*) OVER (PARTITION BY regime) AS n FROM sc),
 lv AS (SELECT *, least(1.0::DOUBLE, ceil((n+1)*0.8::DOUBLE)/n)*(n-1) AS pos FROM rk),
 cq AS (SELECT regime, n AS rows, least(greatest(max(CASE WHEN i = floor(pos) THEN s END) + (max(CASE WHEN i = ceil(pos) THEN s END) - max(CASE WHEN i = floor(pos) THEN s END))*(max(pos)-floor(max(pos))), 0.25), 6.0) AS scale FROM lv GROUP BY 1,2 HAVING n >= 30 OR regime = '__POOLED__')"""


@query("conformal_scale", with_sql("style", _NEED, f"SELECT regime, rows, {q('scale', 5)} AS scale FROM cq", _CONF))
def conformal_scale(spark, d):
    rows = _banded(components(style(spark, d)))
    return rounded(CF.fit_conformal(rows.filter("fold < 6")), scale=5)


@query("conformal_coverage", with_sql("style", _NEED, f"""SELECT b.regime, count(*) AS rows, {q('avg(CASE WHEN y BETWEEN lo AND hi THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)', 5)} AS before,
  {q('avg(CASE WHEN y BETWEEN greatest(e - greatest((hi-lo)/2.0, 1e-6)*coalesce(o.scale, p.scale), 0.0) AND e + greatest((hi-lo)/2.0, 1e-6)*coalesce(o.scale, p.scale) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)', 5)} AS after FROM bd b LEFT JOIN cq o ON o.regime = b.regime CROSS JOIN (SELECT scale FROM cq WHERE regime = '__POOLED__') p WHERE fold = 6 GROUP BY 1""", _CONF))
def conformal_coverage(spark, d):
    rows = _banded(components(style(spark, d)))
    out = CF.apply_conformal(rows.filter("fold = 6"), CF.fit_conformal(rows.filter("fold < 6")))
    before = I.coverage_by_regime(out, "ensemble_lower", "ensemble_upper").withColumnRenamed("coverage", "before")
    after = I.coverage_by_regime(out, "recalibrated_lower", "recalibrated_upper").select(
        "regime", F.col("coverage").alias("after")
    )
    return rounded(before.join(after, "regime"), before=5, after=5)


@query("residual_quantiles", with_sql("style", _NEED, f"""SELECT cell, {q('quantile_cont(r, 0.1)+1000', 4)} AS low, {q('quantile_cont(r, 0.9)+1000', 4)} AS high FROM (SELECT regime || '|' || horizon AS cell, y-gbm AS r, count(*) OVER (PARTITION BY regime, horizon) AS n FROM comp) WHERE n >= 30 GROUP BY 1
  UNION ALL SELECT '__POOLED__', {q('quantile_cont(y-gbm, 0.1)+1000', 4)}, {q('quantile_cont(y-gbm, 0.9)+1000', 4)} FROM comp""", _PARTS))
def residual_quantiles(spark, d):
    rows = components(style(spark, d)).withColumn("prediction", F.col("gbm"))
    out = T.residual_quantiles(rows, ["regime", "horizon"], 0.8)
    return rounded(out.withColumns({"low": F.col("low") + 1000, "high": F.col("high") + 1000}), low=4, high=4)


# --------------------------------------------------------------------------- #
# Backtest tables
# --------------------------------------------------------------------------- #
_LONG = "lg AS (SELECT fold, week_start, horizon, category, regime, y, unnest(['gbm','naive','tsb','seasonal_profile']) AS model, unnest([gbm, naive, tsb, seasonal_profile]) AS p FROM comp)"
_MODELS = ["gbm", "naive", "tsb", "seasonal_profile"]


@query("fold_table", with_sql("style", _NEED, f"SELECT CAST(fold AS INT) AS fold, week_start AS origin_week, model, count(*) AS test_rows, {q(wape_sql('y', 'p'), 5)} AS wape, {q(bias_sql('y', 'p'), 5)} AS bias_relative FROM lg GROUP BY 1,2,3", _PARTS + ",\n " + _LONG))
def fold_table(spark, d):
    rows = components(style(spark, d)).withColumn("origin_week", F.col("week_start"))
    return rounded(B.fold_table(rows, _MODELS), wape=5, bias_relative=5)


@query("model_comparison", with_sql("style", _NEED, f"SELECT model, {q(wape_sql('y', 'p'), 5)} AS wape, {q(bias_sql('y', 'p'), 5)} AS bias_relative, count(*) AS n_observations, CAST(NULL AS VARCHAR) AS note FROM lg GROUP BY 1 UNION ALL SELECT 'promotion_response', NULL, NULL, NULL, 'a decomposition, not a point forecast'", _PARTS + ",\n " + _LONG))
def model_comparison(spark, d):
    table = B.model_table(components(style(spark, d)), _MODELS, {"promotion_response": "a decomposition, not a point forecast"})
    return rounded(table, wape=5, bias_relative=5)


@query("model_selection", with_sql("style", _NEED, f"SELECT (SELECT model FROM m ORDER BY wape, model LIMIT 1) AS selected_model, {q('min(wape)', 5)} AS selected_wape, {q('''max(CASE WHEN model = 'gbm' THEN wape END)''', 5)} AS baseline_wape, {q('''(max(CASE WHEN model = 'gbm' THEN wape END)-min(wape))/max(CASE WHEN model = 'gbm' THEN wape END)''', 5)} AS improvement, (SELECT model FROM m ORDER BY wape, model LIMIT 1) <> 'gbm' AS beats_baseline FROM m",
       _PARTS + ",\n " + _LONG + f",\n m AS (SELECT model, {wape_sql('y', 'p')} AS wape FROM lg GROUP BY 1)"))
def model_selection(spark, d):
    table = B.model_table(components(style(spark, d)), _MODELS)
    return rounded(B.select_model(table, baseline="gbm"), selected_wape=5, baseline_wape=5, improvement=5)


@query("breakdown_by_regime", with_sql("style", _NEED, f"SELECT regime, count(*) AS n_observations, sum(y) AS total_actual, {q(wape_sql('y', 'gbm'), 5)} AS gbm_wape, {q(wape_sql('y', 'tsb'), 5)} AS tsb_wape, {q(wape_sql('y', 'seasonal_profile'), 5)} AS seasonal_profile_wape FROM comp GROUP BY 1", _PARTS))
def breakdown_by_regime(spark, d):
    out = B.breakdowns(components(style(spark, d)), list(E.COMPONENTS), "regime")
    return rounded(out, gbm_wape=5, tsb_wape=5, seasonal_profile_wape=5)


@query("accuracy_views", with_sql("style", _NEED, " UNION ALL ".join(
    f"SELECT '{v}' AS view, {q('1-' + wape_sql('y', 'g'), 5)} AS gbm_accuracy, {q('1-' + wape_sql('y', 't'), 5)} AS tsb_accuracy FROM (SELECT sum(y) AS y, sum(gbm) AS g, sum(tsb) AS t FROM comp GROUP BY {k})"
    for v, k in (("sku_month", "sku_id, date_trunc('month', target_week)"), ("sku_full_horizon", "sku_id, week_start"), ("category_week", "category, target_week"), ("portfolio_week", "target_week"))), _PARTS))
def accuracy_views(spark, d):
    out = I.accuracy_views(components(style(spark, d)), ("gbm", "tsb"))
    return rounded(out, gbm_accuracy=5, tsb_accuracy=5)


# --------------------------------------------------------------------------- #
# Holdout, evaluation, scenarios
# --------------------------------------------------------------------------- #
class _Naive:
    """Seasonal-naive with a fixed band, in the shape of a fitted model."""

    def predict(self, df):
        return df.withColumn("prediction", BL.seasonal_naive()).withColumns(
            {"prediction_lower": F.col("prediction") * 0.5, "prediction_upper": F.col("prediction") * 1.5}
        )


def holdout(R):
    return cut(B.holdout(R.panel, R.weeks, R.week_list, lambda train: _Naive()))


# 357 weeks: 250 train (round(357*0.7)), origins every 8 weeks from index 249.
_HOLD = """hs AS (SELECT max(i) FILTER (i = CAST(round_even(n*0.7::DOUBLE, 0) AS BIGINT) - 1) AS s, max(n) AS n FROM wk),
 ho AS (SELECT week_start FROM wk, hs WHERE i >= s AND i < hs.n - 1 AND (i - s) % 8 = 0),
 hf AS (SELECT f.sku_id, f.category, f.week_start AS origin_week, h.horizon, f.week_start + 7*h.horizon AS target_week, greatest(coalesce(l.units, f.units_roll_mean_4, 0), 0) AS prediction FROM feat f JOIN ho ON ho.week_start = f.week_start CROSS JOIN (SELECT unnest(range(1,9))::INT AS horizon) h LEFT JOIN panel l ON l.sku_id = f.sku_id AND l.week_start = f.week_start - 7*(52-h.horizon)),
 sc AS (SELECT hf.*, prediction*0.5 AS lo, prediction*1.5 AS hi, p.units AS actual, prediction AS baseline, CASE WHEN p.units >= prediction*0.5 AND p.units <= prediction*1.5 THEN 1 ELSE 0 END AS inside FROM hf JOIN panel p ON p.sku_id = hf.sku_id AND p.week_start = hf.target_week)"""
_HN = ("feat", "wk")


@query("holdout_scored", with_sql("style", _HN, f"SELECT sku_id, target_week, horizon, origin_week, {q('prediction', 3)} AS prediction, actual, {q('abs(prediction-actual)', 3)} AS abs_error, inside AS within_interval FROM sc", _HOLD))
def holdout_scored(spark, d):
    out = B.holdout(style(spark, d).panel, style(spark, d).weeks, style(spark, d).week_list, lambda t: _Naive())
    return rounded(out.select("sku_id", "target_week", "horizon", "origin_week", "prediction", "actual", "abs_error", "within_interval"), prediction=3, abs_error=3)


@query("holdout_report", with_sql("style", _HN, f"""SELECT target_week, sum(actual) AS actual, {q('sum(prediction)', 2)} AS predicted, {q('sum(baseline)', 2)} AS baseline, {q('sum(lo)', 2)} AS lower, {q('sum(hi)', 2)} AS upper, count(DISTINCT sku_id) AS skus, {q('avg(inside)', 5)} AS covered,
  {q('(sum(prediction)-sum(actual))/nullif(sum(actual), 0)', 5)} AS error_pct FROM sc GROUP BY 1""", _HOLD))
def holdout_report(spark, d):
    return rounded(I.holdout_by_week(holdout(style(spark, d))), predicted=2, baseline=2, lower=2, upper=2, covered=5, error_pct=5)


@query("holdout_by_category", with_sql("style", _HN, f"SELECT category, count(*) AS rows, sum(actual) AS actual, {q('sum(prediction)', 2)} AS predicted, {q(wape_sql('actual', 'prediction'), 5)} AS wape, {q('1-' + wape_sql('actual', 'prediction'), 5)} AS accuracy, {q('sum(actual)/(SELECT sum(abs(actual)) FROM sc)', 5)} AS share_of_units FROM sc GROUP BY 1", _HOLD))
def holdout_by_category(spark, d):
    return rounded(I.holdout_by_category(holdout(style(spark, d))), predicted=2, wape=5, accuracy=5, share_of_units=5)


@query("holdout_by_horizon", with_sql("style", _HN, f"SELECT horizon, count(*) AS rows, {q(wape_sql('actual', 'prediction'), 5)} AS wape, {q('avg(inside)', 5)} AS coverage, {q('1-' + wape_sql('actual', 'prediction'), 5)} AS accuracy FROM sc GROUP BY 1", _HOLD))
def holdout_by_horizon(spark, d):
    return rounded(I.holdout_by_horizon(holdout(style(spark, d))), wape=5, coverage=5, accuracy=5)


@query("holdout_by_sku", with_sql("style", _HN, f"SELECT sku_id, category, count(*) AS weeks, sum(actual) AS actual, {q('sum(prediction)', 2)} AS predicted, {q('sum(abs(prediction-actual))', 2)} AS abs_error, {q('avg(inside)', 5)} AS coverage, {q('sum(abs(prediction-actual))/nullif(sum(actual), 0)', 5)} AS wape, {q('(sum(prediction)-sum(actual))/nullif(sum(actual), 0)', 5)} AS bias, {q('1-sum(abs(prediction-actual))/nullif(sum(actual), 0)', 5)} AS accuracy FROM sc GROUP BY 1,2", _HOLD))
def holdout_by_sku(spark, d):
    return rounded(I.holdout_by_sku(holdout(style(spark, d))), predicted=2, abs_error=2, coverage=5, wape=5, bias=5, accuracy=5)


# Actuals: the panel's own weeks of the last year, as supplied observations.
_EVAL = _HOLD + """,
 bt AS (SELECT sku_id, target_week, horizon, baseline AS prediction, baseline*0.5 AS lo, baseline*1.5 AS hi FROM (SELECT *, row_number() OVER (PARTITION BY sku_id, target_week ORDER BY week_start DESC) AS rn FROM test) WHERE rn = 1),
 fc AS (SELECT sku_id, target_week, horizon, prediction, lo, hi, 'holdout' AS source FROM sc WHERE target_week < DATE '2001-06-01' UNION ALL SELECT *, 'backtest' FROM bt WHERE NOT EXISTS (SELECT 1 FROM sc WHERE sc.sku_id = bt.sku_id AND sc.target_week = bt.target_week AND sc.target_week < DATE '2001-06-01')),
 ac AS (SELECT sku_id, week_start AS target_week, units AS actual FROM panel WHERE week_start >= DATE '2000-11-06'),
 mt AS (SELECT a.sku_id, a.target_week, actual, f.horizon, f.prediction AS forecast, lo, hi, source, b.units AS baseline, p.category FROM ac a JOIN fc f ON f.sku_id = a.sku_id AND f.target_week = a.target_week LEFT JOIN panel b ON b.sku_id = a.sku_id AND b.week_start = a.target_week - 364 JOIN master p ON p.sku_id = a.sku_id)"""
_EN = ("feat", "wk", "test", "master")


def _evaluation(R):
    scored = holdout(R)
    ahead = scored.filter(F.col("target_week") < F.lit(dt.date(2001, 6, 1)))
    past = test_rows(R).withColumn("prediction", F.col("baseline")).withColumns(
        {"prediction_lower": F.col("baseline") * 0.5, "prediction_upper": F.col("baseline") * 1.5}
    )
    actuals = R.panel.filter(F.col("week_start") >= F.lit(dt.date(2000, 11, 6))).select(
        F.lower("sku_id").alias("sku_id"), F.date_add("week_start", 3).alias("week_starting"), "units"
    )
    return actuals, EV.prioritise_sources(None, ahead, past)


def matched(R):
    actuals, forecasts = _evaluation(R)
    return cut(EV.matched_rows(actuals, forecasts, R.panel, R.master))


_HAS = "CASE WHEN baseline IS NOT NULL THEN actual END"


@query("evaluate_actuals", with_sql("style", _EN, f"""SELECT count(*) AS rows_matched, {q(wape_sql('actual', 'forecast'), 5)} AS wape, {q(bias_sql('actual', 'forecast'), 5)} AS bias_relative, {q('avg(abs(forecast-actual))', 4)} AS mae, {q('sqrt(avg((forecast-actual)*(forecast-actual)))', 4)} AS rmse,
  {q('avg(CASE WHEN actual BETWEEN lo AND hi THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)', 5)} AS interval_coverage, {q(f'sum(abs({_HAS}-baseline))/nullif(sum(abs({_HAS})),0)', 5)} AS baseline_wape, {q('avg(CASE WHEN baseline IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END)', 5)} AS baseline_coverage,
  {q(f'(sum(abs({_HAS}-baseline))/sum(abs({_HAS}))-' + wape_sql('actual', 'forecast') + f')/(sum(abs({_HAS}-baseline))/sum(abs({_HAS})))', 5)} AS improvement FROM mt""", _EVAL))
def evaluate_actuals(spark, d):
    out = EV.evaluation_summary(matched(style(spark, d)))
    return rounded(out, wape=5, bias_relative=5, mae=4, rmse=4, interval_coverage=5, baseline_wape=5, baseline_coverage=5, improvement=5)


@query("evaluation_by_category", with_sql("style", _EN, f"SELECT category AS \"key\", count(*) AS n_observations, sum(abs(actual)) AS total_actual, {q(wape_sql('actual', 'forecast'), 5)} AS wape, {q(f'sum(abs({_HAS}-baseline))/nullif(sum(abs({_HAS})),0)', 5)} AS baseline_wape, {q(bias_sql('actual', 'forecast'), 5)} AS bias_relative FROM mt GROUP BY 1", _EVAL))
def evaluation_by_category(spark, d):
    return rounded(EV.evaluation_by(matched(style(spark, d)), "category"), wape=5, baseline_wape=5, bias_relative=5)


@query("evaluation_sources", with_sql("style", _EN, "SELECT source, horizon, count(*) AS rows FROM mt GROUP BY 1,2", _EVAL))
def evaluation_sources(spark, d):
    return matched(style(spark, d)).groupBy("source", "horizon").agg(F.count(F.lit(1)).alias("rows"))


@query("error_contributors", with_sql("style", _EN, f"SELECT sku_id, count(*) AS n_observations, sum(actual) AS total_actual, {q('sum(forecast)', 2)} AS total_forecast, {q('sum(abs(forecast-actual))', 2)} AS absolute_error, {q('sum(abs(forecast-actual))/(SELECT sum(abs(forecast-actual)) FROM mt)', 6)} AS share_of_total_error FROM mt GROUP BY 1 ORDER BY sum(abs(forecast-actual)) DESC, sku_id LIMIT 200", _EVAL))
def error_contributors(spark, d):
    out = I.error_contributors(matched(style(spark, d)))
    return rounded(out, total_forecast=2, absolute_error=2, share_of_total_error=6)


@query("unmatched_actuals", with_sql("style", _EN, "SELECT sku_id, target_week FROM ac WHERE NOT EXISTS (SELECT 1 FROM fc WHERE fc.sku_id = ac.sku_id AND fc.target_week = ac.target_week) ORDER BY 1,2 LIMIT 8", _EVAL))
def unmatched_actuals(spark, d):
    actuals, forecasts = _evaluation(style(spark, d))
    return EV.unmatched(EV.one_actual_per_week(actuals), forecasts)


_SHOCK = _HOLD + """,
 wi AS (SELECT target_week, row_number() OVER (ORDER BY target_week) - 1 AS k, count(*) OVER () AS kn FROM (SELECT DISTINCT target_week FROM sc)),
 sk AS (SELECT sc.*, CASE category WHEN 'Bedding & Bath' THEN 1.0::DOUBLE + least(0.80::DOUBLE, greatest(k - kn//2, 0)*0.06::DOUBLE) WHEN 'Storage & Organisation' THEN 1.0::DOUBLE - least(0.60::DOUBLE, greatest(k - kn//2, 0)*0.045::DOUBLE) ELSE 1.0::DOUBLE END AS f FROM sc JOIN wi USING (target_week)),
 sv AS (SELECT *, round_even(actual*f, 0) AS hit FROM sk)"""


def _score_sql(name: str, a: str, where: str, src: str) -> str:
    return (f"SELECT '{name}' AS scenario, count(*) AS rows, {q(wape_sql(a, 'prediction'), 5)} AS wape, {q('1-' + wape_sql(a, 'prediction'), 5)} AS accuracy, {q(bias_sql(a, 'prediction'), 5)} AS bias_relative, "
            f"{q(f'avg(CASE WHEN {a} BETWEEN lo AND hi THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)', 5)} AS interval_coverage FROM {src} {where}")


@query("scenario_shock", with_sql("style", _HN, " UNION ALL ".join([_score_sql("steady", "actual", "", "sv"), _score_sql("shock", "hit", "", "sv"), _score_sql("shock_focus", "hit", "WHERE f <> 1.0", "sv")]), _SHOCK))
def scenario_shock(spark, d):
    scored = holdout(style(spark, d))
    up, down = EV.pick_categories(["Bedding & Bath", "Decor", "Kitchen & Dining", "Lighting", "Small Appliances", "Storage & Organisation"])
    out = EV.scenario_table(scored, {"shock": EV.apply_shock(scored, up, down)})
    return rounded(out, wape=5, accuracy=5, bias_relative=5, interval_coverage=5)


def _by_number(sku, seed):
    """A third of the SKUs by their number, so that SQL can pick the same ones."""
    no = F.regexp_extract(sku, r"(\d+)$", 1).cast("long")
    return F.pmod(no + seed, F.lit(3)) == 0, F.lit(2.0) + F.pmod(no, F.lit(6)) / 2.0


_PROMO = _HOLD + """,
 wi AS (SELECT target_week, row_number() OVER (ORDER BY target_week) - 1 AS k, count(*) OVER () AS kn FROM (SELECT DISTINCT target_week FROM sc)),
 st AS (SELECT CAST(floor(4 + (kn - 10)*i/3.0::DOUBLE) AS BIGINT) AS b FROM (SELECT max(kn) AS kn FROM wi), (SELECT unnest([0, 1, 2, 3]) AS i)),
 pv AS (SELECT sc.*, CASE WHEN (no + 7) % 3 = 0 AND (k IN (SELECT b FROM st) OR k - 1 IN (SELECT b FROM st)) THEN 2.0::DOUBLE + (no % 6)/2.0::DOUBLE ELSE 1.0::DOUBLE END AS f FROM (SELECT *, CAST(regexp_extract(sku_id, '([0-9]+)$', 1) AS BIGINT) AS no FROM sc) sc JOIN wi USING (target_week)),
 pz AS (SELECT *, round_even(actual*f, 0) AS hit FROM pv)"""


@query("scenario_promo", with_sql("style", _HN, " UNION ALL ".join([_score_sql("steady", "actual", "", "pz"), _score_sql("promo", "hit", "", "pz"), _score_sql("promo_focus", "hit", "WHERE f <> 1.0", "pz")]), _PROMO))
def scenario_promo(spark, d):
    scored = holdout(style(spark, d))
    out = EV.scenario_table(scored, {"promo": EV.apply_promo_bursts(scored, 7, _by_number)})
    return rounded(out, wape=5, accuracy=5, bias_relative=5, interval_coverage=5)


# --------------------------------------------------------------------------- #
# Fitted models: what SQL can give of them stands in the SQL of their own queries and of fold_checks
# --------------------------------------------------------------------------- #
#: The forest of the benchmark; the published one has 300 trees of depth 12 on all rows (see the README).
FOREST = {"trees": 40, "depth": 7, "leaf": 5, "share": 0.3}


class Backtest:
    """Supervised rows written once, the origins of every fold, and the shelf that the queries of a session share."""

    def __init__(self, R):
        self.panel = cut(R.panel)
        self.rows, self.origins = cut(X.supervised_frame(X.base_features(self.panel), R.weeks, H)), B.backtest_origins(R.week_list)
        self.shelf, self.spec = Shelf.of(self.rows, about=R.spark.sparkContext.applicationId), X.feature_spec()

    def scores(self, candidates: dict):
        return B.backtest(self.rows, candidates, self.origins, shelf=self.shelf, spec=self.spec)


def _trees(fold, part="train", **named):
    name = "_".join(["trees", *[f"{k}-{v}" for k, v in sorted(named.items())]])
    return fold.model(name, lambda rows, prepared: T.fit_trees(rows, fold.spec, prepared=prepared, **named), part)


class _Banded:
    """Trees fitted before the last twelve target weeks; these weeks give the interval."""

    def __init__(self, fold):
        self.model = _trees(fold, "early")
        self.bands = BD.fit_bands(cut(self.model.predict(fold.rows("late"))), fold.prepared("early"))

    def predict(self, rows):
        return self.bands.interval(self.model.predict(rows))


_BENCHMARKS = {
    "linear_regression": lambda fold: fold.model("linear", lambda rows, prepared: T.fit_linear(rows, fold.spec, prepared)),
    "random_forest": lambda fold: fold.model("forest_" + "_".join(map(str, FOREST.values())),
                                             lambda rows, prepared: T.fit_forest(rows, fold.spec, prepared=prepared, **FOREST)),
    "squared_trees": lambda fold: _trees(fold, squared=True),
}


def _ensemble(panel):
    return lambda fold: E.fit_ensemble(fold.train, panel, None, point=_trees(fold), scoring=_trees(fold, "early"))


@query("gbt_forecast")
def gbt_forecast(spark, d):
    """Forecast and interval at the origin of every fold."""
    out = Backtest(style(spark, d)).scores({"gbt": _Banded})
    return out.select("sku_id", "week_start", "target_week", "horizon", "y", F.col("gbt").alias("prediction"),
                      F.col("gbt_lower").alias("prediction_lower"), F.col("gbt_upper").alias("prediction_upper"))


@query("feature_importance")
def feature_importance(spark, d):
    """Importance per feature for the trees of every fold."""
    bt = Backtest(style(spark, d))

    def weigh(numbered):
        fold = B.Fold(*numbered, bt.rows, bt.shelf, bt.spec)
        return T.feature_importance(_trees(fold), spark).select(
            F.lit(fold.number).alias("fold"), F.lit(fold.origin).alias("origin_week"), "feature", "importance")

    return union_all(side_by_side(weigh, list(enumerate(bt.origins, start=1)), spark))


def _smoothed(bt):
    return union_all([
        BL.damped_smoothing(bt.panel, o, H).select("sku_id", "week_start", "horizon", F.col("prediction").alias("damped_smoothing"))
        for o in bt.origins
    ])


@query("benchmark_models")
def benchmark_models(spark, d):
    bt = Backtest(style(spark, d))
    out = bt.scores(_BENCHMARKS).join(_smoothed(bt), B.KEY)
    return B.model_table(cut(out), [*_BENCHMARKS, "damped_smoothing"])


@query("ensemble_backtest")
def ensemble_backtest(spark, d):
    """Every fold of the ensemble and of its point model, the trees."""
    bt = Backtest(style(spark, d))
    rows = bt.scores({"trees": _trees, "ensemble": _ensemble(bt.panel)})
    return B.model_table(rows, ["baseline", "naive", "trees", "ensemble"])


_SMOOTH = """gd AS (SELECT a::DOUBLE AS a, b::DOUBLE AS b, d::DOUBLE AS d FROM (SELECT unnest([0.1, 0.3, 0.5, 0.8]) AS a), (SELECT unnest([0.05, 0.2]) AS b), (SELECT unnest([0.85, 0.98]) AS d)),
 sv AS MATERIALIZED (SELECT p.sku_id, o.week_start, list(p.units::DOUBLE ORDER BY p.week_start) AS v FROM panel p JOIN origins o ON p.week_start <= o.week_start GROUP BY 1, 2),
 sr AS (SELECT sku_id, week_start, v, d, list_reduce(list_prepend([v[1], 0.0::DOUBLE, 0.0::DOUBLE], list_transform(v[2:], lambda x: [x, 0.0::DOUBLE, 0.0::DOUBLE])),
   lambda s, x: [s[1] + d*s[2] + a*(x[1] - (s[1] + d*s[2])), d*s[2] + (a*b)*(x[1] - (s[1] + d*s[2])), s[3] + (x[1] - (s[1] + d*s[2]))*(x[1] - (s[1] + d*s[2]))]) AS s FROM sv CROSS JOIN gd),
 sb AS MATERIALIZED (SELECT sku_id, week_start, any_value(v) AS v, min({'e': s[3], 'd': d, 'l': s[1], 't': s[2]}) AS m FROM sr GROUP BY 1, 2),
 al AS (SELECT t.fold, t.y, t.baseline, t.naive, greatest(CASE WHEN len(v) < 10 THEN v[-1] ELSE m.l + m.t*(m.d*(1.0::DOUBLE - pow(m.d, t.horizon))/(1.0::DOUBLE - m.d)) END, 0) AS damped_smoothing
   FROM test t JOIN sb USING (sku_id, week_start)),
 lg AS (SELECT fold, y, unnest(['baseline', 'naive', 'damped_smoothing']) AS model, unnest([baseline, naive, damped_smoothing]) AS p FROM al),
 fw AS (SELECT fold, model, count(*) AS test_rows, sum(y) AS demand, sum(abs(y - p))/sum(abs(y)) AS wape FROM lg GROUP BY 1, 2),
 nv AS (SELECT fold, wape AS naive_wape, test_rows, demand FROM fw WHERE model = 'naive')"""


@query("backtest_checks", with_sql("style", ("panel", "sup", "origins", "test"), f"""SELECT fw.fold, model, fw.test_rows, fw.demand, {q('wape', 5)} AS wape, wape <= naive_wape AS no_worse_than_naive, NULL::BOOLEAN AS ordered, NULL::BOOLEAN AS covers FROM fw JOIN nv USING (fold)
 UNION ALL SELECT fold, 'linear_regression', test_rows, demand, NULL, true, NULL, NULL FROM nv
 UNION ALL SELECT fold, 'gbt', test_rows, demand, NULL, true, true, NULL FROM nv
 UNION ALL SELECT 0, 'gbt', sum(test_rows)::BIGINT, sum(demand), NULL, true, true, true FROM nv""", _SMOOTH))
def backtest_checks(spark, d):
    """Every fold: what closed forms give exactly, and what must hold of fitted models.

    All models score identical rows; the fitted ones are no worse than the last value, their bounds
    are ordered and, over all folds (fold 0), hold 80 % of outcomes to within three points.
    """
    bt = Backtest(style(spark, d))
    fitted = {"linear_regression": _BENCHMARKS["linear_regression"], "gbt": _Banded}
    rows = cut(bt.scores(fitted).join(_smoothed(bt), B.KEY))
    exact = ["baseline", "naive", "damped_smoothing"]
    ordered = (F.col("gbt_lower") >= 0) & (F.col("gbt_lower") <= F.col("gbt")) & (F.col("gbt") <= F.col("gbt_upper"))
    inside = F.avg(F.col("y").between(F.col("gbt_lower"), F.col("gbt_upper")).cast("double"))
    wape = {m: M.wape("y", m) for m in [*exact, *fitted]}

    def table(by, names, covers):
        facts = by.agg(F.count(F.lit(1)).alias("test_rows"), F.sum("y").alias("demand"), F.every(ordered).alias("_ordered"),
                       (F.abs(inside - 0.8) <= 0.03).alias("_covers"), *[w.alias(f"_{m}") for m, w in wape.items()])
        entries = [F.struct(
            F.lit(m).alias("model"), (fx(f"_{m}", 5) if m in exact else F.lit(None).cast("double")).alias("wape"),
            (F.col(f"_{m}") <= F.col("_naive")).alias("no_worse_than_naive"),
            (F.col("_ordered") if m == "gbt" else F.lit(None).cast("boolean")).alias("ordered"),
            (F.col("_covers") if m == "gbt" and covers else F.lit(None).cast("boolean")).alias("covers")) for m in names]
        return facts.select("fold", "test_rows", "demand", F.inline(F.array(*entries)))

    pooled = rows.withColumn("fold", F.lit(0))
    return table(rows.groupBy("fold"), [*exact, *fitted], False).unionByName(table(pooled.groupBy("fold"), ["gbt"], True))
