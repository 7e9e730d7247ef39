"""Risk, portfolio aggregates, read operators and streams."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from registry.core import part, q, query, rounded, style
from registry.panel import H, test_rows
from registry.sql import cdf_sql, pdf_sql, with_sql
from stockloom.contracts import ACTION_LABELS, DEFAULTS
from stockloom.functions import metrics as M
from stockloom.operators import features as X
from stockloom.operators import insights as I
from stockloom.operators import risk as R_
from stockloom.plans import queries as Q
from stockloom.session import cut, scratch_path
from stockloom.streaming import live


# --------------------------------------------------------------------------- #
# Risk: a 13-week mean forecast with one standard deviation either side
# --------------------------------------------------------------------------- #
def forecast(R, panel=None):
    panel = R.panel if panel is None else panel
    rows = X.inference_frame(X.base_features(panel), R.weeks, R.last_week, H, check=False)
    spread = F.coalesce("units_roll_std_13", F.lit(1.0))
    point = F.coalesce("units_roll_mean_13", F.lit(0.0))
    return rows.select(
        "sku_id", "week_start", "target_week", "horizon", "category",
        "weeks_since_launch", "cv_13",
        point.alias("prediction"),
        F.greatest(point - spread, F.lit(0.0)).alias("prediction_lower"),
        (point + spread).alias("prediction_upper"),
    )


def risk_inputs(R):
    # The last origin's features look back a year at most, and the latest snapshot of each SKU a month;
    # every series ends in the last week, so both read only the weeks that they can reach.
    near = R.panel_since(R.last_week - dt.timedelta(weeks=X.SEASON_WEEKS))
    R.inventory = R.inventory_of(near)
    rows = cut(forecast(R, near))
    features = rows.select("sku_id", "week_start", "weeks_since_launch", "cv_13").distinct()
    return rows, features


def risk_table(R, rank=True):
    rows, features = risk_inputs(R)
    return cut(R_.score_risk(rows, R.inventory, R.master, features=features, rank=rank))


_Z = DEFAULTS.coverage_z
_SZ = DEFAULTS.service_z
_K = "((lead_time_demand-available_units)/greatest(lead_time_sigma, 1e-9))"
_FC = """fc AS (SELECT f.sku_id, f.category, h.horizon, f.week_start + 7*h.horizon AS target_week, weeks_since_launch, cv_13, coalesce(units_roll_mean_13, 0) AS p, greatest(coalesce(units_roll_mean_13, 0) - coalesce(units_roll_std_13, 1), 0) AS lo, coalesce(units_roll_mean_13, 0) + coalesce(units_roll_std_13, 1) AS hi
  FROM feat f CROSS JOIN (SELECT unnest(range(1,9))::INT AS horizon) h WHERE f.week_start = (SELECT max(week_start) FROM panel)),
 pos AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sku_id ORDER BY "date" DESC) AS rn FROM inventory) WHERE rn = 1)"""


def _risk_from(pos: str, suffix: str = "") -> str:
    return f"""sm{suffix} AS (SELECT fc.sku_id, sum(p*w) AS lead_time_demand, sqrt(sum(pow(sg*w, 2))) AS lead_time_sigma, sum(p) AS horizon_demand, avg(sg) AS weekly_sigma FROM (SELECT fc.*, (hi-lo)/(2.0::DOUBLE*{_Z!r}::DOUBLE) AS sg, least(greatest(greatest(lead_time_days/7.0::DOUBLE, 0.1) - (horizon-1), 0.0), 1.0) AS w FROM fc JOIN {pos} pos ON pos.sku_id = fc.sku_id) fc GROUP BY 1),
 k0{suffix} AS (SELECT s.*, m.category, m.subcategory, m.unit_cost, m.list_price, on_hand_units, on_order_units, lead_time_days, on_hand_units + on_order_units AS available_units, horizon_demand/8.0::DOUBLE AS mwf FROM sm{suffix} s JOIN {pos} pos ON pos.sku_id = s.sku_id LEFT JOIN master m ON m.sku_id = s.sku_id),
 k1{suffix} AS (SELECT *, CASE WHEN lead_time_sigma > 1e-9 THEN least(greatest(1.0 - {cdf_sql('((available_units-lead_time_demand)/greatest(lead_time_sigma, 1e-9))')}, 0.0), 1.0) ELSE CAST(lead_time_demand > available_units AS DOUBLE) END AS stockout_score,
   {_SZ!r}::DOUBLE*lead_time_sigma AS safety_stock_units, CASE WHEN lead_time_sigma > 1e-9 THEN greatest(lead_time_sigma*({_K}*{cdf_sql(_K)} + {pdf_sql(_K)}), 0.0) ELSE greatest(lead_time_demand-available_units, 0.0) END AS expected_lost_units,
   CASE WHEN available_units <= 1e-9 THEN 0.0::DOUBLE WHEN weekly_sigma*sqrt(12.0::DOUBLE) > 1e-9 THEN least(greatest({cdf_sql('((available_units-mwf*12.0::DOUBLE)/greatest(weekly_sigma*sqrt(12.0::DOUBLE), 1e-9))')}, 0.0), 1.0) ELSE CAST(available_units > mwf*12.0 AS DOUBLE) END AS overstock_score,
   CASE WHEN available_units <= 1e-9 THEN 0.0::DOUBLE WHEN mwf > 1e-9 THEN available_units/mwf ELSE 999.0::DOUBLE END AS cover_weeks, CAST(ceil(greatest(available_units - mwf*12.0::DOUBLE, 0.0)) AS DOUBLE) AS excess_units, CASE WHEN mwf > 0.5 THEN weekly_sigma/mwf ELSE 0.0::DOUBLE END AS forecast_cv FROM k0{suffix}),
 k2{suffix} AS (SELECT *, CAST(ceil(greatest(lead_time_demand + safety_stock_units - available_units, 0.0)) AS DOUBLE) AS recommended_order_units, round_even(expected_lost_units*list_price, 2) AS rar, round_even(expected_lost_units*greatest(list_price-unit_cost, 0), 2) AS mar, round_even(excess_units*unit_cost, 2) AS lc,
   least(forecast_cv/0.75::DOUBLE, 1.0) AS volatility_score, CASE WHEN forecast_cv >= 0.75 AND (stockout_score >= 0.25 OR overstock_score >= 0.25) THEN 'watch_volatile' WHEN stockout_score >= 0.5 AND overstock_score < 0.5 THEN 'reorder_now' WHEN overstock_score >= 0.5 AND stockout_score < 0.5 THEN 'markdown_clear'
   WHEN stockout_score >= 0.5 THEN 'watch_volatile' ELSE 'healthy' END AS action FROM k1{suffix})"""


_LEVEL = "CASE WHEN {s} >= 0.8 THEN 'critical' WHEN {s} >= 0.5 THEN 'high' WHEN {s} >= 0.25 THEN 'medium' WHEN {s} >= 0.05 THEN 'low' ELSE 'none' END"
_LABEL = "CASE action " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ACTION_LABELS.items()) + " END"
_RISK = _FC + ",\n " + _risk_from("pos") + """,
 cnf AS (SELECT DISTINCT sku_id, CASE WHEN weeks_since_launch < 26 THEN 'low' WHEN coalesce(cv_13, 0) >= 1.0 THEN 'medium' ELSE 'high' END AS forecast_confidence FROM fc),
 rk AS (SELECT k.*, forecast_confidence, greatest(rar, lc) AS value_at_stake, row_number() OVER (ORDER BY round_even(greatest(rar, lc), 2) DESC, k.sku_id) AS priority_rank FROM k2 k LEFT JOIN cnf ON cnf.sku_id = k.sku_id)"""
_RN = ("feat", "inventory", "master")
_MONEY = ["revenue_at_risk", "margin_at_risk", "locked_capital", "value_at_stake"]


@query("risk_table", with_sql("part", _RN, f"""SELECT sku_id, category, subcategory, on_hand_units, on_order_units, lead_time_days, available_units, {q('lead_time_demand', 3)} AS lead_time_demand, {q('lead_time_sigma', 3)} AS lead_time_sigma, {q('horizon_demand', 3)} AS horizon_demand, {q('weekly_sigma', 3)} AS weekly_sigma,
  {q('stockout_score', 4)} AS stockout_score, {q('safety_stock_units', 3)} AS safety_stock_units, recommended_order_units, {q('expected_lost_units', 3)} AS expected_lost_units, {q('cover_weeks', 3)} AS cover_weeks, {q('overstock_score', 4)} AS overstock_score, excess_units,
  {q('rar', 1)} AS revenue_at_risk, {q('mar', 1)} AS margin_at_risk, {q('lc', 1)} AS locked_capital, {q('value_at_stake', 1)} AS value_at_stake, {q('forecast_cv', 4)} AS forecast_cv, {q('volatility_score', 4)} AS volatility_score, action, {_LABEL} AS action_label,
  {_LEVEL.format(s='stockout_score')} AS stockout_level, {_LEVEL.format(s='overstock_score')} AS overstock_level, forecast_confidence FROM rk""", _RISK))
def risk_table_query(spark, d):
    out = risk_table(part(spark, d), rank=False)
    cols = ["sku_id", "category", "subcategory", "on_hand_units", "on_order_units", "lead_time_days", "available_units",
            "lead_time_demand", "lead_time_sigma", "horizon_demand", "weekly_sigma", "stockout_score",
            "safety_stock_units", "recommended_order_units", "expected_lost_units", "cover_weeks", "overstock_score",
            "excess_units", *_MONEY, "forecast_cv", "volatility_score", "action", "action_label", "stockout_level",
            "overstock_level", "forecast_confidence"]
    return rounded(
        out.select(*cols), lead_time_demand=3, lead_time_sigma=3, horizon_demand=3, weekly_sigma=3, stockout_score=4,
        safety_stock_units=3, expected_lost_units=3, cover_weeks=3, overstock_score=4, forecast_cv=4,
        volatility_score=4, **{m: 1 for m in _MONEY},
    )


@query("priority_ranking", with_sql("part", _RN, "SELECT sku_id, priority_rank, action FROM rk", _RISK))
def priority_ranking(spark, d):
    return risk_table(part(spark, d)).select("sku_id", "priority_rank", "action")


@query("worklist_page", with_sql("part", _RN, "SELECT sku_id, category, priority_rank FROM rk WHERE category = 'Lighting' ORDER BY priority_rank LIMIT 50 OFFSET 25", _RISK))
def worklist_page(spark, d):
    rows = Q.worklist(risk_table(part(spark, d)), category="lighting", limit=50, offset=25)
    return rows.select("sku_id", "category", "priority_rank")


_SUMS = {"revenue_at_risk": "rar", "margin_at_risk": "mar", "locked_capital": "lc", "expected_lost_units": "expected_lost_units", "excess_units": "excess_units"}


_MONEY_SQL = {c: (e if c in ("expected_lost_units", "excess_units") else f"round_even({e}, 2)") for c, e in _SUMS.items()}


@query("impact_by_action", with_sql("part", _RN, "SELECT action, count(*) AS skus, " + ", ".join(f"{q(f'sum({e})', 0)} AS {c}" for c, e in _MONEY_SQL.items()) + " FROM rk GROUP BY 1", _RISK))
def impact_by_action(spark, d):
    return rounded(I.impact_by_action(risk_table(part(spark, d), rank=False)), **{c: 0 for c in _SUMS})


@query("aggregate_impact", with_sql("part", _RN, f"""SELECT count(*) AS total_skus, 8 AS horizon_weeks, {q('sum(round_even(rar, 2))', 0)} AS revenue_at_risk_total, {q('sum(round_even(mar, 2))', 0)} AS margin_at_risk_total, {q('sum(round_even(lc, 2))', 0)} AS locked_capital_total, {q('sum(expected_lost_units)', 1)} AS expected_lost_units_total, sum(excess_units) AS excess_units_total,
  count(*) FILTER (action = 'reorder_now') AS reorder_now_skus, {q("coalesce(sum(round_even(rar, 2)) FILTER (action = 'reorder_now'), 0)", 0)} AS reorder_now_revenue_at_risk, coalesce(sum(recommended_order_units) FILTER (action = 'reorder_now'), 0) AS reorder_now_order_units, count(*) FILTER (action = 'markdown_clear') AS markdown_skus,
  {q("coalesce(sum(round_even(lc, 2)) FILTER (action = 'markdown_clear'), 0)", 0)} AS markdown_locked_capital, count(*) FILTER (action = 'watch_volatile') AS watch_skus, count(*) FILTER (action = 'healthy') AS healthy_skus, count(*) FILTER (forecast_confidence = 'low') AS low_confidence_skus,
  {q('(SELECT sum(x) FROM (SELECT round_even(rar, 2) AS x FROM rk ORDER BY round_even(rar, 2) DESC, sku_id LIMIT 10))/greatest(sum(round_even(rar, 2)), 1e-9)', 5)} AS top_10_share_of_revenue_at_risk FROM rk""", _RISK))
def aggregate_impact(spark, d):
    out = I.aggregate_impact(risk_table(part(spark, d), rank=False))
    return rounded(out, revenue_at_risk_total=0, margin_at_risk_total=0, locked_capital_total=0,
                   expected_lost_units_total=1, reorder_now_revenue_at_risk=0, markdown_locked_capital=0,
                   top_10_share_of_revenue_at_risk=5)


@query("decision_grid", with_sql("part", _RN, f"""SELECT sku_id, category, subcategory, {q('stockout_score', 4)} AS stockout_score, {q('overstock_score', 4)} AS overstock_score, action, {_LABEL} AS action_label, {q('value_at_stake', 1)} AS value_at_stake, {q('rar', 1)} AS revenue_at_risk, {q('lc', 1)} AS locked_capital, {q('cover_weeks', 3)} AS cover_weeks, available_units, forecast_confidence,
  CASE WHEN overstock_score > stockout_score THEN 'overstock' ELSE 'stockout' END AS dominant_risk, {q('greatest(overstock_score, stockout_score)', 4)} AS dominant_score, CASE WHEN recommended_order_units > 0 THEN recommended_order_units WHEN excess_units > 0 THEN -excess_units ELSE 0.0::DOUBLE END AS suggested_units FROM rk""", _RISK))
def decision_grid(spark, d):
    out = R_.decision_grid(risk_table(part(spark, d), rank=False))
    return rounded(out, stockout_score=4, overstock_score=4, value_at_stake=1, revenue_at_risk=1, locked_capital=1,
                   cover_weeks=3, dominant_score=4)


# Supplied positions: every third product with its stock halved, some unknown.
def positions(R):
    no = F.regexp_extract("sku_id", r"(\d+)$", 1).cast("long")
    given = R.inventory.groupBy("sku_id").agg(F.max_by("on_hand_units", "date").alias("h")).filter(no % 3 == 0)
    unknown = given.filter(no % 30 == 0).select(F.concat(F.lit("X-"), F.col("sku_id")).alias("sku_id"), F.lit(1.0).alias("h"))
    return given.unionByName(unknown).select(
        F.concat(F.lit(" "), F.lower("sku_id")).alias("sku_id"), F.floor(F.col("h") / 2).cast("double").alias("on_hand_units"),
    )


_LIVE = _RISK + """,
 given AS (SELECT * REPLACE (CAST(floor(on_hand_units/2) AS DOUBLE) AS on_hand_units) FROM pos WHERE CAST(regexp_extract(sku_id, '([0-9]+)$', 1) AS BIGINT) % 3 = 0),
 """ + _risk_from("given", "g")


@query("live_rescore", with_sql("part", _RN, f"SELECT g.sku_id, g.available_units, {q('g.stockout_score', 4)} AS stockout_score, {q('g.overstock_score', 4)} AS overstock_score, g.action, rk.forecast_confidence FROM k2g g JOIN rk ON rk.sku_id = g.sku_id", _LIVE))
def live_rescore(spark, d):
    R = part(spark, d)
    rows, features = risk_inputs(R)
    stored = cut(R_.score_risk(rows, R.inventory, R.master, features=features, rank=False))
    out = R_.rescore(positions(R), stored, rows, R.master, rank=False)
    return rounded(out.select("sku_id", "available_units", "stockout_score", "overstock_score", "action", "forecast_confidence"), stockout_score=4, overstock_score=4)


@query("live_unknown_products", with_sql("part", "inventory", "SELECT DISTINCT 'X-' || sku_id AS sku_id FROM inventory WHERE CAST(regexp_extract(sku_id, '([0-9]+)$', 1) AS BIGINT) % 30 = 0"))
def live_unknown_products(spark, d):
    R = part(spark, d)
    return R_.unknown_positions(positions(R), R.master)


@query("forecast_lookup", with_sql("part", _RN, f"SELECT i.sku_id, horizon, target_week, {q('p', 3)} AS prediction, action, horizon IS NOT NULL AS found FROM (SELECT DISTINCT sku_id FROM pos WHERE CAST(regexp_extract(sku_id, '([0-9]+)$', 1) AS BIGINT) % 3 = 0 UNION ALL SELECT 'X-' || sku_id FROM pos WHERE CAST(regexp_extract(sku_id, '([0-9]+)$', 1) AS BIGINT) % 30 = 0) i LEFT JOIN fc ON fc.sku_id = i.sku_id LEFT JOIN rk ON rk.sku_id = i.sku_id", _RISK))
def forecast_lookup(spark, d):
    R = part(spark, d)
    rows, features = risk_inputs(R)
    table = R_.score_risk(rows, R.inventory, R.master, features=features, rank=False)
    ids = positions(R).withColumn("_row_seq", F.col("sku_id"))
    out = Q.forecast_for(ids, rows, table)
    return rounded(out.select("sku_id", "horizon", "target_week", "prediction", "action", "found"), prediction=3)


@query("portfolio_summary", with_sql("part", (*_RN, "test"), f"SELECT count(*) AS total_skus, count(*) FILTER (action = 'reorder_now') AS reorder_now_skus, (SELECT {q('sum(abs(y-baseline))/sum(abs(y))', 5)} FROM test) AS baseline_wape, (SELECT {q('sum(abs(y-naive))/sum(abs(y))', 5)} FROM test) AS naive_wape FROM rk", _RISK))
def portfolio_summary(spark, d):
    R = part(spark, d)
    accuracy = test_rows(R).agg(M.wape("y", "baseline").alias("baseline_wape"), M.wape("y", "naive").alias("naive_wape"))
    out = Q.portfolio_summary(risk_table(R, rank=False), accuracy)
    return rounded(out.select("total_skus", "reorder_now_skus", "baseline_wape", "naive_wape"), baseline_wape=5, naive_wape=5)


@query("product_performance", with_sql("part", _RN, f"""SELECT t.sku_id, t.category, t.subcategory, {q('total_revenue', 1)} AS total_revenue, total_units, {q('total_revenue/(SELECT sum(revenue) FROM panel)', 7)} AS revenue_share, {q('CASE WHEN n >= 16 AND prior > 0 THEN (recent-prior)/prior ELSE 0 END', 4)} AS recent_trend_pct, coalesce(action, 'unknown') AS action, {q('coalesce(value_at_stake, 0)', 1)} AS value_at_stake FROM (
  SELECT sku_id, category, subcategory, sum(revenue) AS total_revenue, sum(units) AS total_units, count(*) AS n, sum(CASE WHEN rn <= 8 THEN revenue ELSE 0 END) AS recent, sum(CASE WHEN rn BETWEEN 9 AND 16 THEN revenue ELSE 0 END) AS prior FROM (SELECT *, row_number() OVER (PARTITION BY sku_id ORDER BY week_start DESC) AS rn FROM panel) GROUP BY 1,2,3) t LEFT JOIN rk ON rk.sku_id = t.sku_id
  ORDER BY t.total_revenue DESC, t.sku_id LIMIT 200""", _RISK))
def product_performance(spark, d):
    R = part(spark, d)
    out = I.product_performance(R.panel, risk_table(R, rank=False))
    return rounded(out.drop("action_label"), total_revenue=1, revenue_share=7, recent_trend_pct=4, value_at_stake=1)


@query("sku_detail", with_sql("style", ("panel", "test"), """SELECT 'history' AS kind, week_start AS week, units AS value FROM (SELECT *, row_number() OVER (ORDER BY week_start DESC) AS rn FROM panel WHERE sku_id = 'NBL-LGT-007') WHERE rn <= 104
  UNION ALL SELECT 'backtest', target_week, y FROM (SELECT *, row_number() OVER (PARTITION BY target_week ORDER BY week_start DESC) AS rn FROM test WHERE sku_id = 'NBL-LGT-007') WHERE rn = 1"""))
def sku_detail(spark, d):
    R = style(spark, d)
    empty = forecast(R)
    parts = Q.sku_detail("nbl-lgt-007", R.panel, test_rows(R), empty, empty)
    history = parts["history"].select(F.lit("history").alias("kind"), F.col("week_start").alias("week"), F.col("units").alias("value"))
    past = parts["backtest"].select(F.lit("backtest").alias("kind"), F.col("target_week").alias("week"), F.col("y").alias("value"))
    return history.unionByName(past)


# --------------------------------------------------------------------------- #
# Portfolio aggregates
# --------------------------------------------------------------------------- #
@query("sales_trend", with_sql("part", "panel", f"SELECT week_start, sum(units) AS units, {q('sum(revenue)', 0)} AS revenue, count(DISTINCT sku_id) AS sku_count FROM panel GROUP BY 1 ORDER BY 1 DESC LIMIT 104"))
def sales_trend(spark, d):
    return rounded(I.sales_trend(part(spark, d).panel), revenue=0)


@query("category_totals", with_sql("part", "panel", f"SELECT category, sum(units) AS units, {q('sum(revenue)', 0)} AS revenue, count(DISTINCT sku_id) AS sku_count FROM panel GROUP BY 1"))
def category_totals(spark, d):
    return rounded(I.category_totals(part(spark, d).panel), revenue=0)


@query("category_summary", with_sql("part", "panel", f"SELECT category, count(DISTINCT sku_id) AS skus, sum(units) AS total_units, {q('sum(revenue)', 0)} AS total_revenue, {q('avg(units)', 4)} AS mean_weekly_units, {q('avg(CASE WHEN units <= 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)', 5)} AS zero_week_share FROM panel GROUP BY 1"))
def category_summary(spark, d):
    return rounded(I.category_summary(part(spark, d).panel), total_revenue=0, mean_weekly_units=4, zero_week_share=5)


_SI = """si AS (SELECT category, weekofyear(week_start) AS iso_week, avg(units) AS m FROM panel GROUP BY 1,2), cm AS (SELECT category, avg(units) AS c FROM panel GROUP BY 1)"""


@query("seasonal_index", with_sql("part", "panel", f"SELECT si.category, iso_week, {q('m', 4)} AS mean_units, {q('m/greatest(c, 1e-9)', 5)} AS seasonal_index FROM si JOIN cm ON cm.category = si.category", _SI))
def seasonal_index(spark, d):
    return rounded(I.seasonal_index(part(spark, d).panel), mean_units=4, seasonal_index=5)


@query("peak_week_by_category", with_sql("part", "panel", "SELECT si.category, max_by(iso_week, m) AS peak_iso_week FROM si GROUP BY 1", _SI))
def peak_week_by_category(spark, d):
    return I.peak_week(I.seasonal_index(part(spark, d).panel))


@query("promo_uplift", with_sql("style", "panel", f"SELECT category, {q('off', 4)} AS off_promo, {q('onp', 4)} AS on_promo, {q('onp/off - 1', 5)} AS uplift_pct FROM (SELECT category, avg(units) FILTER (promo_days = 0) AS off, avg(units) FILTER (promo_days > 0) AS onp FROM panel GROUP BY 1)"))
def promo_uplift(spark, d):
    return rounded(I.promo_effect(style(spark, d).panel), off_promo=4, on_promo=4, uplift_pct=5)


_PARETO = """ps AS (SELECT sku_id, sum(revenue) AS r FROM panel GROUP BY 1),
 pc AS (SELECT sku_id, r, row_number() OVER (ORDER BY r DESC, sku_id) AS rank, sum(r) OVER (ORDER BY r DESC, sku_id)/sum(r) OVER () AS cum, count(*) OVER () AS n FROM ps)"""


@query("pareto_curve", with_sql("part", "panel", f"SELECT sku_id, {q('r', 1)} AS revenue, rank, {q('rank/n::DOUBLE', 6)} AS sku_share, {q('cum', 6)} AS cumulative_share FROM pc", _PARETO))
def pareto_curve(spark, d):
    return rounded(I.pareto(part(spark, d).panel), revenue=1, sku_share=6, cumulative_share=6)


@query("pareto_concentration", with_sql("part", "panel", f"SELECT {q('max(cum) FILTER (rank/n::DOUBLE <= 0.2)', 5)} AS revenue_share_of_top_20pct_skus, count(*) FILTER (cum <= 0.5) + 1 AS skus_for_50pct, count(*) FILTER (cum <= 0.8) + 1 AS skus_for_80pct, count(*) FILTER (cum <= 0.9) + 1 AS skus_for_90pct, count(*) AS skus_total FROM pc", _PARETO))
def pareto_concentration(spark, d):
    return rounded(I.pareto_figures(I.pareto(part(spark, d).panel)), revenue_share_of_top_20pct_skus=5)


@query("revenue_concentration", with_sql("part", "panel", f"SELECT f AS sku_fraction, rank AS sku_count, {q('cum', 5)} AS revenue_share FROM pc JOIN (SELECT unnest([0.1::DOUBLE, 0.2, 0.5]) AS f) ON rank = greatest(1, CAST(round_even(n*f, 0) AS BIGINT))", _PARETO))
def revenue_concentration(spark, d):
    return rounded(I.revenue_concentration(part(spark, d).panel), revenue_share=5)


@query("demand_decline", with_sql("part", "panel", f"""SELECT sku_id, {q('a', 4)} AS recent_weekly_units, {q('b', 4)} AS prior_weekly_units, {q('1-a/b', 5)} AS decline_pct FROM (SELECT sku_id, avg(units) FILTER (week_start > l - 91) AS a, avg(units) FILTER (week_start > l - 455 AND week_start <= l - 364) AS b
  FROM panel, (SELECT max(week_start) AS l FROM panel) GROUP BY 1) WHERE a IS NOT NULL AND b > 0 ORDER BY 1-a/b DESC, sku_id LIMIT 15"""))
def demand_decline(spark, d):
    return rounded(I.demand_decline(part(spark, d).panel), recent_weekly_units=4, prior_weekly_units=4, decline_pct=5)


@query("headline_figures", with_sql("style", "panel", f"""SELECT (SELECT week_start FROM wk0 ORDER BY u DESC, week_start LIMIT 1) AS peak_week, max(u) AS peak_units, (SELECT week_start FROM wk0 ORDER BY u, week_start LIMIT 1) AS trough_week, min(u) AS trough_units, {q('max(u)/greatest(min(u), 1)', 5)} AS swing,
  (SELECT {q('avg(CASE WHEN z >= 0.35 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)', 5)} FROM (SELECT sku_id, avg(CASE WHEN units <= 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS z FROM panel WHERE week_start > (SELECT max(week_start) - 91 FROM panel) GROUP BY 1)) AS intermittent_share,
  (SELECT {q('avg(units) FILTER (promo_days > 0)/greatest(avg(units) FILTER (promo_days = 0), 1e-9) - 1', 5)} FROM panel) AS promo_lift FROM wk0""", "wk0 AS (SELECT week_start, sum(units) AS u FROM panel GROUP BY 1)"))
def headline_figures(spark, d):
    return rounded(I.headline_figures(style(spark, d).panel), swing=5, intermittent_share=5, promo_lift=5)


@query("tail_profile", with_sql("part", "panel", f"SELECT {q('quantile_cont(z, 0.5)', 5)} AS median_zero_share, count(*) FILTER (z >= 0.35) AS skus_heavy, count(*) AS skus FROM (SELECT sku_id, avg(CASE WHEN units <= 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS z FROM panel GROUP BY 1)"))
def tail_profile(spark, d):
    return rounded(I.tail_profile(part(spark, d).panel), median_zero_share=5)


@query("dead_stock", with_sql("part", "panel", """SELECT sku_id, category, subcategory, consecutive_zero_weeks, last_sale_week FROM (SELECT p.sku_id, category, subcategory, max(ls) AS last_sale_week, count(*) FILTER (ls IS NULL OR week_start > ls) AS consecutive_zero_weeks
  FROM panel p LEFT JOIN (SELECT sku_id, max(week_start) AS ls FROM panel WHERE units > 0 GROUP BY 1) l ON l.sku_id = p.sku_id GROUP BY 1,2,3) WHERE consecutive_zero_weeks >= 8"""))
def dead_stock(spark, d):
    return I.dead_stock(part(spark, d).panel)


_MV = """mv AS (SELECT *, (recent_revenue-prior_revenue)/prior_revenue AS ch FROM (SELECT sku_id, category, count(*) AS n, sum(CASE WHEN rn <= 8 THEN revenue ELSE 0 END) AS recent_revenue, sum(CASE WHEN rn BETWEEN 9 AND 16 THEN revenue ELSE 0 END) AS prior_revenue FROM (SELECT *, row_number() OVER (PARTITION BY sku_id ORDER BY week_start DESC) AS rn FROM panel) GROUP BY 1,2) WHERE n >= 16 AND prior_revenue > 0)"""
_MVC = f"sku_id, category, {q('recent_revenue', 1)} AS recent_revenue, {q('prior_revenue', 1)} AS prior_revenue, {q('ch', 4)} AS change_pct"


@query("top_movers", with_sql("style", "panel", f"(SELECT {_MVC}, 'gainer' AS direction FROM mv ORDER BY ch DESC, sku_id LIMIT 10) UNION ALL (SELECT {_MVC}, 'decliner' FROM mv ORDER BY ch, sku_id LIMIT 10)", _MV))
def top_movers(spark, d):
    return rounded(I.top_movers(style(spark, d).panel), recent_revenue=1, prior_revenue=1, change_pct=4)


# --------------------------------------------------------------------------- #
# Streams over files, run to the end of the input
# --------------------------------------------------------------------------- #
@query("live_rescore_stream", with_sql("part", _RN, f"SELECT g.sku_id, g.available_units, {q('g.stockout_score', 4)} AS stockout_score, g.action FROM k2g g", _LIVE))
def live_rescore_stream(spark, d):
    R = part(spark, d)
    rows, features = risk_inputs(R)
    stored = cut(R_.score_risk(rows, R.inventory, R.master, features=features, rank=False))
    source, out, state = (scratch_path(spark, n) for n in ("positions", "rescored", "state"))
    now = positions(R).withColumns(
        {"event_id": F.xxhash64("sku_id"), "event_time": F.lit("2001-11-05 08:00:00").cast("timestamp")}
    )
    # Three batches: a first position, the current one twice, and an older one that comes late.
    wrong = now.withColumn("on_hand_units", F.col("on_hand_units") + 1000)
    early = wrong.withColumn("event_time", F.lit("2001-11-04 08:00:00").cast("timestamp"))
    late = wrong.withColumn("event_time", F.lit("2001-11-05 07:00:00").cast("timestamp"))
    # Each comes as a folder of several files, and the stream goes on from its checkpoint.
    for k, batch in enumerate((early, now.unionByName(now), late)):
        batch.repartition(4).write.parquet(f"{source}/part={k}")
        stream = spark.readStream.schema(now.schema).option("recursiveFileLookup", "true").parquet(source)
        live.stream_rescore(stream, stored, rows, R.master, out, state).awaitTermination()
    done = spark.read.parquet(out)
    fields = ["available_units", "stockout_score", "action"]
    last = done.groupBy("sku_id").agg(F.max_by(F.struct(*fields), "batch_id").alias("r")).select("sku_id", "r.*")
    return rounded(last, stockout_score=4)


@query("accuracy_stream", with_sql("style", ("test", "master"), f"""SELECT target_week AS week_start, category, count(*) AS rows, {q('sum(abs(y-baseline))/nullif(sum(abs(y)),0)', 5)} AS wape, {q('sum(baseline-y)/nullif(sum(abs(y)),0)', 5)} AS bias_relative, {q('avg(CASE WHEN y BETWEEN baseline*0.5 AND baseline*1.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)', 5)} AS coverage
  FROM (SELECT *, row_number() OVER (PARTITION BY sku_id, target_week ORDER BY week_start DESC) AS rn FROM test) WHERE rn = 1 AND target_week < (SELECT max(target_week) - 14 FROM test) GROUP BY 1,2"""))
def accuracy_stream(spark, d):
    """Weeks whose 14-day watermark has passed when the input ends."""
    from stockloom.operators.lookup import latest_origin

    R = style(spark, d)
    scored = cut(latest_origin(test_rows(R)))
    plan = scored.select(
        "sku_id", "target_week", "category", F.col("baseline").alias("prediction"),
        (F.col("baseline") * 0.5).alias("prediction_lower"), (F.col("baseline") * 1.5).alias("prediction_upper"),
    )
    source, out, state = (scratch_path(spark, n) for n in ("actuals", "accuracy", "state"))
    actuals = scored.select(
        "sku_id", F.col("y").alias("units"),
        (F.col("target_week").cast("timestamp") + F.expr("interval 12 hours")).alias("event_time"),
    )
    # A quarter of the time in each folder of several files; every actual is first stated wrong, then restated, then repeated.
    first = actuals.withColumns({"units": F.col("units") * 2 + 1, "event_time": F.col("event_time") - F.expr("interval 6 hours")})
    sent = first.unionByName(actuals).unionByName(actuals)
    span = actuals.agg(F.min("event_time").alias("lo"), F.max("event_time").alias("hi")).first()
    edges = [span["lo"] - dt.timedelta(days=7), *(span["lo"] + (span["hi"] - span["lo"]) * k / 4 for k in (1, 2, 3)), span["hi"]]
    for k, (lo, hi) in enumerate(zip(edges, edges[1:])):  # one run a folder, on one checkpoint
        sent.filter((F.col("event_time") > F.lit(lo)) & (F.col("event_time") <= F.lit(hi))).repartition(4).write.parquet(f"{source}/part={k}")
        stream = spark.readStream.schema(actuals.schema).option("recursiveFileLookup", "true").parquet(source)
        live.stream_accuracy(stream, plan, out, state).awaitTermination()
    return rounded(spark.read.parquet(out), wape=5, bias_relative=5, coverage=5)


