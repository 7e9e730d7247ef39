"""Hierarchy roll-ups and coherent forecasts, on the part catalogue."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from registry.core import fx, part, q, query, rounded
from registry.panel import H
from registry.sql import wape_sql, with_sql
from stockloom.models import baseline as BL
from stockloom.operators import features as X
from stockloom.operators import hierarchy as G
from stockloom.session import cut

_EDGES = """ed AS (SELECT sku_id AS node, 'SUB::' || category || '|' || subcategory AS parent, 'sku' AS level FROM master UNION ALL SELECT DISTINCT 'SUB::' || category || '|' || subcategory, 'CAT::' || category, 'subcategory' FROM master
  UNION ALL SELECT DISTINCT 'CAT::' || category, 'TOTAL', 'category' FROM master UNION ALL SELECT 'TOTAL', NULL, 'total')"""


@query("hierarchy_edges", with_sql("part", "master", "SELECT node, parent, level FROM ed", _EDGES))
def hierarchy_edges(spark, d):
    return G.hierarchy_edges(part(spark, d).master)


_W = "greatest(units, 0)"


def _weighted(c: str) -> str:
    return f"coalesce(CASE WHEN sum({_W}) > 0 THEN sum({c}*{_W})/sum({_W}) END, avg({c}))"


_AGG = f"""ag AS (SELECT CASE WHEN g = 3 THEN 'TOTAL' WHEN g = 1 THEN 'CAT::' || category ELSE 'SUB::' || category || '|' || subcategory END AS sku_id, week_start, units, revenue, list_price, unit_cost, promo_days, holiday_days, weeks_since_launch, launch_date, is_post_launch,
  coalesce(category, '__ALL__') AS category, coalesce(subcategory, '__ALL__') AS subcategory, CASE WHEN g = 3 THEN 'total' WHEN g = 1 THEN 'category' ELSE 'subcategory' END AS node_level, CASE WHEN units > 0 THEN revenue/units ELSE list_price END AS avg_price FROM (
  SELECT grouping_id(category, subcategory) AS g, category, subcategory, week_start, sum(units) AS units, sum(revenue) AS revenue, {_weighted('list_price')} AS list_price, {_weighted('unit_cost')} AS unit_cost, {_weighted('promo_days')} AS promo_days, max(holiday_days) AS holiday_days,
  max(weeks_since_launch) AS weeks_since_launch, min(launch_date) AS launch_date, max(is_post_launch) AS is_post_launch FROM panel GROUP BY GROUPING SETS ((week_start), (week_start, category), (week_start, category, subcategory))))"""


@query("hierarchy_rollup", with_sql("part", "panel", f"SELECT sku_id, week_start, node_level, category, subcategory, units, {q('revenue', 1)} AS revenue, {q('list_price', 3)} AS list_price, {q('unit_cost', 3)} AS unit_cost, {q('promo_days', 4)} AS promo_days, {q('avg_price', 3)} AS avg_price, holiday_days, weeks_since_launch, launch_date, is_post_launch FROM ag", _AGG))
def hierarchy_rollup(spark, d):
    out = G.aggregate_panel(part(spark, d).panel)
    return rounded(out, revenue=1, list_price=3, unit_cost=3, promo_days=4, avg_price=3).select(
        "sku_id", "week_start", "node_level", "category", "subcategory", "units", "revenue", "list_price",
        "unit_cost", "promo_days", "avg_price", "holiday_days", "weeks_since_launch", "launch_date", "is_post_launch",
    )


# Forecasts of SKUs and nodes from the last 24 labelled origins: seasonal-naive for the
# nodes, the 13-week mean for the SKUs.
class _Fit:
    def __init__(self, column):
        self.column = column

    def __call__(self, train):
        return lambda rows: rows.withColumn("prediction", self.column)


def residuals(R):
    """Residuals of SKUs, worked out where they are read, and of nodes, which are few and written."""
    cutoff = R.week_list[-32]
    # No feature of an origin looks back further than a year.
    reach = cutoff - dt.timedelta(weeks=X.SEASON_WEEKS)
    panel = R.panel_since(reach).select(
        "sku_id", "category", "subcategory", "week_start", "units", "revenue", "list_price", "unit_cost", "promo_days",
        "holiday_days", "weeks_since_launch", "launch_date", "is_post_launch", "avg_price")
    sku = G.harvest_residuals(
        X.expand_horizons(X.add_rolling(panel), H, True), cutoff,
        _Fit(F.coalesce("units_roll_mean_13", F.lit(0.0))), least=False,
    )
    node = G.harvest_residuals(
        X.expand_horizons(X.add_rolling(G.aggregate_panel(panel)), H, True), cutoff,
        _Fit(BL.seasonal_naive()), least=False,
    )
    return sku, cut(node)


_ROLL4 = "CASE WHEN count(units) OVER (PARTITION BY sku_id ORDER BY week_start ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) >= 2 THEN avg(units) OVER (PARTITION BY sku_id ORDER BY week_start ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) END"
_ROLL13 = "CASE WHEN count(units) OVER (PARTITION BY sku_id ORDER BY week_start ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) >= 3 THEN avg(units) OVER (PARTITION BY sku_id ORDER BY week_start ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) END"


def _res(src: str, h: int, forecast: str) -> str:
    return f"SELECT sku_id AS node, week_start, {h} AS horizon, lead(units, {h}) OVER w AS actual, {forecast} AS prediction FROM {src} WINDOW w AS (PARTITION BY sku_id ORDER BY week_start)"


_RES = _AGG + ", " + _EDGES + ", cut AS (SELECT max(week_start) - 31*7 AS c FROM panel), rs AS (SELECT * FROM (" + " UNION ALL ".join(
    _res("panel", h, f"coalesce({_ROLL13}, 0)") + " UNION ALL " + _res("ag", h, f"greatest(coalesce(lag(units, {52 - h}) OVER w, {_ROLL4}, 0), 0)") for h in H
) + """), cut WHERE actual IS NOT NULL AND week_start >= c),
 sd AS (SELECT node, horizon, count(*) AS n, stddev_samp(actual - prediction) AS s FROM rs GROUP BY 1,2),
 sg AS (SELECT ed.node, level, h.horizon, coalesce(n, 0) AS observations, s FROM ed CROSS JOIN (SELECT unnest(range(1, 9))::INT AS horizon) h LEFT JOIN sd ON sd.node = ed.node AND sd.horizon = h.horizon),
 smed AS (SELECT level, horizon, quantile_cont(s, 0.5) AS m FROM sg WHERE observations >= 8 AND s IS NOT NULL GROUP BY 1,2),
 sca AS (SELECT node, sg.level, sg.horizon, observations, greatest(CASE WHEN observations >= 8 AND s IS NOT NULL THEN s ELSE 2.0*coalesce(m, 0.001) END, 0.001) AS scale FROM sg LEFT JOIN smed ON smed.level = sg.level AND smed.horizon = sg.horizon)"""
_NEED = ("panel", "master")


def scales(R, sku, node):
    return cut(G.residual_scales(sku.unionByName(node), G.hierarchy_edges(R.master)))


@query("residual_scales", with_sql("part", _NEED, f"SELECT node, level, horizon, observations, {q('scale', 4)} AS scale FROM sca", _RES))
def residual_scales(spark, d):
    R = part(spark, d)
    return rounded(scales(R, *residuals(R)), scale=4)


@query("residual_correlation", with_sql("part", _NEED, f"SELECT (SELECT count(*) FROM rel) AS nodes, max(t) AS observations, {q('least(greatest(sum(v)/sum(c*c), 0), 1)', 4)} AS intensity FROM prs", _RES + """,
 rel AS (SELECT node FROM sca WHERE level <> 'sku' GROUP BY 1 HAVING min(observations) >= 8),
 sx AS (SELECT rs.node, week_start, rs.horizon, (actual-prediction)/scale AS x FROM rs JOIN rel ON rel.node = rs.node JOIN sca ON sca.node = rs.node AND sca.horizon = rs.horizon),
 cmp AS (SELECT week_start, horizon FROM sx GROUP BY 1,2 HAVING count(*) = (SELECT count(*) FROM rel)),
 zs AS (SELECT node, week_start, horizon, (x - avg(x) OVER (PARTITION BY node))/greatest(stddev_samp(x) OVER (PARTITION BY node), 0.001) AS z, count(*) OVER (PARTITION BY node) AS t FROM sx JOIN cmp USING (week_start, horizon)),
 prs AS (SELECT a.node AS i, b.node AS j, max(a.t) AS t, sum(a.z*b.z)/(max(a.t)-1) AS c, max(a.t)/pow(max(a.t)-1, 3)*(sum(a.z*a.z*b.z*b.z) - sum(a.z*b.z)*sum(a.z*b.z)/max(a.t)) AS v FROM zs a JOIN zs b ON a.week_start = b.week_start AND a.horizon = b.horizon AND a.node <> b.node GROUP BY 1,2)"""))
def residual_correlation(spark, d):
    R = part(spark, d)
    sku, node = residuals(R)
    return rounded(G.shrunk_correlation(sku.unionByName(node), scales(R, sku, node)), intensity=4)


_TREE = _RES + """,
 og AS (SELECT max(week_start) AS o FROM rs WHERE horizon = 8),
 bs AS (SELECT rs.node, rs.horizon, prediction AS y, scale*scale AS w, actual FROM rs JOIN og ON rs.week_start = og.o JOIN sca ON sca.node = rs.node AND sca.horizon = rs.horizon),
 lf AS (SELECT b.node AS sku_id, horizon, 'SUB::' || category || '|' || subcategory AS sub, 'CAT::' || category AS cat, y AS m, w AS v, actual, y FROM bs b JOIN master ON master.sku_id = b.node),
 s1 AS (SELECT x.sub, x.cat, x.horizon, sm, sv, (y/w + sm/sv)/(1/w + 1/sv) AS m, 1/(1/w + 1/sv) AS v FROM (SELECT sub, cat, horizon, sum(m) AS sm, sum(v) AS sv FROM lf GROUP BY 1,2,3) x JOIN bs ON bs.node = x.sub AND bs.horizon = x.horizon),
 c1 AS (SELECT x.cat, x.horizon, sm, sv, (y/w + sm/sv)/(1/w + 1/sv) AS m, 1/(1/w + 1/sv) AS v FROM (SELECT cat, horizon, sum(m) AS sm, sum(v) AS sv FROM s1 GROUP BY 1,2) x JOIN bs ON bs.node = x.cat AND bs.horizon = x.horizon),
 g1 AS (SELECT x.horizon, sm, sv, (y/w + sm/sv)/(1/w + 1/sv) AS f FROM (SELECT horizon, sum(m) AS sm, sum(v) AS sv FROM c1 GROUP BY 1) x JOIN bs ON bs.node = 'TOTAL' AND bs.horizon = x.horizon),
 c2 AS (SELECT c1.*, c1.m + c1.v/g1.sv*(g1.f - g1.sm) AS f FROM c1 JOIN g1 ON g1.horizon = c1.horizon),
 s2 AS (SELECT s1.*, s1.m + s1.v/c2.sv*(c2.f - c2.sm) AS f FROM s1 JOIN c2 ON c2.cat = s1.cat AND c2.horizon = s1.horizon),
 l2 AS (SELECT lf.*, lf.m + lf.v/s2.sv*(s2.f - s2.sm) AS f FROM lf JOIN s2 ON s2.sub = lf.sub AND s2.horizon = lf.horizon)"""


def _tree(R):
    sku, node = residuals(R)
    table = scales(R, sku, node)
    origin = R.week_list[-9]
    at = F.col("week_start") == F.lit(origin)
    now = cut(sku.filter(at))
    base = now.unionByName(node.filter(at)).select("node", "week_start", "horizon", "prediction")
    return now, node.filter(at), table, cut(G.tree_reconcile(base, table, R.master))


@query("tree_reconcile", with_sql("part", _NEED, f"SELECT sku_id, horizon, {q('f+1000', 4)} AS reconciled FROM l2", _TREE))
def tree_reconcile(spark, d):
    out = _tree(part(spark, d))[3]
    return out.select("sku_id", "horizon", fx(F.col("reconciled") + 1000, 4).alias("reconciled"))


@query("reconcile_blend", with_sql("part", _NEED, f"SELECT sku_id, horizon, {q('greatest(0.5*y+0.5*f, 0)', 4)} AS reconciled, {q('greatest(0.5*y+0.5*f, 0)-y+1000', 4)} AS adjustment FROM l2", _TREE))
def reconcile_blend(spark, d):
    R = part(spark, d)
    sku, node, table, _ = _tree(R)
    bottom = sku.withColumnRenamed("node", "sku_id").select("sku_id", "week_start", "horizon", "prediction")
    out = G.reconcile(bottom, node, table, R.master, 0.5)
    return out.select("sku_id", "horizon", fx("reconciled", 4).alias("reconciled"),
                      fx(F.col("adjustment") + 1000, 4).alias("adjustment"))


_LAM = ", ".join(f"{x}::DOUBLE" for x in (0.0, *G.LAMBDAS))


@query("blend_strength", with_sql("part", _NEED, f"SELECT lam AS \"lambda\", {q('sum(abs(greatest((1-lam)*y+lam*f, 0)-actual))/sum(abs(actual))', 5)} AS wape, {q('stddev_samp(abs(greatest((1-lam)*y+lam*f, 0)-actual)-abs(greatest(y, 0)-actual))/sqrt(count(*))*count(*)/sum(abs(actual))', 5)} AS standard_error FROM l2 CROSS JOIN (SELECT unnest([{_LAM}]) AS lam) GROUP BY 1", _TREE))
def blend_strength(spark, d):
    sku, _, _, tree = _tree(part(spark, d))
    rows = sku.withColumnRenamed("node", "sku_id").join(tree, ["sku_id", "week_start", "horizon"])
    return rounded(G.blend_scores(rows), wape=5, standard_error=5)


_BU = _RES + """,
 bu AS (SELECT node, level, week_start, horizon, sum(prediction) AS bottom_up FROM (SELECT r.*, m.category, m.subcategory FROM rs r JOIN master m ON m.sku_id = r.node) x, LATERAL (SELECT 'TOTAL' AS node2, 'total' AS level UNION ALL SELECT 'CAT::' || x.category, 'category' UNION ALL SELECT 'SUB::' || x.category || '|' || x.subcategory, 'subcategory') l GROUP BY ALL)"""
_BU = _BU.replace("SELECT node, level, week_start, horizon, sum(prediction) AS bottom_up", "SELECT node2 AS node, level, week_start, horizon, sum(prediction) AS bottom_up")


def _summed(R, sku):
    bottom = sku.withColumnRenamed("node", "sku_id")
    return G.bottom_up(bottom, R.master)


@query("bottom_up_forecasts", with_sql("part", _NEED, f"SELECT node, level, week_start, horizon, {q('bottom_up', 3)} AS bottom_up FROM bu", _BU))
def bottom_up_forecasts(spark, d):
    R = part(spark, d)
    return rounded(_summed(R, residuals(R)[0]), bottom_up=3)


@query("aggregate_advantage", with_sql("part", _NEED, f"SELECT {q('sum(abs(actual-prediction))', 2)} AS direct_error, {q('sum(abs(actual-bottom_up))', 2)} AS bottom_up_error, {q('(sum(abs(actual-bottom_up))-sum(abs(actual-prediction)))/sum(abs(actual-bottom_up))', 5)} AS advantage FROM rs JOIN bu USING (node, week_start, horizon)", _BU))
def aggregate_advantage(spark, d):
    R = part(spark, d)
    sku, node = residuals(R)
    return rounded(G.aggregate_advantage(node, _summed(R, sku)), direct_error=2, bottom_up_error=2, advantage=5)


@query("wape_by_level", with_sql("part", _NEED, f"SELECT level, count(*) AS rows, {q(wape_sql('actual', 'prediction'), 5)} AS direct_wape, {q(wape_sql('actual', 'bottom_up'), 5)} AS bottom_up_wape FROM rs JOIN bu USING (node, week_start, horizon) GROUP BY 1", _BU))
def wape_by_level(spark, d):
    R = part(spark, d)
    sku, node = residuals(R)
    rows = node.withColumnRenamed("prediction", "direct").join(_summed(R, sku), ["node", "week_start", "horizon"])
    return rounded(G.wape_by_level(rows, ["direct", "bottom_up"]), direct_wape=5, bottom_up_wape=5)


@query("coherence_error", with_sql("part", _NEED, f"SELECT {q('max(abs(g1.f-t.s))', 6)} AS coherence_error FROM g1 JOIN (SELECT horizon, sum(f) AS s FROM l2 GROUP BY 1) t ON t.horizon = g1.horizon", _TREE))
def coherence_error(spark, d):
    R = part(spark, d)
    sku, _, _, tree = _tree(R)
    edges = G.hierarchy_edges(R.master)
    leaves = tree.select(F.col("sku_id").alias("node"), "week_start", "horizon", F.col("reconciled").alias("value"))
    nodes = G.bottom_up(tree, R.master, "reconciled").select("node", "week_start", "horizon", F.col("bottom_up").alias("value"))
    return rounded(G.coherence_error(leaves.unionByName(nodes), edges), coherence_error=6)


_CHOICE = _TREE + _BU[len(_RES):] + f""",
 sc AS (SELECT lam, sum(abs(greatest((1-lam)*y+lam*f, 0)-actual))/sum(abs(actual)) AS wape, stddev_samp(abs(greatest((1-lam)*y+lam*f, 0)-actual)-abs(greatest(y, 0)-actual))/sqrt(count(*))*count(*)/sum(abs(actual)) AS se FROM l2 CROSS JOIN (SELECT unnest([{_LAM}]) AS lam) GROUP BY 1),
 av AS (SELECT (sum(abs(actual-bottom_up))-sum(abs(actual-prediction)))/sum(abs(actual-bottom_up)) AS advantage FROM rs JOIN bu USING (node, week_start, horizon)),
 be AS (SELECT *, CASE WHEN lam = 0 THEN wape ELSE wape + se END AS tolerance FROM sc ORDER BY wape, lam LIMIT 1),
 ch AS (SELECT CASE WHEN advantage <= 0 OR (SELECT lam FROM be) = 0 THEN 0.0::DOUBLE ELSE (SELECT min(lam) FROM sc WHERE wape <= (SELECT tolerance FROM be)) END AS strength FROM av)"""


@query("blend_choice", with_sql("part", _NEED, f"""SELECT CASE WHEN advantage <= 0 THEN 'declined' ELSE 'passed' END AS gate, {q('advantage + 10', 4)} AS advantage_plus_10, {q('(SELECT wape FROM sc WHERE lam = 0)', 5)} AS base_wape, (SELECT lam FROM be) AS best_lambda, {q('(SELECT wape FROM be)', 5)} AS best_wape, {q('(SELECT tolerance FROM be)', 5)} AS tolerance,
  strength, {q('(SELECT wape FROM sc WHERE lam = strength)', 5)} AS wape, (SELECT count(*) FROM l2) AS reconciled_rows, {q('(SELECT sum(greatest((1-strength)*y+strength*f, 0)) FROM l2)', 1)} AS reconciled_total FROM av CROSS JOIN ch""", _CHOICE))
def blend_choice(spark, d):
    """The strength that the held-out origin supports, the gate, and the forecasts reconciled with it."""
    R = part(spark, d)
    sku, node = residuals(R)
    table = scales(R, sku, node)
    at = F.col("week_start") == F.lit(R.week_list[-9])
    bottom = cut(sku.filter(at).withColumnRenamed("node", "sku_id").select("sku_id", "week_start", "horizon", "prediction", "actual"))
    aggregates = cut(node.filter(at))
    tree = G.tree_reconcile(bottom.withColumnRenamed("sku_id", "node").select("node", "week_start", "horizon", "prediction").unionByName(
        aggregates.select("node", "week_start", "horizon", "prediction")), table, R.master)
    scores = G.blend_scores(bottom.join(tree, ["sku_id", "week_start", "horizon"]))
    choice = cut(G.choose_blend(scores, G.aggregate_advantage(node, _summed(R, sku))))
    strength = choice.first()["strength"]
    total = G.reconcile(bottom.drop("actual"), aggregates, table, R.master, strength).agg(
        F.count(F.lit(1)).alias("reconciled_rows"), F.sum("reconciled").alias("reconciled_total"))
    out = choice.crossJoin(F.broadcast(total)).withColumn("advantage_plus_10", F.col("advantage") + 10).drop("advantage")  # one row each
    return rounded(out, advantage_plus_10=4, base_wape=5, best_wape=5, tolerance=5, wape=5, reconciled_total=1)
