"""Censored demand, promotions, substitution and cold start."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from registry.core import part, q, query, rounded, style
from registry.panel import H
from registry.sql import wape_sql, with_sql
from stockloom.models import ensemble as E
from stockloom.operators import censoring as Z
from stockloom.operators import coldstart as C
from stockloom.operators import features as X
from stockloom.operators import insights as I
from stockloom.operators import promotions as PR
from stockloom.session import cut


# --------------------------------------------------------------------------- #
# Censoring
# --------------------------------------------------------------------------- #
_STOCK = """op AS (SELECT sku_id, "date" AS week_start, on_hand_units AS on_hand_start FROM inventory WHERE on_hand_units % 7 <> 3),
 rc0 AS (SELECT p.*, on_hand_start, lead(on_hand_start) OVER (PARTITION BY p.sku_id ORDER BY p.week_start) AS closing FROM panel p LEFT JOIN op ON op.sku_id = p.sku_id AND op.week_start = p.week_start),
 rc AS (SELECT *, coalesce(greatest(closing - on_hand_start + units, 0), 0) AS receipts, greatest(coalesce(on_hand_start, 0) + coalesce(greatest(closing - on_hand_start + units, 0), 0), 0) AS available_units FROM rc0),
 """


def _avail(src: str, rate: str, name: str) -> str:
    return f"""{name} AS (SELECT * EXCLUDE (share0), CASE WHEN units > 0 AND units/greatest(available_units, 1e-6) <= 1 AND share0 < 1 THEN greatest(share0, units/greatest(available_units, 1e-6)) ELSE share0 END AS availability FROM
  (SELECT *, CASE WHEN on_hand_start IS NULL THEN 1.0::DOUBLE ELSE least(greatest(available_units/greatest({rate}, 1e-6), 0.0), 1.0) END AS share0 FROM {src}))"""


def _pass(i: int, src: str) -> str:
    """Fallback and recovery of one pass over ``src`` (which has availability)."""
    return f"""lv{i} AS (SELECT sku_id, avg(units) AS lvl FROM {src} WHERE availability >= 0.97 GROUP BY 1), ov{i} AS (SELECT avg(units) AS overall FROM {src} WHERE availability >= 0.97),
 cm{i} AS (SELECT category, avg(units) AS cmean FROM {src} WHERE availability >= 0.97 GROUP BY 1),
 sh{i} AS (SELECT s.category, weekofyear(week_start) AS iw, least(greatest(avg(units)/nullif(max(cmean), 0), 0.25), 4.0) AS shape FROM {src} s JOIN cm{i} ON cm{i}.category = s.category WHERE availability >= 0.97 GROUP BY 1,2),
 fb{i} AS (SELECT s.*, coalesce(lvl, overall) * coalesce(shape, 1.0) AS fallback FROM {src} s LEFT JOIN lv{i} ON lv{i}.sku_id = s.sku_id LEFT JOIN sh{i} ON sh{i}.category = s.category AND sh{i}.iw = weekofyear(s.week_start) CROSS JOIN ov{i}),
 rec{i} AS (SELECT * EXCLUDE (fallback), CASE WHEN availability >= 0.97 THEN units ELSE greatest(least(greatest(CASE WHEN availability <= 0.05 THEN fallback ELSE units/greatest(availability, 0.15) END, units),
   greatest(CASE WHEN units > 0 THEN units*5 ELSE fallback*5 END, 1e-6)), 0) END AS units_demand FROM fb{i})"""


_AVAIL1 = _STOCK + _avail("(SELECT *, avg(units) OVER (PARTITION BY sku_id) AS rate FROM rc)", "rate", "av1")
_REC = _AVAIL1 + ",\n " + _pass(1, "av1")
for _i in (2, 3):
    _REC += (",\n " + _avail(f"(SELECT * EXCLUDE (availability, units_demand, rate), avg(units_demand) OVER (PARTITION BY sku_id) AS rate FROM rec{_i - 1})", "rate", f"av{_i}")
             + ",\n " + _pass(_i, f"av{_i}"))


def _stock(R):
    """Snapshots with a few weeks missing."""
    return R.inventory.filter(F.col("on_hand_units") % 7 != 3)


@query("availability", with_sql("style", ("panel", "inventory"), f"SELECT sku_id, week_start, on_hand_start, receipts, available_units, {q('availability', 5)} AS availability FROM av1", _AVAIL1))
def availability(spark, d):
    R = style(spark, d)
    out = Z.attach_availability(R.panel, _stock(R))
    return rounded(
        out.select("sku_id", "week_start", "on_hand_start", "receipts", "available_units", "availability"),
        availability=5,
    )


@query("blackout_fallback", with_sql("part", ("panel", "inventory"), f"SELECT category, year(week_start) AS year, count(*) AS rows, {q('sum(fallback)', 2)} AS fallback FROM fb1 GROUP BY 1,2", _REC))
def blackout_fallback(spark, d):
    R = part(spark, d)
    seen = Z.attach_availability(R.panel, _stock(R)).select("sku_id", "category", "week_start", "units", "availability")
    out = Z.blackout_fallback(seen)
    return rounded(
        out.groupBy("category", F.year("week_start").alias("year")).agg(
            F.count(F.lit(1)).alias("rows"), F.sum("fallback").alias("fallback")
        ),
        fallback=2,
    )


@query("recovered_demand", with_sql("style", ("panel", "inventory"), f"SELECT sku_id, week_start, units, {q('availability', 4)} AS availability, {q('units_demand', 3)} AS units_demand, CAST(availability < 0.97 AS INT) AS is_censored FROM rec3", _REC))
def recovered_demand(spark, d):
    R = style(spark, d)
    out = Z.recover_demand(R.panel, _stock(R))
    return rounded(
        out.select("sku_id", "week_start", "units", "availability", "units_demand", "is_censored"),
        availability=4, units_demand=3,
    )


@query("censoring_summary", with_sql("style", ("panel", "inventory"), f"""SELECT count(*) AS total_weeks, count(*) FILTER (availability < 0.97) AS censored_weeks, count(*) FILTER (availability <= 0.05) AS blackout_weeks,
  {q('avg(CASE WHEN availability < 0.97 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)', 6)} AS censored_share, sum(units) AS observed_units, {q('sum(units_demand)', 1)} AS recovered_units,
  {q('(sum(units_demand)-sum(units))/sum(units)', 6)} AS uplift_share, count(DISTINCT CASE WHEN availability < 0.97 THEN sku_id END) AS skus_affected FROM rec3""", _REC))
def censoring_summary(spark, d):
    R = style(spark, d)
    out = Z.censoring_summary(Z.recover_demand(R.panel, _stock(R)))
    return rounded(out, censored_share=6, recovered_units=1, uplift_share=6)


# --------------------------------------------------------------------------- #
# Promotions
# --------------------------------------------------------------------------- #
_BASE = """ct AS (SELECT category, week_start, quantile_cont(m, 0.5) OVER (PARTITION BY category ORDER BY week_start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cat_trail FROM (SELECT category, week_start, avg(units) AS m FROM panel GROUP BY 1,2)),
 pb0 AS (SELECT p.*, CAST(promo_days > 0 AS INT) AS is_promo, least(greatest(1.0-avg_price/(list_price+1e-6), 0.0), 0.95) AS discount_depth, cat_trail FROM panel p JOIN ct ON ct.category = p.category AND ct.week_start = p.week_start),
 pb AS (SELECT *, greatest(coalesce(quantile_cont(CASE WHEN is_promo = 0 THEN units END, 0.5) OVER (PARTITION BY sku_id ORDER BY week_start ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING),
   avg(units) OVER (PARTITION BY sku_id ORDER BY week_start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), cat_trail, 0), 0) AS baseline, row_number() OVER (PARTITION BY sku_id ORDER BY week_start) AS rn FROM pb0),
 ws AS (SELECT *, coalesce(CAST(rn - max(CASE WHEN is_promo = 1 THEN rn END) OVER (PARTITION BY sku_id ORDER BY week_start ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE), 9999.0::DOUBLE) AS weeks_since_promo FROM pb)"""


@query("promo_baseline", with_sql("style", "panel", f"SELECT sku_id, week_start, is_promo, {q('discount_depth', 4)} AS discount_depth, {q('baseline', 4)} AS baseline, weeks_since_promo FROM ws", _BASE))
def promo_baseline(spark, d):
    out = PR.attach_baseline(style(spark, d).panel)
    return rounded(
        out.select("sku_id", "week_start", "is_promo", "discount_depth", "baseline", "weeks_since_promo"),
        discount_depth=4, baseline=4,
    )


_LO, _HI = math.log(0.5), math.log(8.0)
_FIT = _BASE + f""",
 pr AS (SELECT category, discount_depth AS x, least(greatest(ln(greatest(units/baseline, 1e-6)), {_LO!r}::DOUBLE), {_HI!r}::DOUBLE) AS y FROM ws WHERE is_promo = 1 AND baseline >= 1 AND units > 0),
 ln0 AS (SELECT category, count(*) AS rows, avg(x) AS mx, avg(y) AS my, regr_slope(y, x) AS b, var_pop(x) AS vx FROM pr GROUP BY 1 HAVING count(*) >= 40 UNION ALL SELECT '__POOLED__', count(*), avg(x), avg(y), regr_slope(y, x), var_pop(x) FROM pr),
 curve AS (SELECT category, rows, my - s*mx AS intercept, s AS slope FROM (SELECT *, CASE WHEN rows < 3 OR vx <= 1e-6 THEN 0.0::DOUBLE ELSE least(greatest(b, 0.0), 6.0) END AS s FROM ln0)),
 sw AS (SELECT category, units/baseline AS r FROM ws WHERE is_promo = 0 AND weeks_since_promo BETWEEN 1 AND 2 AND baseline >= 1),
 dip AS (SELECT category, count(*) AS rows, least(greatest(quantile_cont(r, 0.5), 0.55), 1.0) AS dip FROM sw GROUP BY 1 HAVING count(*) >= 40 UNION ALL SELECT '__POOLED__', count(*), least(greatest(quantile_cont(r, 0.5), 0.55), 1.0) FROM sw),
 resp AS (SELECT coalesce(c.category, d.category) AS category, c.category IS NOT NULL AS has_own_curve, coalesce(c.intercept, (SELECT intercept FROM curve WHERE category = '__POOLED__')) AS intercept,
   coalesce(c.slope, (SELECT slope FROM curve WHERE category = '__POOLED__')) AS slope, coalesce(d.dip, (SELECT dip FROM dip WHERE category = '__POOLED__'), 1.0) AS dip FROM curve c FULL JOIN dip d ON c.category = d.category)"""


@query("promo_response_fit", with_sql("style", "panel", f"SELECT category, rows, {q('intercept', 5)} AS intercept, {q('slope', 5)} AS slope FROM curve", _FIT))
def promo_response_fit(spark, d):
    out = PR.fit_uplift(PR.attach_baseline(style(spark, d).panel))
    return rounded(out, intercept=5, slope=5)


@query("promo_dip", with_sql("style", "panel", f"SELECT category, rows, {q('dip', 5)} AS dip FROM dip", _FIT))
def promo_dip(spark, d):
    return rounded(PR.fit_dip(PR.attach_baseline(style(spark, d).panel)), dip=5)


_UP = "least(greatest(exp(intercept+slope*least(greatest({x}, 0.0), 0.95)), 1.0), 8.0)"


def _target_rows(R):
    """Forecast rows of one origin with the published plan and a simple forecast."""
    near = PR.attach_baseline(R.panel)
    rows = X.inference_frame(X.add_rolling(near), R.weeks, R.last_week, H, check=False)
    rows = X.attach_target_drivers(rows, None, R.weeks)
    return rows.withColumn("prediction", F.coalesce("units_roll_mean_13", F.lit(0.0)))


_TARGET = _FIT + """,
 tg AS (SELECT w.sku_id, w.category, h.horizon, k.has_promo_event, k.planned_discount, w.weeks_since_promo, (SELECT avg(units) FROM panel p WHERE p.sku_id = w.sku_id AND p.week_start > w.week_start - 91) AS prediction
   FROM ws w CROSS JOIN (SELECT unnest(range(1,9))::INT AS horizon) h JOIN weeks k ON k.week_start = w.week_start + 7*h.horizon WHERE w.week_start = (SELECT max(week_start) FROM panel)),
 co AS (SELECT tg.*, coalesce(o.intercept, p.intercept) AS intercept, coalesce(o.slope, p.slope) AS slope, coalesce(o.dip, p.dip) AS dip FROM tg LEFT JOIN resp o ON o.category = tg.category CROSS JOIN (SELECT * FROM resp WHERE category = '__POOLED__') p)"""


@query("promo_multiplier", with_sql("style", ("panel", "weeks"), f"SELECT sku_id, horizon, {q('CASE WHEN has_promo_event = 1 THEN ' + _UP.format(x='planned_discount') + ' WHEN weeks_since_promo BETWEEN 1 AND 2 THEN dip ELSE 1.0 END', 5)} AS promo_multiplier FROM co", _TARGET))
def promo_multiplier(spark, d):
    R = style(spark, d)
    out = PR.promo_multiplier(_target_rows(R), PR.fit_response(R.panel))
    return rounded(out.select("sku_id", "horizon", "promo_multiplier"), promo_multiplier=5)


_LIFT = f"(CASE WHEN has_promo_event = 1 THEN {_UP.format(x='planned_discount')} ELSE 1.0::DOUBLE END)"


@query("promo_decomposition", with_sql("style", ("panel", "weeks"), f"SELECT sku_id, horizon, {q('prediction', 3)} AS prediction, {q(_LIFT, 5)} AS uplift_multiplier, {q(f'prediction/{_LIFT}', 3)} AS baseline_units, {q(f'prediction-prediction/{_LIFT}', 3)} AS promo_uplift_units, "
       f"{q(f'CASE WHEN prediction/{_LIFT} > 1e-6 THEN (prediction-prediction/{_LIFT})/(prediction/{_LIFT}) ELSE 0.0 END', 5)} AS promo_uplift_pct FROM co", _TARGET))
def promo_decomposition(spark, d):
    R = style(spark, d)
    out = PR.decompose(_target_rows(R), PR.fit_response(R.panel))
    return rounded(
        out.select("sku_id", "horizon", "prediction", "uplift_multiplier", "baseline_units",
                   "promo_uplift_units", "promo_uplift_pct"),
        prediction=3, uplift_multiplier=5, baseline_units=3, promo_uplift_units=3, promo_uplift_pct=5,
    )


@query("promo_scenarios", with_sql("style", "panel", f"SELECT category, has_own_curve, discount, {q(_UP.format(x='discount'), 4)} AS uplift, {q('dip', 4)} AS post_promo_dip FROM resp CROSS JOIN (SELECT unnest([0.1::DOUBLE, 0.2, 0.3]) AS discount)", _FIT))
def promo_scenarios(spark, d):
    out = PR.promo_scenarios(PR.fit_response(style(spark, d).panel))
    return rounded(out, uplift=4, post_promo_dip=4)


_SUBS = _BASE + """,
 sb AS (SELECT subcategory, least(greatest(units/baseline, 0.5), 1.05) AS r FROM (SELECT *, sum(is_promo) OVER (PARTITION BY subcategory, week_start) - is_promo AS others FROM pb) WHERE is_promo = 0 AND others > 0 AND baseline >= 1)"""


@query("substitution_dip", with_sql("style", "panel", f"SELECT subcategory, count(*) AS rows, {q('quantile_cont(r, 0.5)', 5)} AS dip FROM sb GROUP BY 1 HAVING count(*) >= 30 UNION ALL SELECT '__POOLED__', count(*), {q('quantile_cont(r, 0.5)', 5)} FROM sb", _SUBS))
def substitution_dip(spark, d):
    return rounded(PR.fit_substitution(style(spark, d).panel), dip=5)


@query("sibling_promo", with_sql("part", "panel", "SELECT subcategory, week_start, sum(sib)::BIGINT AS skus_beside_a_promotion, sum(CAST(promo_days > 0 AS INT))::BIGINT AS promoted FROM (SELECT *, CAST(sum(CAST(promo_days > 0 AS INT)) OVER (PARTITION BY subcategory, week_start) - CAST(promo_days > 0 AS INT) > 0 AS INT) AS sib FROM panel) GROUP BY 1,2"))
def sibling_promo(spark, d):
    frame = part(spark, d).panel.withColumn("is_promo", (F.col("promo_days") > 0).cast("int"))
    return PR.sibling_promo(frame).groupBy("subcategory", "week_start").agg(
        F.sum("sibling_promo").alias("skus_beside_a_promotion"), F.sum("is_promo").alias("promoted")
    )


# --------------------------------------------------------------------------- #
# Cold start
# --------------------------------------------------------------------------- #
_CURVE = """dn AS (SELECT sku_id, max(weeks_since_launch) AS oldest, avg(units) FILTER (weeks_since_launch BETWEEN 13 AND 26) AS lvl FROM panel WHERE weeks_since_launch BETWEEN 0 AND 26 GROUP BY 1 HAVING max(weeks_since_launch) >= 26 AND avg(units) FILTER (weeks_since_launch BETWEEN 13 AND 26) > 1e-6),
 sha AS (SELECT p.sku_id, category, weeks_since_launch AS age, units/lvl AS share FROM panel p JOIN dn ON dn.sku_id = p.sku_id WHERE weeks_since_launch BETWEEN 0 AND 26),
 ova AS (SELECT age, quantile_cont(share, 0.5) AS c FROM sha GROUP BY 1), owa AS (SELECT category, age, quantile_cont(share, 0.5) AS c FROM sha GROUP BY 1,2),
 dc AS (SELECT category, count(DISTINCT sku_id) AS donors FROM sha GROUP BY 1),
 curve AS (SELECT n.category, a.age, coalesce(CASE WHEN coalesce(n.donors, 0) >= 5 THEN owa.c END, ova.c, 1.0) AS curve, coalesce(n.donors, 0) AS donors FROM (SELECT p.category, donors FROM (SELECT DISTINCT category FROM panel) p LEFT JOIN dc ON dc.category = p.category
   UNION ALL SELECT '__POOLED__', sum(donors)::BIGINT FROM dc) n CROSS JOIN (SELECT unnest(range(0, 27))::BIGINT AS age) a LEFT JOIN ova ON ova.age = a.age LEFT JOIN owa ON owa.category = n.category AND owa.age = a.age)"""


@query("launch_curve", with_sql("part", "panel", f"SELECT category, age, {q('curve', 5)} AS curve, donors FROM curve", _CURVE))
def launch_curve(spark, d):
    return rounded(C.launch_curve(part(spark, d).panel), curve=5)


_ATTR = """at0 AS (SELECT sku_id, category, subcategory, max(list_price) AS list_price, max(unit_cost) AS unit_cost FROM panel GROUP BY 1,2,3),
 at1 AS (SELECT *, ln(1+list_price) AS l, (list_price-unit_cost)/(list_price+1e-6) AS m, (rank() OVER (PARTITION BY subcategory ORDER BY list_price) + (count(*) OVER (PARTITION BY subcategory, list_price) - 1)/2.0::DOUBLE)/count(*) OVER (PARTITION BY subcategory) AS r FROM at0),
 at2 AS (SELECT avg(l) AS ml, stddev_pop(l) AS sl, avg(m) AS mm, stddev_pop(m) AS sm, avg(r) AS mr, stddev_pop(r) AS sr FROM at1),
 attr AS (SELECT sku_id, category, subcategory, list_price, unit_cost, (l-ml)/(CASE WHEN sl > 1e-6 THEN sl ELSE 1 END) AS log_list_price, (m-mm)/(CASE WHEN sm > 1e-6 THEN sm ELSE 1 END) AS margin_rate, (r-mr)/(CASE WHEN sr > 1e-6 THEN sr ELSE 1 END) AS price_rank FROM at1, at2),
 lev AS (SELECT sku_id, avg(units) AS mature_level FROM panel WHERE weeks_since_launch BETWEEN 13 AND 26 GROUP BY 1 HAVING avg(units) > 0)"""


@query("product_attributes", with_sql("part", "panel", f"SELECT sku_id, category, subcategory, list_price, {q('log_list_price', 4)} AS log_list_price, {q('margin_rate', 4)} AS margin_rate, {q('price_rank', 4)} AS price_rank FROM attr", _ATTR))
def product_attributes(spark, d):
    out = C.attributes(part(spark, d).panel)
    return rounded(
        out.select("sku_id", "category", "subcategory", "list_price", *C.SHAPE),
        log_list_price=4, margin_rate=4, price_rank=4,
    )


_ELA = _ATTR + """,
 ea AS (SELECT category, ln(list_price) AS x, ln(mature_level) AS y FROM attr JOIN lev ON lev.sku_id = attr.sku_id),
 ed AS (SELECT x - avg(x) OVER (PARTITION BY category) AS dx, y - avg(y) OVER (PARTITION BY category) AS dy FROM ea),
 ela AS (SELECT count(*) AS skus, CASE WHEN count(*) < 10 OR sum(dx*dx) <= 1e-6 THEN 0.0::DOUBLE ELSE least(greatest(sum(dx*dy)/sum(dx*dx), -3.0), 0.0) END AS elasticity FROM ed)"""


@query("price_elasticity", with_sql("part", "panel", f"SELECT skus, {q('elasticity', 5)} AS elasticity FROM ela", _ELA))
def price_elasticity(spark, d):
    panel = part(spark, d).panel
    levels = C.attributes(panel).select("sku_id", "category", "list_price").join(C.mature_levels(panel), "sku_id")
    return rounded(C.price_elasticity(levels), elasticity=5)


_SEAS = """sea AS (SELECT c.category, iw, least(greatest(coalesce(m/nullif(cm, 0), 1.0), 0.25), 4.0) AS idx FROM (SELECT category, weekofyear(week_start) AS iw, avg(units) AS m FROM panel GROUP BY 1,2) c JOIN (SELECT category, avg(units) AS cm FROM panel GROUP BY 1) t ON t.category = c.category)"""


@query("cold_season_index", with_sql("part", "panel", f"SELECT category, iw AS iso_week, {q('idx', 5)} AS \"index\" FROM sea", _SEAS))
def cold_season_index(spark, d):
    return rounded(C.cold_season(part(spark, d).panel), index=5)


_NEAR = _ELA + """,
 pairs AS (SELECT t.sku_id, o.sku_id AS donor, sqrt(pow(o.log_list_price-t.log_list_price, 2) + pow(o.margin_rate-t.margin_rate, 2) + pow(o.price_rank-t.price_rank, 2)) + CASE WHEN o.subcategory <> t.subcategory THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END
   + CASE WHEN o.category <> t.category THEN 4.0::DOUBLE ELSE 0.0::DOUBLE END AS distance, l.mature_level, o.list_price FROM attr t JOIN attr o ON o.sku_id <> t.sku_id JOIN lev l ON l.sku_id = o.sku_id),
 near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sku_id ORDER BY distance, donor) AS donor_rank FROM pairs) WHERE donor_rank <= 12),
 prior AS (SELECT sku_id, sum(mature_level/(1+distance))/sum(1/(1+distance)) AS donor_level, sum(list_price/(1+distance))/sum(1/(1+distance)) AS donor_price FROM near GROUP BY 1)"""


@query("nearest_donors", with_sql("part", "panel", f"SELECT sku_id, donor, {q('distance', 4)} AS distance FROM near", _NEAR))
def nearest_donors(spark, d):
    panel = part(spark, d).panel
    table, levels = cut(C.attributes(panel)), C.mature_levels(panel)
    near = C.nearest_donors(table, table.join(levels, "sku_id", "left_semi"))
    return rounded(near.select("sku_id", "donor", "distance"), distance=4)


@query("donor_prior", with_sql("part", "panel", f"SELECT sku_id, {q('donor_level', 4)} AS donor_level, {q('donor_price', 2)} AS donor_price FROM prior", _NEAR))
def donor_prior(spark, d):
    panel = part(spark, d).panel
    table, levels = cut(C.attributes(panel)), cut(C.mature_levels(panel))
    near = C.nearest_donors(table, table.join(levels, "sku_id", "left_semi"))
    return rounded(C.donor_prior(near, levels, table), donor_level=4, donor_price=2)


_OWN = _CURVE + """,
 own0 AS (SELECT p.sku_id, p.week_start, units, CASE WHEN weeks_since_launch > 26 THEN 1.0::DOUBLE ELSE c.curve END AS cv FROM panel p LEFT JOIN curve c ON c.category = p.category AND c.age = least(weeks_since_launch, 26) WHERE weeks_since_launch >= 1),
 own1 AS (SELECT sku_id, week_start, avg(cv) OVER w AS mc, avg(units) OVER w AS mu, count(*) OVER w AS n FROM own0 WINDOW w AS (PARTITION BY sku_id ORDER BY week_start ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
 own AS (SELECT sku_id, week_start, CASE WHEN mc > 1e-6 THEN mu/mc END AS own_level, CASE WHEN mc > 1e-6 THEN n ELSE 0 END AS own_weeks FROM own1)"""


@query("observed_level", with_sql("part", "panel", f"SELECT sku_id, max(own_weeks) AS own_weeks, {q('max(own_level)', 3)} AS highest, {q('sum(own_level)', 2)} AS total FROM own GROUP BY 1", _OWN))
def observed_level(spark, d):
    panel = part(spark, d).panel
    out = C.observed_level(panel, C.launch_curve(panel)).groupBy("sku_id").agg(
        F.max("own_weeks").alias("own_weeks"), F.max("own_level").alias("highest"),
        F.sum("own_level").alias("total"),
    )
    return rounded(out, highest=3, total=2)


# The same model in SQL at every origin at which a product is young.
_COLD = _NEAR + ",\n " + _OWN + ",\n " + _SEAS + """,
 cs AS (SELECT p.sku_id, p.category, p.week_start, p.weeks_since_launch, h.horizon, p.week_start + 7*h.horizon AS target_week, own_level, own_weeks, CASE WHEN a.list_price/donor_price > 0 THEN donor_level*pow(a.list_price/donor_price, elasticity) ELSE donor_level END AS borrowed
   FROM panel p CROSS JOIN (SELECT unnest(range(1,9))::INT AS horizon) h CROSS JOIN ela LEFT JOIN own ON own.sku_id = p.sku_id AND own.week_start = p.week_start LEFT JOIN prior ON prior.sku_id = p.sku_id JOIN attr a ON a.sku_id = p.sku_id WHERE p.weeks_since_launch < 26),
 cf AS (SELECT cs.*, coalesce(own_weeks/(own_weeks+8.0::DOUBLE)*own_level + (1-own_weeks/(own_weeks+8.0::DOUBLE))*borrowed, own_level, borrowed) * CASE WHEN cs.weeks_since_launch + horizon > 26 THEN 1.0::DOUBLE ELSE k.curve END * coalesce(idx, 1.0) AS f
   FROM cs LEFT JOIN curve k ON k.category = cs.category AND k.age = least(cs.weeks_since_launch + horizon, 26) LEFT JOIN sea ON sea.category = cs.category AND sea.iw = weekofyear(target_week))"""


def _cold(R):
    panel = R.panel
    rows = X.expand_horizons(panel.where(F.col("weeks_since_launch") < E.NEW_WEEKS), H, labelled=False)
    rows = rows.select("sku_id", "category", "week_start", "horizon", "target_week",
                       "weeks_since_launch", "y")
    return C.cold_start(rows, panel, C.fit_cold_start(panel))


@query("cold_start_forecast", with_sql("part", "panel", f"SELECT sku_id, week_start, horizon, {q('greatest(f, 0)', 3)} AS cold_start FROM cf", _COLD))
def cold_start_forecast(spark, d):
    return rounded(_cold(part(spark, d)).select("sku_id", "week_start", "horizon", "cold_start"), cold_start=3)


@query("accuracy_by_age", with_sql("part", "sup", f"""SELECT CASE WHEN weeks_since_launch <= 4 THEN '0-4 weeks' WHEN weeks_since_launch <= 8 THEN '5-8 weeks' WHEN weeks_since_launch <= 13 THEN '9-13 weeks' WHEN weeks_since_launch <= 26 THEN '14-26 weeks' ELSE '27+ weeks' END AS age_band,
  count(*) AS rows, {q('sum(y)/max(total)', 6)} AS units_share, {q(wape_sql('y', 'b'), 6)} AS baseline_wape, {q(wape_sql('y', 'n'), 6)} AS naive_wape FROM (SELECT *, greatest(coalesce(units_seasonal_lag, units_roll_mean_4, 0.0), 0.0) AS b, coalesce(units_lag_0, 0.0) AS n, sum(y) OVER () AS total FROM sup) GROUP BY 1"""))
def accuracy_by_age(spark, d):
    from stockloom.models.baseline import with_baselines

    base = X.add_rolling(X.add_lags(part(spark, d).panel))
    rows = with_baselines(X.expand_horizons(base, H, True))
    out = I.accuracy_by_age(rows, ["baseline", "naive"])
    return rounded(out, units_share=6, baseline_wape=6, naive_wape=6)


