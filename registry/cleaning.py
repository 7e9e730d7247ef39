"""Cleaning operators over the text extracts derived from order lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry.core import part, q, query, rounded, style
from registry.foundation import RAW_SALES
from registry.sql import with_sql
from stockloom.operators import audit as A
from stockloom.operators import cleaning as K
from stockloom.operators.audit import AuditTrail
from stockloom.session import cut

# Steps S1..S9 in SQL.  `typed` is the frame after S4 and S5.
_STEPS = RAW_SALES + """,
 typed AS (SELECT day AS "date", upper(trim(sku_text)) AS sku_id, units, rev, price, promo FROM distinct_text
   WHERE day IS NOT NULL AND upper(trim(sku_text)) IN (SELECT sku_id FROM master)),
 zeroed AS (SELECT "date", sku_id, greatest(units, 0.0) AS units_sold, CASE WHEN units < 0 THEN 0.0::DOUBLE ELSE rev END AS revenue, price AS unit_price, promo AS promo_flag FROM typed),
 med AS (SELECT sku_id, quantile_cont(unit_price, 0.5) AS m FROM zeroed WHERE unit_price IS NOT NULL GROUP BY 1),
 priced AS (SELECT "date", z.sku_id, units_sold, revenue, promo_flag, coalesce(CASE WHEN implied > 0 THEN implied END, CASE WHEN m > 0 THEN m END, list_price) AS unit_price,
   (z.unit_price IS NULL OR z.unit_price <= 0) AS repaired FROM (SELECT *, CASE WHEN unit_price IS NULL OR unit_price <= 0 THEN revenue/nullif(units_sold, 0) ELSE unit_price END AS implied FROM zeroed) z
   LEFT JOIN med ON med.sku_id = z.sku_id LEFT JOIN master ma ON ma.sku_id = z.sku_id),
 filled AS (SELECT "date", sku_id, units_sold, coalesce(revenue, units_sold*unit_price) AS revenue, unit_price, promo_flag, revenue IS NULL AS rebuilt FROM priced),
 uniq AS (SELECT DISTINCT "date", sku_id, units_sold, revenue, unit_price, promo_flag FROM filled)"""

_NEED = ("lines", "master")


@query(
    "clean_exact_duplicates",
    with_sql("style", "lines", "SELECT sku_text AS sku_id, count(*) AS rows FROM distinct_text GROUP BY 1", RAW_SALES),
)
def clean_exact_duplicates(spark, d):
    return K.drop_exact_duplicates(style(spark, d).sales_raw).groupBy("sku_id").agg(
        F.count(F.lit(1)).alias("rows")
    )


@query(
    "clean_ids_and_dates",
    with_sql("style", "lines", "SELECT upper(trim(sku_text)) AS sku_id, day AS \"date\", count(*) AS rows FROM doubled WHERE day IS NOT NULL GROUP BY 1,2", RAW_SALES),
)
def clean_ids_and_dates(spark, d):
    rows = K.drop_bad_dates(K.clean_ids(style(spark, d).sales_raw))
    return rows.groupBy("sku_id", "date").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "clean_quarantine",
    with_sql("style", _NEED, "SELECT upper(trim(sku_text)) AS sku_id, count(*) AS rows FROM distinct_text WHERE upper(trim(sku_text)) NOT IN (SELECT sku_id FROM master) GROUP BY 1", RAW_SALES),
)
def clean_quarantine(spark, d):
    R = style(spark, d)
    _, rest = K.quarantine_unknown(K.clean_ids(K.drop_exact_duplicates(R.sales_raw)), R.master)
    return rest.groupBy("sku_id").agg(F.count(F.lit(1)).alias("rows"))


def _typed(R):
    sales = K.drop_bad_dates(K.clean_ids(K.drop_exact_duplicates(R.sales_raw)))
    sales, _ = K.quarantine_unknown(sales, R.master)
    return K.zero_returns(K.coerce_numeric(sales, ["units_sold", "revenue", "unit_price"]))


@query(
    "clean_returns",
    with_sql("style", _NEED, f"SELECT sku_id, count(*) AS rows, sum(units_sold) AS units_sold, {q('sum(revenue)', 1)} AS revenue, min(units_sold) AS least FROM zeroed GROUP BY 1", _STEPS),
)
def clean_returns(spark, d):
    out = _typed(style(spark, d)).groupBy("sku_id").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("units_sold").alias("units_sold"),
        F.sum("revenue").alias("revenue"), F.min("units_sold").alias("least"),
    )
    return rounded(out, revenue=1)


@query(
    "clean_price_repair",
    with_sql("style", _NEED, f"SELECT sku_id, count(*) AS rows, {q('sum(unit_price)', 1)} AS total, {q('min(unit_price)', 3)} AS least, {q('max(unit_price)', 3)} AS most FROM priced GROUP BY 1", _STEPS),
)
def clean_price_repair(spark, d):
    R = style(spark, d)
    out = K.repair_price(_typed(R), R.master).groupBy("sku_id").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("unit_price").alias("total"),
        F.min("unit_price").alias("least"), F.max("unit_price").alias("most"),
    )
    return rounded(out, total=1, least=3, most=3)


@query(
    "clean_revenue_and_flag",
    with_sql("style", _NEED, f"SELECT sku_id, promo_flag, count(*) AS rows, {q('sum(revenue)', 1)} AS revenue FROM filled GROUP BY 1,2", _STEPS),
)
def clean_revenue_and_flag(spark, d):
    R = style(spark, d)
    # The repair reads the typed rows several times; their text is parsed once.
    typed = cut(_typed(R).select("sku_id", "units_sold", "revenue", "unit_price", "promo_flag"))
    sales = K.clean_promo_flag(K.repair_revenue(K.repair_price(typed, R.master)))
    out = sales.groupBy("sku_id", "promo_flag").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("revenue").alias("revenue")
    )
    return rounded(out, revenue=1)


@query(
    "clean_sales_dedupe",
    with_sql("style", _NEED, f"SELECT \"date\", sku_id, sum(units_sold) AS units_sold, {q('sum(revenue)', 2)} AS revenue, {q('avg(unit_price)', 3)} AS unit_price, max(promo_flag) AS promo_flag FROM uniq GROUP BY 1,2", _STEPS),
)
def clean_sales_dedupe(spark, d):
    R = style(spark, d)
    return rounded(K.clean_sales(R.sales_raw, R.master), revenue=2, unit_price=3)


_RAW_MASTER = """num AS (SELECT *, CAST(regexp_extract(sku_id, '([0-9]+)$', 1) AS BIGINT) + 7*length(category) AS no FROM master),
 m0 AS (SELECT no, 0 AS copy, CASE WHEN no % 5 <> 0 AND no % 31 = 0 THEN 'X' || sku_id ELSE sku_id END AS sku_id,
   CASE WHEN no % 6 IN (0,5) AND (no % 5 <> 0 AND no % 31 = 0) THEN 'Unclassified' ELSE category END AS category,
   CASE WHEN no % 9 = 0 THEN 'Unspecified' ELSE subcategory END AS subcategory,
   CASE WHEN no % 13 = 0 THEN DATE '1970-01-01' ELSE launch_date END AS launch_date,
   CASE WHEN no % 8 = 0 THEN 0.0::DOUBLE ELSE unit_cost END AS unit_cost, CASE WHEN no % 10 = 0 THEN NULL ELSE list_price END AS list_price FROM num),
 m1 AS (SELECT * FROM m0 UNION ALL SELECT * REPLACE (1 AS copy, 1.0::DOUBLE AS unit_cost) FROM m0 WHERE no % 3 = 0),
 mm AS (SELECT category, quantile_cont(unit_cost, 0.5) AS mc, quantile_cont(list_price, 0.5) AS mp FROM m1 GROUP BY 1)"""


@query(
    "clean_sku_master",
    with_sql("part", "master", f"SELECT sku_id, m1.category, subcategory, launch_date, {q('CASE WHEN unit_cost > 0 THEN unit_cost ELSE mc END', 3)} AS unit_cost, {q('CASE WHEN list_price > 0 THEN list_price ELSE mp END', 3)} AS list_price FROM m1 JOIN mm ON mm.category = m1.category WHERE copy = 0", _RAW_MASTER),
)
def clean_sku_master(spark, d):
    return rounded(K.clean_sku_master(part(spark, d).master_raw), unit_cost=3, list_price=3)


@query(
    "impute_money",
    with_sql("part", "master", f"SELECT m1.category, count(*) AS rows, {q('sum(CASE WHEN unit_cost > 0 THEN unit_cost ELSE mc END)', 1)} AS cost, {q('max(mp)', 3)} AS median_price FROM m1 JOIN mm ON mm.category = m1.category GROUP BY 1", _RAW_MASTER),
)
def impute_money(spark, d):
    raw = K.clean_category(part(spark, d).master_raw)
    median = K.exact_percentile(K.coerce_numeric(raw, ["list_price"]), ["category"], "list_price", 0.5, "median_price")
    cost = K.impute_money(raw).groupBy("category").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("unit_cost").alias("cost")
    )
    return rounded(cost.join(median.drop("n"), "category"), cost=1, median_price=3)


@query("clean_calendar", with_sql("style", "calendar", "SELECT * FROM calendar"))
def clean_calendar(spark, d):
    return K.clean_calendar(style(spark, d).calendar_raw)


_RAW_STOCK = """i0 AS (SELECT *, CAST(regexp_extract(sku_id, '([0-9]+)$', 1) AS BIGINT) + (("date" - DATE '1990-01-01')//7) AS pick FROM inventory),
 i1 AS (SELECT "date", sku_id, pick, 0 AS copy, CASE WHEN pick % 7 = 0 THEN NULL WHEN pick % 53 = 0 THEN -5.0::DOUBLE ELSE on_hand_units END AS oh,
   CASE WHEN pick % 11 = 0 THEN 0.0::DOUBLE ELSE on_order_units END AS on_order_units, CASE WHEN pick % 17 = 0 THEN 0.0::DOUBLE WHEN pick % 19 = 0 THEN 998.0 ELSE lead_time_days END AS lead, reorder_point FROM i0),
 i2 AS (SELECT * FROM i1 UNION ALL SELECT * REPLACE (1 AS copy, 777.0::DOUBLE AS oh) FROM i1 WHERE pick % 29 = 0),
 i3 AS (SELECT *, greatest(coalesce(last_value(oh IGNORE NULLS) OVER (PARTITION BY sku_id ORDER BY "date", copy ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0), 0) AS on_hand_units FROM i2),
 ms AS (SELECT sku_id, quantile_cont(lead, 0.5) AS m FROM i2 WHERE lead BETWEEN 1 AND 120 GROUP BY 1),
 mg AS (SELECT quantile_cont(lead, 0.5) AS g FROM i2 WHERE lead BETWEEN 1 AND 120),
 i4 AS (SELECT "date", i3.sku_id, copy, on_hand_units, on_order_units, CASE WHEN lead BETWEEN 1 AND 120 THEN lead ELSE least(greatest(coalesce(m, g), 1), 120) END AS lead_time_days, reorder_point
   FROM i3 LEFT JOIN ms ON ms.sku_id = i3.sku_id CROSS JOIN mg)"""


@query(
    "clean_inventory",
    with_sql("style", "inventory", 'SELECT "date", sku_id, on_hand_units, on_order_units, lead_time_days, reorder_point FROM (SELECT *, row_number() OVER (PARTITION BY "date", sku_id ORDER BY copy DESC) AS rn FROM i4) WHERE rn = 1', _RAW_STOCK),
)
def clean_inventory(spark, d):
    R = style(spark, d)
    return K.clean_inventory(R.inventory_raw, R.master)


@query(
    "fill_on_hand",
    with_sql("style", "inventory", "SELECT sku_id, count(*) AS rows, sum(on_hand_units) AS on_hand_units, count(*) FILTER (on_hand_units = 0) AS empty FROM i3 GROUP BY 1", _RAW_STOCK),
)
def fill_on_hand(spark, d):
    R = style(spark, d)
    stock = K.fill_on_hand(K.prepare_inventory(R.inventory_raw, R.master))
    return stock.groupBy("sku_id").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("on_hand_units").alias("on_hand_units"),
        F.count_if(F.col("on_hand_units") == 0).alias("empty"),
    )


@query(
    "repair_lead_time",
    with_sql("style", "inventory", "SELECT sku_id, count(*) AS rows, sum(lead_time_days) AS lead_time_days, min(lead_time_days) AS least, max(lead_time_days) AS most FROM i4 GROUP BY 1", _RAW_STOCK),
)
def repair_lead_time(spark, d):
    R = style(spark, d)
    stock = K.repair_lead_time(K.prepare_inventory(R.inventory_raw, R.master))
    return stock.groupBy("sku_id").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("lead_time_days").alias("lead_time_days"),
        F.min("lead_time_days").alias("least"), F.max("lead_time_days").alias("most"),
    )


MARKETING_SQL = """SELECT CAST(date_trunc('week', "date") AS DATE) AS week_start, sku_id,
  CAST(sum(CASE WHEN l_orderkey % 61 = 0 OR l_orderkey % 59 = 0 THEN 0 ELSE units_sold*10 END) AS DOUBLE) AS media_spend,
  CAST(sum(units_sold*300) AS DOUBLE) AS impressions, CAST(sum(l_linenumber) AS DOUBLE) AS email_sends
  FROM lines WHERE l_orderkey % 83 <> 0 GROUP BY 1,2"""
WEB_SQL = """SELECT "date", sku_id, sum(units_sold*3) AS sessions, sum(least(units_sold*3, CASE WHEN l_orderkey % 71 = 0 THEN 500.0::DOUBLE ELSE units_sold END)) AS add_to_cart FROM lines GROUP BY 1,2"""
CONDITIONS_SQL = """SELECT w AS week_start, category, CASE WHEN wk % 17 = 0 THEN 1.0::DOUBLE ELSE floor(10000.0::DOUBLE + tax*100.0::DOUBLE/n + 0.500001)/10000.0 END AS competitor_price_index,
  CASE WHEN wk % 5 = 0 THEN 0.0::DOUBLE ELSE CAST(wk % 9 - 4 AS DOUBLE) END AS weather_anomaly FROM (SELECT *, (w - DATE '1990-01-01')//7 AS wk FROM (
  SELECT category, CAST(date_trunc('week', "date") AS DATE) AS w, sum(CAST(round(l_tax*100) AS BIGINT)) AS tax, count(*) AS n FROM lines GROUP BY 1,2))"""


@query("clean_marketing", with_sql("style", "lines", MARKETING_SQL))
def clean_marketing(spark, d):
    R = style(spark, d)
    return K.clean_marketing(R.marketing_raw, R.master)


@query("clean_web_analytics", with_sql("style", "lines", WEB_SQL))
def clean_web_analytics(spark, d):
    R = style(spark, d)
    return K.clean_web(R.web_raw, R.master)


@query("clean_market_conditions", with_sql("style", "lines", CONDITIONS_SQL))
def clean_market_conditions(spark, d):
    return K.clean_conditions(style(spark, d).conditions_raw)


@query(
    "audit_trail",
    with_sql("style", _NEED, """SELECT 'sales_daily' AS "table", severity, detection, CAST(n AS BIGINT) AS rows_affected FROM (
      SELECT 'critical' AS severity, 'raw id compared with its normalised form' AS detection, (SELECT count(*) FROM distinct_text WHERE sku_text <> upper(trim(sku_text))) AS n
      UNION ALL SELECT 'critical', 'null after parsing', (SELECT count(*) FROM distinct_text WHERE day IS NULL)
      UNION ALL SELECT 'warning', 'anti-join against the master', (SELECT count(*) FROM distinct_text WHERE day IS NOT NULL AND upper(trim(sku_text)) NOT IN (SELECT sku_id FROM master))
      UNION ALL SELECT 'warning', 'units_sold < 0', (SELECT count(*) FROM typed WHERE units < 0)
      UNION ALL SELECT 'warning', 'null or <= 0', (SELECT count(*) FROM priced WHERE repaired)
      UNION ALL SELECT 'info', 'null count', (SELECT count(*) FROM filled WHERE rebuilt)
      UNION ALL SELECT 'warning', 'row count per (date, sku_id)', (SELECT count(*) - count(DISTINCT ("date", sku_id)) FROM uniq)) WHERE n > 0""", _STEPS),
)
def audit_trail(spark, d):
    R = style(spark, d)
    trail = AuditTrail()
    K.clean_sales(R.sales_raw, R.master, trail)
    kept = trail.to_df(spark).select("table", "severity", "detection", "rows_affected")
    text = ("values outside 0/1", "row count per (date, sku_id, units_sold, revenue, unit_price, promo_flag)")
    return kept.filter(~F.col("detection").isin(*text))


@query(
    "audit_summary",
    with_sql("style", "calendar", """SELECT CAST(3 AS BIGINT) AS decisions, CAST(sum(n) AS BIGINT) AS rows_touched, CAST(1 AS BIGINT) AS critical FROM (
      SELECT count(*) AS n FROM rep WHERE i % 2 = 0 UNION ALL SELECT count(*) FROM rep WHERE promo_event = '' UNION ALL SELECT count(*) FROM rep WHERE copy = 1)""",
             """idx AS (SELECT *, row_number() OVER (ORDER BY "date") - 1 AS i FROM calendar),
      rep AS (SELECT i, promo_event, 0 AS copy FROM idx UNION ALL SELECT i, 'REPEATED', 1 FROM idx WHERE i % 29 = 0)"""),
)
def audit_summary(spark, d):
    trail = AuditTrail()
    K.clean_calendar(style(spark, d).calendar_raw, trail)
    return A.audit_totals(A.by_severity(trail.to_df(spark)))
