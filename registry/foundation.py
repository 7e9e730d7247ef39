"""Scalar functions, contracts, profiles, sources and sinks."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from registry.core import fx, part, q, query, rounded, style
from registry.sql import cdf_sql, pdf_sql, with_sql
from stockloom import contracts as C
from stockloom.functions import scalar as S
from stockloom.operators import cleaning, lookup, profile
from stockloom.session import scratch_path
from stockloom.sources import extracts, store, uploads

# The text extract in SQL; numbers keep a value and a spelling so that rows that are
# equal as text stay equal here.
RAW_SALES = """raw AS (SELECT * FROM (
 SELECT l_orderkey, l_linenumber, 0 AS copy,
  CASE WHEN l_orderkey % 997 = 0 THEN 'not a date' WHEN l_linenumber % 4 = 1 THEN strftime("date", '%d-%m-%Y') ELSE strftime("date", '%Y-%m-%d') END AS date_text,
  CASE WHEN l_orderkey % 997 = 0 THEN NULL ELSE "date" END AS day,
  CASE WHEN l_orderkey % 251 = 0 THEN 'GHOST-' || l_linenumber WHEN l_linenumber % 3 = 0 THEN ' ' || lower(sku_id) || '  ' ELSE sku_id END AS sku_text,
  CASE WHEN l_returnflag = 'R' AND l_orderkey % 50 = 0 THEN -units_sold ELSE units_sold END AS units,
  CASE WHEN l_orderkey % 67 = 3 THEN NULL ELSE round(revenue*100)/100 END AS rev, l_linenumber = 2 AS rev_style,
  CASE WHEN l_orderkey % 100 = 1 THEN NULL WHEN l_orderkey % 100 = 2 THEN 0.0::DOUBLE ELSE floor(unit_price*100+0.5)/100 END AS price,
  promo_flag AS promo, l_linenumber % 3 AS promo_style FROM lines)),
 doubled AS (SELECT * FROM raw UNION ALL SELECT * REPLACE (1 AS copy) FROM raw WHERE l_orderkey % 125 = 0),
 distinct_text AS (SELECT DISTINCT date_text, day, sku_text, units, rev, rev_style, price, promo, promo_style FROM doubled)"""


@query(
    "norm_sku_ids",
    with_sql("style", "lines",
             "SELECT upper(trim(sku_text)) AS sku_id, count(*) AS rows, count(*) FILTER (upper(trim(sku_text)) <> sku_text) AS changed "
             "FROM doubled GROUP BY 1", RAW_SALES),
)
def norm_sku_ids(spark, d):
    raw = style(spark, d).sales_raw
    clean = S.norm_sku("sku_id")
    return raw.groupBy(clean.alias("sku_id")).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(clean != F.col("sku_id")).alias("changed")
    )


@query(
    "parse_mixed_dates",
    with_sql("style", "lines",
             "SELECT day AS \"date\", count(*) AS rows FROM doubled GROUP BY 1", RAW_SALES),
)
def parse_mixed_dates(spark, d):
    return style(spark, d).sales_raw.groupBy(S.parse_dates("date").alias("date")).agg(
        F.count(F.lit(1)).alias("rows")
    )


@query(
    "parse_flags_and_numbers",
    with_sql("style", "lines",
             "SELECT promo AS promo_flag, count(*) AS rows, sum(units) AS units, "
             f"{q('sum(rev)', 0)} AS revenue, count(rev) AS revenue_rows, {q('sum(price)', 0)} AS price "
             "FROM doubled GROUP BY 1", RAW_SALES),
)
def parse_flags_and_numbers(spark, d):
    out = style(spark, d).sales_raw.groupBy(S.parse_flag("promo_flag").alias("promo_flag")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(S.to_number("units_sold")).alias("units"),
        F.sum(S.to_number("revenue")).alias("revenue"),
        F.count(S.to_number("revenue")).alias("revenue_rows"),
        F.sum(S.to_number("unit_price")).alias("price"),
    )
    return rounded(out, revenue=0, price=0)


@query(
    "category_vocabulary",
    with_sql("part", "master", """SELECT category, recovered, count(*) AS skus FROM (
      SELECT CASE WHEN kind IN (0,5) AND broken THEN 'Unclassified' ELSE category END AS category, kind IN (0,5) AND NOT broken AS recovered
      FROM (SELECT category, no % 6 AS kind, (no % 5 <> 0 AND no % 31 = 0) AS broken FROM (SELECT *, CAST(regexp_extract(sku_id, '([0-9]+)$', 1) AS BIGINT) + 7*length(category) AS no FROM master))) GROUP BY 1,2"""),
)
def category_vocabulary(spark, d):
    raw = part(spark, d).master_raw.filter("_row_seq.copy = 0")
    label, recovered = cleaning.norm_category("category", S.norm_sku("sku_id"))
    return raw.select(label.alias("category"), recovered.alias("recovered")).groupBy(
        "category", "recovered"
    ).agg(F.count(F.lit(1)).alias("skus"))


@query(
    "fold_labels",
    "SELECT lang, folded, count(*) AS docs FROM (SELECT lang, regexp_replace(replace(replace(lower(strip_accents("
    "trim(text))), ' and ', ' & '), 'organization', 'organisation'), '\\s+', ' ', 'g') AS folded FROM documents) GROUP BY 1,2",
)
def fold_labels(spark, d):
    docs = style(spark, d).table("documents")
    return docs.groupBy("lang", S.fold_label(F.col("text")).alias("folded")).agg(
        F.count(F.lit(1)).alias("docs")
    )


@query(
    "iso_week_season",
    "SELECT CAST(date_trunc('week', d) AS DATE) AS week_start, isoyear(d) AS iso_year, weekofyear(d) AS iso_week, month(d) AS \"month\", "
    "CASE WHEN month(d) IN (12,1,2) THEN 'Winter' WHEN month(d) IN (3,4) THEN 'Spring' WHEN month(d) IN (5,6) THEN 'Summer' "
    "WHEN month(d) IN (7,8,9) THEN 'Monsoon' ELSE 'Festive' END AS season, count(*) AS rows FROM (SELECT CAST(o_orderdate AS DATE) AS d FROM orders) GROUP BY 1,2,3,4,5",
)
def iso_week_season(spark, d):
    orders = style(spark, d).table("orders").select(F.col("o_orderdate").cast("date").alias("d"))
    return orders.groupBy(
        S.week_start("d").alias("week_start"), S.iso_year("d").alias("iso_year"),
        S.iso_week("d").alias("iso_week"), F.month("d").alias("month"), S.season("d").alias("season"),
    ).agg(F.count(F.lit(1)).alias("rows"))


@query(
    "cyclical_week_encoding",
    with_sql("style", "weeks", f"SELECT week_start, iso_week, {q('week_sin', 6)} AS week_sin, {q('week_cos', 6)} AS week_cos FROM weeks"),
)
def cyclical_week_encoding(spark, d):
    return rounded(
        style(spark, d).weeks.select("week_start", "iso_week", "week_sin", "week_cos"),
        week_sin=6, week_cos=6,
    )


@query(
    "clip_and_ratio",
    "SELECT l_returnflag, count(c) AS rows, " + q("sum(c)", 3) + " AS clipped, " + q("sum(r)", 3) + " AS ratio, count(z) AS defined "
    "FROM (SELECT l_returnflag, greatest(least(l_extendedprice/l_quantity/1000.0::DOUBLE, 5.0), 0.2) AS c, l_tax/(l_discount+1e-6) AS r, "
    "l_tax/nullif(l_discount, 0) AS z FROM lineitem) GROUP BY 1",
)
def clip_and_ratio(spark, d):
    li = style(spark, d).table("lineitem")
    rows = li.select(
        "l_returnflag",
        S.clip(F.col("l_extendedprice") / F.col("l_quantity") / 1000.0, 0.2, 5.0).alias("c"),
        S.ratio("l_tax", "l_discount").alias("r"),
        S.ratio_or_null("l_tax", "l_discount").alias("z"),
    )
    out = rows.groupBy("l_returnflag").agg(
        F.count("c").alias("rows"), F.sum("c").alias("clipped"), F.sum("r").alias("ratio"),
        F.count("z").alias("defined"),
    )
    return rounded(out, clipped=3, ratio=3)


_X = "((l_quantity-25)/8.0::DOUBLE)"
_K = "((l_quantity - 30.0::DOUBLE)/5.0::DOUBLE)"


@query(
    "normal_functions",
    f"SELECT l_quantity, {q(cdf_sql(_X), 6)} AS cdf, {q(pdf_sql(_X), 6)} AS pdf, "
    f"{q(f'greatest(5.0::DOUBLE*({_K}*{cdf_sql(_K)}+{pdf_sql(_K)}), 0.0)', 6)} AS loss, "
    f"count(*) AS rows FROM lineitem GROUP BY l_quantity",
)
def normal_functions(spark, d):
    li = style(spark, d).table("lineitem").groupBy("l_quantity").agg(F.count(F.lit(1)).alias("rows"))
    x = (F.col("l_quantity") - 25) / 8.0
    return li.select(
        "l_quantity", fx(S.norm_cdf(x), 6).alias("cdf"), fx(S.norm_pdf(x), 6).alias("pdf"),
        fx(S.normal_loss("l_quantity", F.lit(5.0), F.lit(30.0)), 6).alias("loss"), "rows",
    )


@query(
    "risk_levels",
    "SELECT CASE WHEN x >= 0.8 THEN 'critical' WHEN x >= 0.5 THEN 'high' WHEN x >= 0.25 THEN 'medium' WHEN x >= 0.05 THEN 'low' ELSE 'none' END AS level, "
    "count(*) AS rows FROM (SELECT l_quantity/50.0::DOUBLE AS x FROM lineitem) GROUP BY 1",
)
def risk_levels(spark, d):
    x = F.col("l_quantity") / 50.0
    return style(spark, d).table("lineitem").groupBy(S.risk_level(x).alias("level")).agg(
        F.count(F.lit(1)).alias("rows")
    )


@query(
    "format_rupees",
    "SELECT o_custkey, CASE WHEN v >= 1e7 THEN 'Rs ' || format('{:,.2f}', v/1e7) || ' Cr' WHEN v >= 1e5 THEN 'Rs ' || format('{:,.2f}', v/1e5) || ' L' "
    "ELSE 'Rs ' || format('{:,.0f}', v) END AS amount FROM (SELECT o_custkey, CAST(sum(CAST(round(o_totalprice*100) AS BIGINT)) AS DOUBLE)/100 AS v FROM orders GROUP BY 1)",
)
def format_rupees(spark, d):
    total = style(spark, d).table("orders").groupBy("o_custkey").agg(
        (F.sum(F.round(F.col("o_totalprice") * 100).cast("long")) / F.lit(100.0)).alias("v")
    )
    return total.select("o_custkey", S.format_inr("v").alias("amount"))


@query(
    "half_even_rounding",
    "SELECT l_quantity, round_even(l_quantity/8.0::DOUBLE, 2) AS eighth, round_even(l_quantity/4.0::DOUBLE, 1) AS quarter, count(*) AS rows FROM lineitem GROUP BY 1",
)
def half_even_rounding(spark, d):
    li = style(spark, d).table("lineitem").groupBy("l_quantity").agg(F.count(F.lit(1)).alias("rows"))
    return li.select(
        "l_quantity", S.round_even(F.col("l_quantity") / 8.0, 2).alias("eighth"),
        S.round_even(F.col("l_quantity") / 4.0, 1).alias("quarter"), "rows",
    )


@query(
    "catalogue_search",
    with_sql("part", "master", "SELECT sku_id, category, subcategory FROM master WHERE lower(category) = 'lighting' AND "
             "(contains(lower(sku_id), 'brand#1') OR contains(lower(subcategory), 'brand#1'))"),
)
def catalogue_search(spark, d):
    return lookup.catalogue(part(spark, d).master, " LIGHTING ", "Brand#1")


@query("category_list", with_sql("style", "master", "SELECT DISTINCT category FROM master"))
def category_list(spark, d):
    return lookup.distinct_values(style(spark, d).master, "category")


@query(
    "response_terms",
    "SELECT l_linenumber, " + q("sum(ln(1+l_quantity))", 3) + " AS log_units, " + q("sum(exp(l_discount))", 3) + " AS growth, "
    + q("sum(pow(1.0::DOUBLE+l_tax, 2))", 3) + " AS power FROM lineitem GROUP BY 1",
)
def response_terms(spark, d):
    out = style(spark, d).table("lineitem").groupBy("l_linenumber").agg(
        F.sum(F.log1p("l_quantity")).alias("log_units"), F.sum(F.exp("l_discount")).alias("growth"),
        F.sum(F.pow(F.lit(1.0) + F.col("l_tax"), F.lit(2))).alias("power"),
    )
    return rounded(out, log_units=3, growth=3, power=3)


@query(
    "launch_age",
    with_sql("part", ("master", "span"), "SELECT greatest((b - launch_date)//7, 0) AS weeks_since_launch, CAST(b >= launch_date AS INT) AS is_post_launch, count(*) AS skus "
             "FROM master, span GROUP BY 1,2"),
)
def launch_age(spark, d):
    R = part(spark, d)
    age, flag = S.launch_age(F.lit(R.span[1]), "launch_date")
    return R.master.groupBy(age.alias("weeks_since_launch"), flag.alias("is_post_launch")).agg(
        F.count(F.lit(1)).alias("skus")
    )


# --------------------------------------------------------------------------- #
# Contracts and profiles
# --------------------------------------------------------------------------- #
_P = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
      "l_returnflag", "l_linestatus", "l_shipdate")


_KIND = {c: "string" if c in ("l_returnflag", "l_linestatus") else "any" if c == "l_shipdate" else "number" for c in _P}


@query(
    "contract_check",
    "SELECT count(*) AS rows, " + ", ".join(f"count(*) - count({c}) AS nulls_{c}" for c in _P)
    + ", count(*) FILTER (l_orderkey IS NULL OR l_linenumber IS NULL) AS null_key_rows, count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS duplicate_key_rows FROM lineitem",
)
def contract_check(spark, d):
    """Every column of the table is required; the key is the order line."""
    rules = C.contract("lineitem", " ".join(f"{c}:{_KIND[c]}!" for c in _P), "l_orderkey l_linenumber")
    return C.contract_counts(style(spark, d).table("lineitem"), rules)


def _profile_sql() -> str:
    one = []
    for c in _P:
        text = f"CAST({c} AS VARCHAR)"
        one.append(
            f"SELECT '{c}' AS \"column\", count(*) AS rows, count(*) - count({c}) AS nulls, count(DISTINCT {text}) AS \"distinct\", "
            f"(SELECT string_agg(v, ', ' ORDER BY v) FROM (SELECT DISTINCT {text} AS v FROM lineitem WHERE {c} IS NOT NULL ORDER BY v LIMIT 5)) AS samples, "
            f"round(100.0::DOUBLE*(count(*) - count({c}))/count(*), 3) AS null_pct FROM lineitem"
        )
    return " UNION ALL ".join(one)


@query("profile_lineitem", _profile_sql())
def profile_lineitem(spark, d):
    return profile.profile(style(spark, d).table("lineitem").select(*_P))


@query(
    "profile_duplicates",
    "SELECT count(*) AS rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM lineitem)) AS exact_duplicate_rows, 11 AS columns FROM lineitem",
)
def profile_duplicates(spark, d):
    return profile.duplicate_rows(style(spark, d).table("lineitem"))


def _preflight_sql() -> str:
    parts = []
    for c, e in (("date", "date_text"), ("sku_id", "sku_text"), ("units_sold", "units"), ("revenue", "rev"),
                 ("unit_price", "price"), ("promo_flag", "promo")):
        parts.append(f"SELECT 'sales_daily' AS \"table\", '{c}' AS \"column\", count(*) AS rows, round(100.0::DOUBLE*(count(*)-count({e}))/count(*), 3) AS null_pct FROM doubled")
    return ("SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY \"table\" ORDER BY null_pct DESC, \"column\") AS rank FROM ("
            + " UNION ALL ".join(parts) + ")) WHERE rank <= 3")


@query("preflight_nulls", with_sql("style", "lines", _preflight_sql(), RAW_SALES))
def preflight_nulls(spark, d):
    raw = style(spark, d).sales_raw.drop("_row_seq")
    return profile.preflight({"sales_daily": raw})


# --------------------------------------------------------------------------- #
# Sources and sinks: written to the shared folder, then read back
# --------------------------------------------------------------------------- #
def _csv_folder(spark, d) -> str:
    R = style(spark, d)
    folder = scratch_path(spark, "extracts")
    tables = {
        "sales_daily": R.sales_raw, "sku_master": R.master_raw, "calendar": R.calendar_raw,
        "inventory_snapshots": R.inventory_raw, "marketing_spend": R.marketing_raw,
    }
    for name, df in tables.items():
        plain = df.drop("_row_seq")
        (plain.write.option("quoteAll", True).option("emptyValue", "").csv(f"{folder}/{name}.csv", header=True))
    return folder


@query(
    "read_extracts",
    with_sql("style", "lines", f"""SELECT 'sales_daily' AS "table", count(*) AS rows, CAST(count(rev) AS BIGINT) AS filled FROM doubled
     UNION ALL SELECT 'marketing_spend', count(*), count(*) FILTER (NOT (l_orderkey % 59 = 0 AND l_orderkey % 61 <> 0)) FROM lines""", RAW_SALES),
)
def read_extracts(spark, d):
    folder = _csv_folder(spark, d)
    need = extracts.load_extracts(spark, folder)["sales_daily"]
    extra = extracts.load_optional(spark, folder)["marketing_spend"]
    rows = lambda df, t, c: df.agg(
        F.count(F.lit(1)).alias("rows"), F.count(c).alias("filled")
    ).select(F.lit(t).alias("table"), "rows", "filled")
    return rows(need, "sales_daily", "revenue").unionByName(
        rows(extra, "marketing_spend", "media_spend")
    )


@query(
    "adapt_headers",
    with_sql("style", "master", "SELECT sku_id, CASE category WHEN 'Decor' THEN 'Decor' ELSE category END AS category, subcategory, launch_date, unit_cost, list_price FROM master"),
)
def adapt_headers(spark, d):
    back = {v: k for k, v in extracts.RENAMES["sku_master"].items()}
    spelled = {v: k for k, v in extracts.CATEGORY_ALIGNMENT.items()}
    given = style(spark, d).master.withColumnsRenamed(back).replace(spelled, subset=["Category"])
    return extracts.adapt_extract(
        given, extracts.RENAMES["sku_master"], {"Category": extracts.CATEGORY_ALIGNMENT}
    )


def _actuals_upload(R):
    """Weekly order quantities under free headers, dates as text, a few unreadable."""
    wk = S.week_start("date")
    weekly = R.lines.groupBy("sku_id", wk.alias("w")).agg(F.sum("units_sold").alias("u"))
    no = F.datediff("w", F.lit(dt.date(1990, 1, 1))) / 7
    return weekly.select(
        F.lower("sku_id").alias("Item Code"),
        F.when(no % 50 == 0, "soon").otherwise(F.date_format("w", "yyyy-MM-dd")).alias("Week Of"),
        F.when(no % 21 == 0, F.concat(F.lit("-"), F.col("u").cast("long").cast("string")))
        .otherwise(F.format_number(F.col("u") * 100, 0)).alias("Qty Sold"),
    )


@query(
    "parse_actuals",
    with_sql("style", "lines", """SELECT sku_id, w AS week_starting, CASE WHEN ((w - DATE '1990-01-01')//7) % 21 = 0 THEN 0.0::DOUBLE ELSE u*100 END AS units FROM
      (SELECT sku_id, CAST(date_trunc('week', "date") AS DATE) AS w, sum(units_sold) AS u FROM lines GROUP BY 1,2) WHERE ((w - DATE '1990-01-01')//7) % 50 <> 0"""),
)
def parse_actuals(spark, d):
    return uploads.parse_actuals(_actuals_upload(style(spark, d)))


def _forecast_upload(R):
    wk = S.week_start("date")
    per = R.lines.groupBy("sku_id", wk.alias("w"), F.col("l_linenumber").alias("h")).agg(
        F.sum("units_sold").alias("u")
    )
    return per.select(
        F.concat(F.lit(" "), F.lower("sku_id")).alias("Product"),
        F.date_format(F.date_add("w", 2), "yyyy-MM-dd").alias("Target Week"),
        F.col("h").cast("string").alias("Horizon"),
        F.col("u").cast("string").alias("yhat"),
        F.when(F.col("h") % 2 == 0, (F.col("u") / 2).cast("string")).alias("p10"),
        F.struct(F.col("h")).alias("_row_seq"),
    )


@query(
    "parse_forecast",
    with_sql("style", "lines", """SELECT sku_id, w AS target_week, CAST(h AS BIGINT) AS horizon, u AS prediction, CASE WHEN h % 2 = 0 THEN u/2 ELSE u END AS prediction_lower, u AS prediction_upper FROM (
      SELECT *, row_number() OVER (PARTITION BY sku_id, w ORDER BY h DESC) AS rn FROM (SELECT sku_id, CAST(date_trunc('week', "date") AS DATE) AS w, l_linenumber AS h, sum(units_sold) AS u FROM lines GROUP BY 1,2,3)) WHERE rn = 1"""),
)
def parse_forecast(spark, d):
    return uploads.parse_forecast(_forecast_upload(style(spark, d)))


@query(
    "combine_uploads",
    with_sql("style", "lines", """SELECT sku_id, week_starting, units FROM (SELECT *, row_number() OVER (PARTITION BY sku_id, week_starting ORDER BY f DESC) AS rn FROM (
      SELECT sku_id, w AS week_starting, CASE WHEN ((w - DATE '1990-01-01')//7) % 21 = 0 THEN 0.0::DOUBLE ELSE u*100 END AS units, 0 AS f FROM (SELECT sku_id, CAST(date_trunc('week', "date") AS DATE) AS w, sum(units_sold) AS u FROM lines GROUP BY 1,2) WHERE ((w - DATE '1990-01-01')//7) % 50 <> 0
      UNION ALL SELECT sku_id, CAST(date_trunc('week', "date") AS DATE), CAST(max(l_linenumber) + 12 AS DOUBLE), 1 FROM lines WHERE month("date") = 6 GROUP BY 1,2)) WHERE rn = 1"""),
)
def combine_uploads(spark, d):
    """Twelve rows for each product and week in both files; the last of them counts."""
    R = style(spark, d)
    nth = F.explode(F.sequence(F.lit(1), F.lit(12)))
    first = _actuals_upload(R).withColumn("_row_seq", nth).withColumn(
        "Qty Sold", F.when(F.col("_row_seq") < 12, F.col("_row_seq").cast("string")).otherwise(F.col("Qty Sold"))
    )
    second = R.lines.filter(F.month("date") == 6).groupBy(
        F.col("sku_id").alias("sku"), S.week_start("date").alias("week")
    ).agg(F.max("l_linenumber").alias("units")).withColumn("_row_seq", nth).withColumns(
        {"units": F.col("units") + F.col("_row_seq"), "_row_seq": F.struct(F.lit(0).alias("block"), F.col("_row_seq").alias("row"))}
    )
    actuals, _ = uploads.combine_uploads([first, second, _forecast_upload(R)])
    return actuals


@query(
    "write_and_read_tables",
    with_sql("style", "panel", "SELECT year(week_start) AS year, count(*) AS rows, sum(units) AS units FROM panel GROUP BY 1"),
)
def write_and_read_tables(spark, d):
    return _by_year(_panel_back(spark, d))


def _panel_back(spark, d):
    R = style(spark, d)
    folder = scratch_path(spark, "tables")
    store.write_outputs({"weekly_panel": R.panel, "calendar": R.calendar}, folder)
    return store.read_artifacts(spark, folder, ("weekly_panel",), ("marketing_clean",))["weekly_panel"]


def _by_year(panel):
    return panel.groupBy(F.year("week_start").alias("year")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum("units").alias("units")
    )


@query(
    "write_and_read_all_years",
    with_sql("style", "panel", "SELECT year(week_start) AS year, count(*) AS rows, sum(units) AS units FROM panel GROUP BY 1"),
)
def write_and_read_all_years(spark, d):
    return _by_year(_panel_back(spark, d))


@query(
    "csv_round_trip",
    with_sql("style", "sales", f"SELECT sku_id, count(*) AS days, min(\"date\") AS first_day, {q('sum(revenue)', 1)} AS revenue FROM sales GROUP BY 1"),
)
def csv_round_trip(spark, d):
    path = scratch_path(spark, "csv")
    store.write_csv(style(spark, d).sales, path)
    back = extracts.read_text(spark, path)
    out = back.groupBy("sku_id").agg(
        F.count(F.lit(1)).alias("days"), F.min(S.parse_dates("date")).alias("first_day"),
        F.sum(S.to_number("revenue")).alias("revenue"),
    )
    return rounded(out, revenue=1)
