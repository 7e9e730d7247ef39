"""Cleaning operators (CLN-*).  The order inside each ``clean_*`` is semantic.

Every raw frame may carry ``_row_seq``, any orderable column that says in which
order the rows arrived; "keep first" and "keep last" are decided by it.  Groups
are reduced with ``min_by``/``max_by``, which combine on the map side, so one key
holding most of a table never becomes one task's window.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from stockloom.contracts import (
    CATEGORY_CODES,
    DEFAULTS,
    SKU_CODE_PATTERN,
    UNCLASSIFIED,
    Settings,
)
from stockloom.functions import scalar as S
from stockloom.operators.audit import AuditTrail
from stockloom.operators.ranking import exact_percentile
from stockloom.session import cut, small_side

SEQ = "_row_seq"
SALES = ["date", "sku_id", "units_sold", "revenue", "unit_price", "promo_flag"]
MASTER = ["sku_id", "category", "subcategory", "launch_date", "unit_cost", "list_price"]
CALENDAR = ["date", "iso_year", "iso_week", "week_start", "month", "season", "is_holiday",
            "promo_event", "planned_discount"]
INVENTORY = ["date", "sku_id", "on_hand_units", "on_order_units", "lead_time_days",
             "reorder_point"]
MARKETING = ["week_start", "sku_id", "media_spend", "impressions", "email_sends"]
WEB = ["date", "sku_id", "sessions", "add_to_cart"]
CONDITIONS = ["week_start", "category", "competitor_price_index", "weather_anomaly"]


# --------------------------------------------------------------------------- #
# Shared steps
# --------------------------------------------------------------------------- #
def with_sequence(df: DataFrame) -> DataFrame:
    """Guarantee ``_row_seq``; without an arrival order the row's own values decide."""
    if SEQ in df.columns:
        return df
    return df.withColumn(SEQ, F.struct(*df.columns))


def _surplus(df: DataFrame, keys: list[str]) -> DataFrame:
    """Per-key row counts, the frame behind every "n duplicates" audit note."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))


def _pick(df: DataFrame, keys: list[str], chooser) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(chooser(F.struct(*rest), F.col(SEQ)).alias("_r"))
    return picked.select(*keys, "_r.*").select(*df.columns)


def keep_first(df: DataFrame, keys: list[str]) -> DataFrame:
    """SRT-4 / CLN-M5: first row per key in arrival order."""
    return _pick(with_sequence(df), keys, F.min_by)


def keep_last(df: DataFrame, keys: list[str]) -> DataFrame:
    """SRT-4 / CLN-I4: last row per key in arrival order."""
    return _pick(with_sequence(df), keys, F.max_by)


def _note_duplicates(audit, df, keys, table, issue, resolution, rationale, severity):
    if audit is not None:
        audit.add(
            table, issue, _surplus(df, keys), F.sum(F.col("_rows") - 1),
            f"row count per ({', '.join(keys)})", resolution, rationale, severity,
        )


def drop_exact_duplicates(df: DataFrame, audit: AuditTrail | None = None,
                          table: str = "sales_daily", severity: str = "critical") -> DataFrame:
    """CLN-S1: drop byte-identical rows, keeping the earliest arrival."""
    df = with_sequence(df)
    values = [c for c in df.columns if c != SEQ]
    _note_duplicates(
        audit, df, values, table, "{n} byte-identical duplicate row(s)",
        "dropped, first arrival kept",
        "an identical row is an export appended twice, not a second event", severity,
    )
    return df.groupBy(*values).agg(F.min(SEQ).alias(SEQ))


def clean_ids(df: DataFrame, audit: AuditTrail | None = None,
              table: str = "sales_daily") -> DataFrame:
    """CLN-S2: normalise product ids."""
    if audit is not None:
        changed = F.col("sku_id") != S.norm_sku("sku_id")
        audit.add(
            table, "{n} row(s) with padding or lower case in sku_id", df, F.count_if(changed),
            "raw id compared with its normalised form", "trimmed, collapsed, upper-cased",
            "two spellings of one product split its history", "critical",
        )
    return df.withColumn("sku_id", S.norm_sku("sku_id"))


def drop_bad_dates(df: DataFrame, audit: AuditTrail | None = None, table: str = "sales_daily",
                   column: str = "date") -> DataFrame:
    """CLN-C1 / CLN-S3: parse dates and drop the rows that have none."""
    parsed = df.withColumn(column, S.parse_dates(column))
    if audit is not None:
        audit.add(
            table, "{n} row(s) with an unreadable date", parsed,
            F.count_if(F.col(column).isNull()), "null after parsing", "dropped",
            "a row without a date cannot be placed in a week", "critical",
        )
    return parsed.filter(F.col(column).isNotNull())


def quarantine_unknown(df: DataFrame, master: DataFrame, audit: AuditTrail | None = None,
                       table: str = "sales_daily") -> tuple[DataFrame, DataFrame]:
    """CLN-S4: split into rows of known products and the quarantined rest."""
    known = master.select("sku_id")
    kept = df.join(known, "sku_id", "left_semi")
    rest = df.join(known, "sku_id", "left_anti")
    if audit is not None:
        ids = rest.groupBy("sku_id").agg(F.count(F.lit(1)).alias("_rows"))
        audit.add(
            table, "{n} row(s) reference products absent from the master", ids,
            F.sum("_rows"), "anti-join against the master", "quarantined and reported",
            "without category, cost and price a row cannot be valued", "warning",
        )
    return kept, rest


def quarantine_examples(rest: DataFrame, n: int = 5) -> DataFrame:
    """First unknown ids in order, for the report."""
    return rest.select("sku_id").distinct().orderBy("sku_id").limit(n)


def coerce_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """CLN-S5: text to numbers."""
    return df.withColumns({c: S.to_number(c) for c in columns})


# --------------------------------------------------------------------------- #
# Categories
# --------------------------------------------------------------------------- #
def _lookup(key: Column, pairs: dict[str, str]) -> Column:
    out = None
    for k, v in pairs.items():
        out = F.when(key == k, v) if out is None else out.when(key == k, v)
    return out


def norm_category(label, sku=None) -> tuple[Column, Column]:
    """FN-3: vocabulary label, recovered from the product code where needed.

    The vocabulary has six entries, so it is a CASE expression rather than a join.
    Returns the label and the "recovered from the code" mask.
    """
    folded = S.fold_label(label)
    # The canonical labels are plain ASCII, so lower-casing is their folded form.
    direct = _lookup(folded, {name.lower(): name for name in CATEGORY_CODES})
    by_code: Column = F.lit(None).cast("string")
    if sku is not None:
        code = F.regexp_extract(S.col(sku), SKU_CODE_PATTERN, 1)
        by_code = _lookup(code, {code_: name for name, code_ in CATEGORY_CODES.items()})
    recovered = direct.isNull() & by_code.isNotNull()
    return F.coalesce(direct, by_code, F.lit(UNCLASSIFIED)), F.coalesce(recovered, F.lit(False))


# --------------------------------------------------------------------------- #
# Product master
# --------------------------------------------------------------------------- #
def clean_category(master: DataFrame, audit: AuditTrail | None = None) -> DataFrame:
    """CLN-M1."""
    master = master.withColumn("sku_id", S.norm_sku("sku_id"))
    label, _ = norm_category("category", "sku_id")
    if audit is not None:
        spellings = F.count_distinct("category")
        audit.add(
            "sku_master", "more category spellings than categories ({n} rows re-labelled)",
            master, F.when(spellings > len(CATEGORY_CODES), F.count(F.lit(1))),
            "distinct count of the raw labels", "folded to the controlled vocabulary",
            "unmerged spellings fragment every grouping", "warning",
        )
        audit.add(
            "sku_master", "{n} product(s) have no category", master,
            F.count_if(F.col("category").isNull()), "null count",
            "recovered from the product code", "the code carries the category", "warning",
        )
        audit.add(
            "sku_master", "{n} product(s) could not be categorised", master,
            F.count_if(label == UNCLASSIFIED), "no vocabulary match and no usable code",
            f"labelled {UNCLASSIFIED} and kept", "their demand is real", "warning",
        )
    return master.withColumn("category", label)


def clean_subcategory(master: DataFrame) -> DataFrame:
    """CLN-M2."""
    return master.withColumn(
        "subcategory", F.coalesce(F.trim("subcategory"), F.lit("Unspecified"))
    )


def clean_launch_date(master: DataFrame, audit: AuditTrail | None = None) -> DataFrame:
    """CLN-M3: unreadable launch dates read as long-established."""
    parsed = master.withColumn("_launch", S.parse_dates("launch_date"))
    if audit is not None:
        audit.add(
            "sku_master", "{n} launch dates are written day first", parsed,
            F.count_if(F.col("launch_date").rlike(r"^\d{2}-\d{2}-\d{4}$")),
            "pattern on the raw text", "explicit layouts, ISO first",
            "guessing the layout row by row moves dates by months", "warning",
        )
        audit.add(
            "sku_master", "{n} launch dates are unreadable", parsed,
            F.count_if(F.col("_launch").isNull()), "null after parsing", "set to 1970-01-01",
            "a missing launch must not exclude the product", "warning",
        )
    return parsed.withColumn(
        "launch_date", F.coalesce("_launch", F.lit("1970-01-01").cast("date"))
    ).drop("_launch")


def impute_money(master: DataFrame, audit: AuditTrail | None = None) -> DataFrame:
    """CLN-M4: missing or non-positive cost and price take the category's median.

    The median covers all non-null values, bad ones included.
    """
    master = coerce_numeric(master, ["unit_cost", "list_price"])
    bad = {c: F.col(c).isNull() | (F.col(c) <= 0) for c in ("unit_cost", "list_price")}
    if audit is not None:
        audit.add(
            "sku_master", "{n} missing or non-positive cost/price value(s)", master,
            F.count_if(bad["unit_cost"]) + F.count_if(bad["list_price"]),
            "null or <= 0", "category median",
            "a zero would value the exposure at nothing", "critical",
        )
    out = master
    for c in ("unit_cost", "list_price"):
        medians = exact_percentile(master, ["category"], c, 0.5, f"_m_{c}", few_keys=True)
        out = out.join(small_side(medians.drop("n")), "category", "left").withColumn(
            c, F.when(F.col(c) > 0, F.col(c)).otherwise(F.col(f"_m_{c}"))
        )
    return out.drop("_m_unit_cost", "_m_list_price")


def clean_sku_master(raw: DataFrame, audit: AuditTrail | None = None) -> DataFrame:
    master = clean_category(with_sequence(raw), audit)
    master = clean_launch_date(clean_subcategory(master), audit)
    master = impute_money(master, audit)
    _note_duplicates(
        audit, master, ["sku_id"], "sku_master", "{n} duplicate product row(s)",
        "first occurrence kept", "a dimension must have one row per product", "critical",
    )
    return keep_first(master, ["sku_id"]).select(*MASTER)


# --------------------------------------------------------------------------- #
# Calendar
# --------------------------------------------------------------------------- #
def clean_calendar_flags(calendar: DataFrame, audit: AuditTrail | None = None) -> DataFrame:
    """CLN-C2."""
    if audit is not None:
        text = F.lower(F.trim("is_holiday"))
        audit.add(
            "calendar", "is_holiday is not a 0/1 flag in {n} row(s)", calendar,
            F.count_if(~F.coalesce(text.isin("0", "1"), F.lit(False))), "values outside 0/1",
            "fixed list of true encodings", "the flag is summed per week", "info",
        )
        audit.add(
            "calendar", "{n} date(s) without a promo event", calendar,
            F.count_if(F.col("promo_event").isNull()), "null count",
            "empty text, meaning no event", "null here means none, not unknown", "info",
        )
    return calendar.withColumns(
        {
            "is_holiday": S.parse_flag("is_holiday"),
            "promo_event": F.coalesce(F.trim("promo_event"), F.lit("")),
        }
    )


def derive_time_attributes(calendar: DataFrame) -> DataFrame:
    """CLN-C3: week, month and season come from the date, not from the export."""
    return calendar.withColumns(
        {
            "iso_year": S.iso_year("date"),
            "iso_week": S.iso_week("date"),
            "month": F.month("date"),
            "week_start": S.week_start("date"),
            "season": S.season("date"),
        }
    )


def finish_calendar(calendar: DataFrame, audit: AuditTrail | None = None) -> DataFrame:
    """CLN-C4."""
    _note_duplicates(
        audit, calendar, ["date"], "calendar", "{n} duplicate calendar date(s)",
        "first occurrence kept", "a duplicated date fans out every join", "critical",
    )
    depth = (
        S.clip(F.coalesce(S.to_number(F.col("planned_discount").cast("string")), F.lit(0.0)),
               0.0, 0.95)
        if "planned_discount" in calendar.columns
        else F.lit(0.0)
    )
    return keep_first(calendar, ["date"]).withColumn("planned_discount", depth).select(*CALENDAR)


def clean_calendar(raw: DataFrame, audit: AuditTrail | None = None) -> DataFrame:
    calendar = drop_bad_dates(with_sequence(raw), audit, "calendar")
    return finish_calendar(derive_time_attributes(clean_calendar_flags(calendar, audit)), audit)


# --------------------------------------------------------------------------- #
# Sales
# --------------------------------------------------------------------------- #
def zero_returns(sales: DataFrame, audit: AuditTrail | None = None) -> DataFrame:
    """CLN-S6: a refund is not negative demand; units and revenue become zero."""
    negative = F.col("units_sold") < 0
    if audit is not None:
        audit.add(
            "sales_daily", "{n} row(s) with negative units", sales, F.count_if(negative),
            "units_sold < 0", "units and revenue set to zero",
            "gross demand is forecast; a return does not reduce it", "warning",
        )
    return sales.withColumns(
        {
            "revenue": F.when(negative, F.lit(0.0)).otherwise(F.col("revenue")),
            "units_sold": S.clip("units_sold", low=0.0),
        }
    )


def repair_price(sales: DataFrame, master: DataFrame,
                 audit: AuditTrail | None = None) -> DataFrame:
    """CLN-S7: own revenue / units, then the SKU's median price, then list price.

    The median covers the prices as delivered.  It is worked out only for the
    SKUs that still need it, by a distributed sort, because one SKU may hold a
    large part of all rows.
    """
    missing = F.col("unit_price").isNull() | (F.col("unit_price") <= 0)
    if audit is not None:
        audit.add(
            "sales_daily", "{n} row(s) with a missing or non-positive price", sales,
            F.count_if(missing), "null or <= 0",
            "revenue / units, else SKU median, else list price",
            "the most row-specific evidence comes first", "warning",
        )
    implied = F.when(missing, S.ratio_or_null("revenue", "units_sold")).otherwise(
        F.col("unit_price")
    )
    staged = sales.withColumn("_price", F.when(implied > 0, implied))
    needy = staged.filter(F.col("_price").isNull()).select("sku_id").distinct()
    medians = exact_percentile(
        sales.join(needy, "sku_id", "left_semi"), ["sku_id"], "unit_price", 0.5, "_median"
    )
    fallback = (
        needy.join(medians.drop("n"), "sku_id", "left")
        .join(master.select("sku_id", F.col("list_price").alias("_list")), "sku_id", "left")
        .select(
            "sku_id",
            F.coalesce(F.when(F.col("_median") > 0, F.col("_median")), F.col("_list")).alias(
                "_fallback"
            ),
        )
    )
    return (
        staged.join(fallback, "sku_id", "left")
        .withColumn("unit_price", F.coalesce("_price", "_fallback"))
        .drop("_price", "_fallback")
    )


def repair_revenue(sales: DataFrame, audit: AuditTrail | None = None) -> DataFrame:
    """CLN-S8."""
    if audit is not None:
        audit.add(
            "sales_daily", "{n} row(s) with missing revenue", sales,
            F.count_if(F.col("revenue").isNull()), "null count", "units x price",
            "revenue is determined by the other two columns", "info",
        )
    return sales.withColumn(
        "revenue", F.coalesce("revenue", F.col("units_sold") * F.col("unit_price"))
    )


def clean_promo_flag(sales: DataFrame, audit: AuditTrail | None = None) -> DataFrame:
    """CLN-S9."""
    if audit is not None:
        text = F.lower(F.trim("promo_flag"))
        audit.add(
            "sales_daily", "promo_flag is not 0/1 in {n} row(s)", sales,
            F.count_if(~F.coalesce(text.isin("0", "1"), F.lit(False))), "values outside 0/1",
            "fixed list of true encodings, anything else 0",
            "inventing a promotion is worse than missing one", "warning",
        )
    return sales.withColumn("promo_flag", S.parse_flag("promo_flag"))


def drop_semantic_duplicates(sales: DataFrame, audit: AuditTrail | None = None) -> DataFrame:
    """CLN-S10: rows equal once normalised; before S11, which would add them up."""
    _note_duplicates(
        audit, sales, SALES, "sales_daily", "{n} row(s) equal in value but not in text",
        "dropped, first kept", "the same sale exported twice must not be summed", "critical",
    )
    return sales.select(*SALES).dropDuplicates()


def merge_key_collisions(sales: DataFrame, audit: AuditTrail | None = None) -> DataFrame:
    """CLN-S11: one row per SKU-day."""
    _note_duplicates(
        audit, sales, ["date", "sku_id"], "sales_daily",
        "{n} different row(s) share a (date, sku_id) key",
        "units and revenue summed, price averaged, flag maximum",
        "partial exports of one day add up to the day", "warning",
    )
    return sales.groupBy("date", "sku_id").agg(
        F.coalesce(F.sum("units_sold"), F.lit(0.0)).alias("units_sold"),
        F.coalesce(F.sum("revenue"), F.lit(0.0)).alias("revenue"),
        F.avg("unit_price").alias("unit_price"),
        F.max("promo_flag").alias("promo_flag"),
    )


def clean_sales(raw: DataFrame, master: DataFrame, audit: AuditTrail | None = None) -> DataFrame:
    sales = drop_exact_duplicates(raw, audit)
    sales = drop_bad_dates(clean_ids(sales, audit), audit)
    sales, _ = quarantine_unknown(sales, master, audit)
    sales = coerce_numeric(sales, ["units_sold", "revenue", "unit_price"])
    # Price repair reads its input several times; the typed rows are written once.
    sales = repair_price(cut(zero_returns(sales, audit)), master, audit)
    sales = clean_promo_flag(repair_revenue(sales, audit), audit)
    return merge_key_collisions(drop_semantic_duplicates(sales, audit), audit).select(*SALES)


# --------------------------------------------------------------------------- #
# Inventory
# --------------------------------------------------------------------------- #
STOCK = ["on_hand_units", "on_order_units", "lead_time_days", "reorder_point"]


def prepare_inventory(inventory: DataFrame, master: DataFrame,
                      audit: AuditTrail | None = None) -> DataFrame:
    """CLN-I1."""
    table = "inventory_snapshots"
    stock = drop_exact_duplicates(inventory, audit, table, "warning")
    stock = drop_bad_dates(stock.withColumn("sku_id", S.norm_sku("sku_id")), None, table)
    stock, _ = quarantine_unknown(stock, master, audit, table)
    return coerce_numeric(stock, STOCK)


def _carry_forward(df: DataFrame, value: str) -> DataFrame:
    """Last known ``value`` per SKU in (date, arrival) order.

    Done in two levels so that no window spans a whole SKU of unknown size: the
    carry runs inside each (SKU, month), and one row per (SKU, month) hands the
    last known value over to the next month.
    """
    month = F.date_trunc("month", F.col("date")).cast("date")
    staged = df.withColumn("_month", month)
    inside = Window.partitionBy("sku_id", "_month").orderBy("date", SEQ).rowsBetween(
        Window.unboundedPreceding, 0
    )
    carried = staged.withColumn("_in", F.last(value, ignorenulls=True).over(inside))
    closing = staged.filter(F.col(value).isNotNull()).groupBy("sku_id", "_month").agg(
        F.max_by(value, F.struct("date", SEQ)).alias("_close")
    )
    months = (
        staged.select("sku_id", "_month").distinct().join(closing, ["sku_id", "_month"], "left")
    )
    before = Window.partitionBy("sku_id").orderBy("_month").rowsBetween(
        Window.unboundedPreceding, -1
    )
    opening = months.select(
        "sku_id", "_month", F.last("_close", ignorenulls=True).over(before).alias("_open")
    )
    return (
        carried.join(opening, ["sku_id", "_month"], "left")
        .withColumn(value, F.coalesce("_in", "_open"))
        .drop("_in", "_open", "_month")
    )


def fill_on_hand(inventory: DataFrame, audit: AuditTrail | None = None) -> DataFrame:
    """CLN-I2: carry the last known position, leading gaps and negatives become 0."""
    inventory = with_sequence(inventory)
    if audit is not None:
        audit.add(
            "inventory_snapshots", "{n} snapshot(s) without on_hand_units", inventory,
            F.count_if(F.col("on_hand_units").isNull()), "null count",
            "last known position carried within the SKU, leading gaps 0",
            "a missed export does not mean empty shelves", "critical",
        )
        audit.add(
            "inventory_snapshots", "{n} snapshot(s) with negative stock", inventory,
            F.count_if(F.col("on_hand_units") < 0), "on_hand_units < 0", "set to zero",
            "physical stock cannot be negative", "warning",
        )
    filled = _carry_forward(inventory, "on_hand_units")
    zero = F.lit(0.0)
    return filled.withColumns(
        {
            "on_hand_units": F.greatest(F.coalesce("on_hand_units", zero), zero),
            "on_order_units": F.greatest(F.coalesce("on_order_units", zero), zero),
            "reorder_point": F.greatest(F.coalesce("reorder_point", zero), zero),
        }
    )


def repair_lead_time(inventory: DataFrame, low: int = DEFAULTS.lead_time_min_days,
                     high: int = DEFAULTS.lead_time_max_days,
                     audit: AuditTrail | None = None) -> DataFrame:
    """CLN-I3: implausible lead times take the SKU's, then the global, median."""
    lead = F.col("lead_time_days")
    good = lead.isNotNull() & lead.between(low, high)
    if audit is not None:
        audit.add(
            "inventory_snapshots", "{n} snapshot(s) with an impossible lead time", inventory,
            F.count_if(~good), f"outside {low}-{high} days", "SKU median, else global median",
            "the lead time sets the window of the stockout risk", "critical",
        )
    valid = inventory.filter(good)
    needy = inventory.filter(~good).select("sku_id").distinct()
    per_sku = exact_percentile(
        valid.join(needy, "sku_id", "left_semi"), ["sku_id"], "lead_time_days", 0.5, "_sku"
    )
    overall = exact_percentile(valid, [], "lead_time_days", 0.5, "_global").first()
    fallback = float(overall["_global"]) if overall else float(low)
    return (
        inventory.join(per_sku.select("sku_id", "_sku"), "sku_id", "left")
        .withColumn(
            "lead_time_days",
            F.when(good, lead).otherwise(
                S.clip(F.coalesce(F.col("_sku"), F.lit(fallback)), float(low), float(high))
            ),
        )
        .drop("_sku")
    )


def clean_inventory(raw: DataFrame, master: DataFrame, audit: AuditTrail | None = None,
                    settings: Settings = DEFAULTS) -> DataFrame:
    # Both repairs read their input several times; each input is written once.
    stock = cut(prepare_inventory(raw, master, audit))
    stock = cut(fill_on_hand(stock, audit))
    stock = repair_lead_time(
        stock, settings.lead_time_min_days, settings.lead_time_max_days, audit
    )
    _note_duplicates(
        audit, stock, ["date", "sku_id"], "inventory_snapshots",
        "{n} row(s) share a (date, sku_id) key", "last occurrence kept",
        "a repeated snapshot is a restatement", "warning",
    )
    return keep_last(stock, ["date", "sku_id"]).select(*INVENTORY)


# --------------------------------------------------------------------------- #
# Optional driver tables
# --------------------------------------------------------------------------- #
def clean_marketing(raw: DataFrame, master: DataFrame,
                    audit: AuditTrail | None = None) -> DataFrame:
    """CLN-D1."""
    table, values = "marketing_spend", MARKETING[2:]
    plan = raw.withColumns(
        {"sku_id": S.norm_sku("sku_id"), "week_start": S.week_start(S.parse_dates("week_start"))}
    ).filter(F.col("week_start").isNotNull())
    plan, _ = quarantine_unknown(plan, master, audit, table)
    plan = coerce_numeric(plan, values)
    if audit is not None:
        negative = reduce(Column.__or__, [F.coalesce(F.col(c) < 0, F.lit(False)) for c in values])
        absent = reduce(Column.__or__, [F.col(c).isNull() for c in values])
        audit.add(
            table, "{n} media row(s) with missing or negative values", plan,
            F.count_if(negative) + F.count_if(absent), "null or < 0", "set to zero",
            "no plan line means no spend; a credit note is not pressure", "info",
        )
    plan = plan.withColumns(
        {c: F.greatest(F.coalesce(F.col(c), F.lit(0.0)), F.lit(0.0)) for c in values}
    )
    _note_duplicates(
        audit, plan, MARKETING[:2], table, "{n} duplicate (week, product) media row(s)",
        "summed", "one product can be funded by several campaigns", "warning",
    )
    return plan.groupBy(*MARKETING[:2]).agg(*[F.sum(c).alias(c) for c in values])


def clean_web(raw: DataFrame, master: DataFrame, audit: AuditTrail | None = None) -> DataFrame:
    """CLN-D2."""
    table, values = "web_analytics", WEB[2:]
    web = raw.withColumns({"sku_id": S.norm_sku("sku_id"), "date": S.parse_dates("date")})
    web, _ = quarantine_unknown(web.filter(F.col("date").isNotNull()), master, None, table)
    web = web.withColumns(
        {c: F.greatest(F.coalesce(S.to_number(c), F.lit(0.0)), F.lit(0.0)) for c in values}
    )
    if audit is not None:
        audit.add(
            table, "{n} row(s) with more carts than sessions", web,
            F.count_if(F.col("add_to_cart") > F.col("sessions")), "add_to_cart > sessions",
            "capped at the sessions", "the counters come from different systems", "warning",
        )
    web = web.withColumn("add_to_cart", F.least("add_to_cart", "sessions"))
    _note_duplicates(
        audit, web, WEB[:2], table, "{n} duplicate (date, product) row(s)", "summed",
        "exports are split by device or channel", "info",
    )
    return web.groupBy(*WEB[:2]).agg(*[F.sum(c).alias(c) for c in values])


# The plausible band of a competitor price index.
COMPETITOR_BAND = (0.3, 3.0)


def clean_conditions(raw: DataFrame, audit: AuditTrail | None = None) -> DataFrame:
    """CLN-D3."""
    table = "market_conditions"
    label, _ = norm_category("category")
    frame = with_sequence(raw).withColumns(
        {
            "week_start": S.week_start(S.parse_dates("week_start")),
            "category": label,
            "competitor_price_index": S.to_number("competitor_price_index"),
            "weather_anomaly": F.coalesce(S.to_number("weather_anomaly"), F.lit(0.0)),
        }
    ).filter(F.col("week_start").isNotNull())
    inside = F.coalesce(F.col("competitor_price_index").between(*COMPETITOR_BAND), F.lit(False))
    if audit is not None:
        audit.add(
            table, "{n} implausible or missing competitor index value(s)", frame,
            F.count_if(~inside), "outside 0.3-3.0 or null", "set to parity",
            "a scrape failure is not a market move", "warning",
        )
    frame = frame.withColumn(
        "competitor_price_index",
        F.when(inside, F.col("competitor_price_index")).otherwise(F.lit(1.0)),
    )
    _note_duplicates(
        audit, frame, CONDITIONS[:2], table, "{n} duplicate (week, category) row(s)",
        "last occurrence kept", "a repeated scrape is a restatement", "info",
    )
    return keep_last(frame, CONDITIONS[:2]).select(*CONDITIONS)
