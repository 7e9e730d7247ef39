"""From clean sales to the dense weekly panel (PNL-*).

The panel needs a row for every SKU and week, priced with the *offered* price of
each day (carried from the last sale).  Building every SKU-day first would cost
seven times the rows, so sales are turned into **price segments**: each sale opens
a segment that lasts until the day before the next one.  Segments become runs of
weeks that read alike and these unfold into weeks, or, where the daily table itself is
wanted, they explode into days.  Both need one shuffle on ``sku_id`` and no join with a grid.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockloom.contracts import DataQualityError
from stockloom.functions import scalar as S
from stockloom.operators.audit import AuditTrail
from stockloom.session import shuffle_partitions, small_side

WEEK_DAYS = 7
ATTRIBUTES = ["category", "subcategory", "unit_cost", "list_price", "launch_date"]
PANEL = [
    "sku_id", "week_start", "units", "revenue", "avg_price", "promo_days", "holiday_days",
    *ATTRIBUTES, "weeks_since_launch", "is_post_launch",
]
# What an absent driver reads as.
DRIVER_DEFAULTS = {
    "media_spend": 0.0,
    "impressions": 0.0,
    "email_sends": 0.0,
    "sessions": 0.0,
    "add_to_cart": 0.0,
    "discount_pct": 0.0,
    "competitor_price_index": 1.0,
    "weather_anomaly": 0.0,
}


def date_span(sales: DataFrame, column: str = "date") -> tuple[dt.date, dt.date]:
    """First and last day of the extract (two values on the driver)."""
    row = sales.agg(F.min(column).alias("a"), F.max(column).alias("b")).first()
    if row["a"] is None:
        raise DataQualityError("no sales are left after cleaning")
    return row["a"], row["b"]


def price_segments(sales: DataFrame, master: DataFrame, first: dt.date,
                   last: dt.date) -> DataFrame:
    """One row per sale (or per unsold SKU) with the days its price was on offer."""
    alive = master.withColumn("_start", F.greatest(F.lit(first), F.col("launch_date"))).filter(
        F.col("_start") <= F.lit(last)
    )
    sold = sales.select(
        F.col("sku_id").alias("_sku"), "date", "units_sold", "revenue", "unit_price", "promo_flag"
    )
    # Each sale opens a segment that grows into many rows below, so the partition count
    # is fixed here and the join keeps it (a merge join); AQE would otherwise merge
    # partitions by their size before the growth.  The windows reuse the same exchange.
    sold = sold.repartition(shuffle_partitions(sales.sparkSession), "_sku")
    joined = alive.hint("merge").join(
        sold, (F.col("sku_id") == F.col("_sku")) & (F.col("date") >= F.col("_start")), "left"
    ).drop("_sku")
    w = Window.partitionBy("sku_id").orderBy("date")
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(
        0, Window.unboundedFollowing
    )
    return (
        joined.withColumns(
            {
                "seg_from": F.when(F.row_number().over(w) == 1, F.col("_start")).otherwise(
                    F.col("date")
                ),
                "seg_to": F.coalesce(F.date_sub(F.lead("date").over(w), 1), F.lit(last)),
                "offered_price": F.coalesce(
                    F.last("unit_price", ignorenulls=True).over(back),
                    F.first("unit_price", ignorenulls=True).over(ahead),
                    F.col("list_price"),
                ),
            }
        )
        .drop("_start")
    )


def daily_grid(sales: DataFrame, master: DataFrame, span: tuple[dt.date, dt.date] | None = None,
               audit: AuditTrail | None = None) -> DataFrame:
    """PNL-1 and PNL-2: every SKU-day since launch, zero-filled, with the offered price."""
    first, last = span or date_span(sales)
    segments = price_segments(sales, master, first, last)
    days = segments.withColumn(
        "_day", F.explode(F.sequence("seg_from", "seg_to", F.expr("interval 1 day")))
    )
    sold = F.coalesce(F.col("_day") == F.col("date"), F.lit(False))
    grid = days.select(
        F.col("_day").alias("date"),
        "sku_id",
        F.when(sold, F.col("units_sold")).otherwise(F.lit(0.0)).alias("units_sold"),
        F.when(sold, F.col("revenue")).otherwise(F.lit(0.0)).alias("revenue"),
        F.col("offered_price").alias("unit_price"),
        F.when(sold, F.col("promo_flag")).otherwise(F.lit(0)).alias("promo_flag"),
        *ATTRIBUTES,
        (~sold).cast("int").alias("_filled"),
    )
    if audit is not None:
        audit.add(
            "sales_daily", "{n} SKU-day(s) absent from the extract", grid, F.sum("_filled"),
            "days of a SKU's life without a sale", "zero-demand rows",
            "lags and averages count positions in time", "critical",
        )
    return grid.drop("_filled")


def attach_dimensions(grid: DataFrame, calendar: DataFrame, web: DataFrame | None = None,
                      check: bool = True) -> DataFrame:
    """PNL-3: calendar attributes of each day (product attributes already ride along).

    The calendar has one row per day of history, so it is broadcast after a size
    check.  A date missing from it is an error.
    """
    dates = small_side(
        calendar.select("date", "week_start", "is_holiday", "promo_event", "season")
    )
    if check:
        orphans = grid.select("date").distinct().join(dates, "date", "left_anti").count()
        if orphans:
            raise DataQualityError(f"{orphans} date(s) of the sales history lack a calendar row")
    daily = grid.join(dates, "date", "left")
    if web is not None:
        daily = daily.join(web, ["sku_id", "date"], "left").fillna(
            0.0, ["sessions", "add_to_cart"]
        )
    if "discount_pct" not in daily.columns:
        daily = daily.withColumn("discount_pct", F.lit(0.0))
    return daily


def weekly_from_daily(daily: DataFrame) -> DataFrame:
    """PNL-4 over a daily table: the form to use when that table exists anyway."""
    extras = []
    if "discount_pct" in daily.columns:
        extras.append(F.avg("discount_pct").alias("discount_pct"))
    if "sessions" in daily.columns:
        extras += [F.sum("sessions").alias("sessions"), F.sum("add_to_cart").alias("add_to_cart")]
    weekly = daily.groupBy("sku_id", "week_start", *ATTRIBUTES).agg(
        F.sum("units_sold").alias("units"),
        F.sum("revenue").alias("revenue"),
        F.avg("unit_price").alias("avg_price"),
        F.sum("promo_flag").cast("double").alias("promo_days"),
        F.sum("is_holiday").cast("double").alias("holiday_days"),
        F.count(F.lit(1)).alias("_days"),
        *extras,
    )
    return _with_age(weekly.filter(F.col("_days") == WEEK_DAYS).drop("_days"))


def _with_age(weekly: DataFrame) -> DataFrame:
    age, launched = S.launch_age("week_start", "launch_date")
    return weekly.withColumns({"weeks_since_launch": age, "is_post_launch": launched})


def week_runs(sales: DataFrame, master: DataFrame, first: dt.date, last: dt.date) -> DataFrame:
    """The weekly panel with the weeks that sell nothing folded up.

    Only a week with a sale, and the weeks at the two ends of a price segment, can hold more than
    one segment; these are added up, one row each.  All weeks between lie within one segment and
    sell nothing, so the row before them names the last one (``until``) and their price.  That is
    about as many rows as there are days with a sale, whatever the length of history.
    """
    monday = S.week_start
    segments = price_segments(sales, master, first, last)
    # Ahead of its first sale a segment may reach back to the launch: cut it before the sale's week.
    split = F.coalesce(monday("date") > monday("seg_from"), F.lit(False))
    kinds = {"units_sold": F.lit(0.0), "revenue": F.lit(0.0), "promo_flag": F.lit(0)}
    bought = F.col("date").isNotNull()
    sold = [F.when(bought, F.col(c)).otherwise(z).alias(c) for c, z in kinds.items()]
    unsold = [z.alias(c) for c, z in kinds.items()]
    whole = F.array(F.struct(F.col("seg_from").alias("a"), F.col("seg_to").alias("b"), *sold))
    halves = F.array(
        F.struct(F.col("seg_from").alias("a"), F.date_sub(monday("date"), 1).alias("b"), *unsold),
        F.struct(monday("date").alias("a"), F.col("seg_to").alias("b"), *sold),
    )
    pieces = segments.select(
        "sku_id", *ATTRIBUTES, "offered_price", F.explode(F.when(split, halves).otherwise(whole)).alias("_p")
    ).select("sku_id", *ATTRIBUTES, "offered_price", "_p.*", monday("_p.a").alias("_wa"), monday("_p.b").alias("_wb"))

    def cell(week: str, days: Column, until: Column, values: list) -> Column:
        return F.struct(F.col(week).alias("week_start"), days.alias("_days"), until.alias("until"), *values)

    apart = F.datediff("_wb", "_wa")
    between = F.when(apart >= 2 * WEEK_DAYS, F.date_sub("_wb", 7))
    head = cell("_wa", F.datediff(F.least("b", F.date_add("_wa", 6)), "a") + 1, between, list(kinds))
    tail = cell("_wb", F.datediff("b", "_wb") + 1, F.lit(None).cast("date"), unsold)
    cells = pieces.select(
        "sku_id", *ATTRIBUTES, "offered_price",
        F.explode(F.when(apart > 0, F.array(head, tail)).otherwise(F.array(head))).alias("_c"),
    ).select("sku_id", *ATTRIBUTES, "offered_price", "_c.*")
    return cells.groupBy("sku_id", "week_start", *ATTRIBUTES).agg(
        F.sum("units_sold").alias("units"),
        F.sum("revenue").alias("revenue"),
        (F.sum(F.col("offered_price") * F.col("_days")) / F.sum("_days")).alias("avg_price"),
        F.sum("promo_flag").cast("double").alias("promo_days"),
        F.sum("_days").alias("_days"),
        F.max("until").alias("until"),
        F.max(F.when(F.col("until").isNotNull(), F.col("offered_price"))).alias("_then"),
    )


def unfold_runs(runs: DataFrame, week_dim: DataFrame, since: dt.date | None = None) -> DataFrame:
    """One row for every whole week of :func:`week_runs`, from the Monday ``since`` on."""
    one, after = F.expr("interval 7 day"), F.date_add("week_start", 7)
    at_hand = F.col("_days") == WEEK_DAYS
    follow = F.col("until")
    if since is not None:
        at_hand = at_hand & (F.col("week_start") >= F.lit(since))
        after = F.greatest(after, F.lit(since))
        follow = F.when(F.col("until") >= F.lit(since), F.col("until"))
    none = F.array().cast("array<date>")
    weeks = F.concat(
        F.when(at_hand, F.array("week_start")).otherwise(none),
        F.when(follow.isNotNull(), F.sequence(after, follow, one)).otherwise(none),
    )
    own = F.col("_w") == F.col("week_start")
    full = runs.withColumn("_w", F.explode(weeks)).select(
        "sku_id", F.col("_w").alias("week_start"), *ATTRIBUTES,
        *[F.when(own, F.col(c)).otherwise(F.lit(0.0)).alias(c) for c in ("units", "revenue", "promo_days")],
        F.when(own, F.col("avg_price")).otherwise(F.col("_then") * WEEK_DAYS / F.lit(WEEK_DAYS)).alias("avg_price"),
    )
    holidays = small_side(week_dim.select("week_start", "holiday_days"))
    return _with_age(full.join(holidays, "week_start", "left")).select(*PANEL)


def weekly_panel(sales: DataFrame, master: DataFrame, week_dim: DataFrame,
                 span: tuple[dt.date, dt.date] | None = None,
                 audit: AuditTrail | None = None) -> DataFrame:
    """PNL-4: the weekly panel, straight from price segments."""
    first, last = span or date_span(sales)
    runs = week_runs(sales, master, first, last)
    if audit is not None:
        audit.add(
            "weekly_panel", "{n} SKU-week(s) cover fewer than seven days", runs,
            F.count_if(F.col("_days") < WEEK_DAYS), "days per SKU-week", "dropped",
            "a part-week reads as a demand collapse", "warning",
        )
    return unfold_runs(runs, week_dim)


def attach_drivers(panel: DataFrame, marketing: DataFrame | None = None,
                   conditions: DataFrame | None = None,
                   web: DataFrame | None = None) -> DataFrame:
    """PNL-5: optional driver tables; an absent one reads as neutral.

    Driver tables are one row per key after cleaning, so the grain cannot change.
    Market conditions are keyed by the category vocabulary and the week.
    """
    out = panel
    if marketing is not None:
        out = out.join(marketing, ["sku_id", "week_start"], "left")
    if conditions is not None:
        out = out.join(small_side(conditions), ["category", "week_start"], "left")
    if web is not None:
        weekly = web.groupBy("sku_id", S.week_start("date").alias("week_start")).agg(
            F.sum("sessions").alias("sessions"), F.sum("add_to_cart").alias("add_to_cart")
        )
        out = out.join(weekly, ["sku_id", "week_start"], "left")
    return out.withColumns(
        {
            c: (F.coalesce(F.col(c), F.lit(d)) if c in out.columns else F.lit(d))
            for c, d in DRIVER_DEFAULTS.items()
        }
    )


def weekly_calendar(calendar: DataFrame) -> DataFrame:
    """PNL-7: one row per week, including weeks after the sales history."""
    return (
        calendar.groupBy("week_start")
        .agg(
            F.min_by("iso_week", "date").alias("iso_week"),
            F.min_by("month", "date").alias("month"),
            F.sum("is_holiday").cast("double").alias("holiday_days"),
            F.count_if(F.col("promo_event") != "").alias("promo_event_days"),
            F.count("date").alias("days_in_week"),
            F.coalesce(F.max("planned_discount"), F.lit(0.0)).alias("planned_discount"),
        )
        .withColumns(
            {
                "has_promo_event": (F.col("promo_event_days") > 0).cast("int"),
                "week_sin": S.week_sin("iso_week"),
                "week_cos": S.week_cos("iso_week"),
            }
        )
    )


def gap_report(panel: DataFrame) -> DataFrame:
    """SKUs whose weekly series has a hole: lags are positional and must not meet one."""
    return (
        panel.groupBy("sku_id")
        .agg(
            F.count(F.lit(1)).alias("weeks"),
            (F.datediff(F.max("week_start"), F.min("week_start")) / 7 + 1)
            .cast("long")
            .alias("expected"),
        )
        .filter("weeks <> expected")
    )
