"""Retail extracts derived from the star-schema tables.

``lineitem`` and ``part`` become the four extracts the engine works on, in two
catalogues: ``style`` (brand x type, dense series) and ``part`` (one SKU per part,
intermittent series).  :class:`Retail` also serves the same tables *as they would
arrive*: text columns with the defects the cleaning operators exist for.
"""

from __future__ import annotations

import datetime as dt
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stockloom.contracts import CATEGORY_CODES
from stockloom.functions import scalar as S
from stockloom.operators import panel as P
from stockloom.session import cut, shuffle_partitions

# Part types stand for the six categories, in this order.
TYPE_TO_CATEGORY = {
    "ECONOMY": "Bedding & Bath",
    "LARGE": "Lighting",
    "MEDIUM": "Kitchen & Dining",
    "PROMO": "Decor",
    "SMALL": "Storage & Organisation",
    "STANDARD": "Small Appliances",
}
# Promoted ISO weeks with their published depth.
EVENTS = {3: ("New Year", 0.10), 20: ("Summer", 0.15), 32: ("Monsoon", 0.20), 44: ("Festive", 0.30)}
CALENDAR_AHEAD_DAYS = 140
PROMO_DISCOUNT = 0.08



def _case(key, mapping):
    out = None
    for k, v in mapping.items():
        out = F.when(key == k, v) if out is None else out.when(key == k, v)
    return out


def fixed(c, places: int):
    """Half-up rounding of a non-negative amount, insensitive to the last bits."""
    scale = float(10**places)
    return F.floor(S.col(c) * scale + F.lit(0.500001)) / F.lit(scale)


class Retail:
    """Extracts and derived tables of one data directory."""

    def __init__(self, spark: SparkSession, sf_dir: str, catalogue: str = "style"):
        if catalogue not in ("style", "part"):
            raise ValueError("catalogue must be 'style' or 'part'")
        self.spark, self.dir, self.by_part = spark, sf_dir.rstrip("/"), catalogue == "part"

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def span(self) -> tuple[dt.date, dt.date]:
        """First and last ship date (one column, read once for each instance)."""
        dates = self.table("lineitem").select(F.col("l_shipdate").cast("date").alias("date"))
        return P.date_span(dates)

    @property
    def products(self) -> DataFrame:
        category = _case(F.col("p_type"), TYPE_TO_CATEGORY)
        code = _case(
            F.col("p_type"), {t: CATEGORY_CODES[c] for t, c in TYPE_TO_CATEGORY.items()}
        )
        number = (
            F.lpad(F.col("p_partkey").cast("string"), 12, "0")
            if self.by_part
            else F.lpad(F.regexp_extract("p_brand", r"(\d+)", 1), 3, "0")
        )
        return self.table("part").select(
            "p_partkey",
            F.concat(F.lit("NBL-"), code, F.lit("-"), number).alias("sku_id"),
            category.alias("category"),
            F.col("p_brand").alias("subcategory"),
        )

    @property
    def lines(self) -> DataFrame:
        """One row per order line with its product; the shuffle key is the part."""
        items = self.table("lineitem").select(
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag",
            "l_discount", "l_tax",
            F.col("l_shipdate").cast("date").alias("date"),
            F.col("l_quantity").alias("units_sold"),
            F.col("l_extendedprice").alias("revenue"),
            (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"),
            (F.col("l_discount") >= PROMO_DISCOUNT).cast("int").alias("promo_flag"),
        )
        return items.join(self.products, items.l_partkey == F.col("p_partkey")).drop("p_partkey")

    @property
    def sales(self) -> DataFrame:
        """Clean sales: already typed, so only CLN-S10 and CLN-S11 apply."""
        from stockloom.operators.cleaning import (
            SALES,
            drop_semantic_duplicates,
            merge_key_collisions,
        )

        return merge_key_collisions(drop_semantic_duplicates(self.lines)).select(*SALES)

    @cached_property
    def master(self) -> DataFrame:
        """List price is the volume-weighted selling price, summed in whole cents."""
        per_sku = self.lines.groupBy("sku_id", "category", "subcategory").agg(
            F.sum(F.round(F.col("revenue") * 100).cast("long")).alias("_cents"),
            F.sum(F.col("units_sold").cast("long")).alias("_units"),
            F.min("date").alias("launch_date"),
        )
        price = fixed(F.col("_cents") / (F.col("_units") * F.lit(100.0)), 2)
        return cut(per_sku.select(  # one row per SKU, read by nearly every step
            "sku_id", "category", "subcategory", "launch_date",
            fixed(price * 0.6, 2).alias("unit_cost"), price.alias("list_price"),
        ))

    @cached_property
    def days(self) -> DataFrame:
        """Every day from the first sale to 140 days past the last: the days with sales, each with
        the days to the next one.  A few thousand rows, whatever the table."""
        sold = self.table("lineitem").select(F.col("l_shipdate").cast("date").alias("_s")).where("_s is not null").distinct()
        ahead = F.lead("_s").over(Window.orderBy("_s"))
        until = F.coalesce(F.date_sub(ahead, 1), F.date_add("_s", CALENDAR_AHEAD_DAYS))
        first = F.min("_s").over(Window.orderBy("_s").rowsBetween(Window.unboundedPreceding, 0))
        runs = sold.select("_s", first.alias("_first"), until.alias("_until"))
        every = runs.select("_first", F.explode(F.sequence("_s", "_until")).alias("_d"))
        return cut(every.select("_d", F.datediff("_d", "_first").cast("long").alias("id")))

    @property
    def calendar_raw(self) -> DataFrame:
        """Text calendar to 140 days past the last sale, with repeated dates."""
        base = self.days
        week = F.weekofyear("_d")
        day, month = F.dayofmonth("_d"), F.month("_d")
        holiday = ((month == 1) & day.isin(1, 26)) | ((month == 12) & (day == 25))
        odd = F.pmod("id", F.lit(2)) == 1
        named = base.select(
            "id",
            F.lit(0).alias("copy"),
            F.when(F.pmod("id", F.lit(5)) == 0, F.date_format("_d", "dd-MM-yyyy"))
            .otherwise(F.date_format("_d", "yyyy-MM-dd"))
            .alias("date"),
            week.cast("string").alias("week"),
            month.cast("string").alias("month"),
            F.lit("?").alias("season"),
            F.when(odd, holiday.cast("int").cast("string"))
            .otherwise(F.when(holiday, "Yes").otherwise("No"))
            .alias("is_holiday"),
            _case(week, {w: n for w, (n, _) in EVENTS.items()}).alias("promo_event"),
            _case(week, {w: str(d) for w, (_, d) in EVENTS.items()}).alias("planned_discount"),
        )
        repeated = named.filter(F.pmod("id", F.lit(29)) == 0).withColumns(
            {"copy": F.lit(1), "promo_event": F.lit("REPEATED")}
        )
        return named.unionByName(repeated).withColumn("_row_seq", F.struct("id", "copy")).drop(
            "id", "copy"
        )

    @cached_property
    def calendar(self) -> DataFrame:
        from stockloom.operators.cleaning import clean_calendar

        return clean_calendar(self.calendar_raw)

    @cached_property
    def weeks(self) -> DataFrame:
        return P.weekly_calendar(self.calendar)

    @cached_property
    def _runs(self) -> DataFrame:
        """The panel before it is unfolded, written once: a row per day with a sale, not per week."""
        runs = P.week_runs(self.sales, self.master, *self.span)
        return cut(runs.sortWithinPartitions("sku_id", "week_start"))

    def panel_since(self, since: dt.date | None) -> DataFrame:
        """The panel from the Monday ``since`` on; weeks before it are not unfolded.  A partition
        holds whole series, as the runs are dealt out by SKU before they grow."""
        runs = self._runs
        if since is not None:
            runs = runs.filter(F.greatest("week_start", "until") >= F.lit(since))
        return P.unfold_runs(runs.repartition(shuffle_partitions(self.spark), "sku_id"), self.weeks, since)

    @cached_property
    def panel(self) -> DataFrame:
        return self.panel_since(None)

    @property
    def last_week(self) -> dt.date:
        """Monday of the last complete week."""
        last = self.span[1] + dt.timedelta(days=1)
        return last - dt.timedelta(days=last.weekday() + 7)

    @property
    def week_list(self) -> list[dt.date]:
        """All complete weeks of the span; the panel has no gaps."""
        first = self.span[0]
        monday = first + dt.timedelta(days=(-first.weekday()) % 7)
        out = []
        while monday <= self.last_week:
            out.append(monday)
            monday += dt.timedelta(days=7)
        return out

    # ----------------------------------------------------------------- #
    @staticmethod
    def sku_number(sku="sku_id", category="category"):
        """A whole number per SKU that SQL can reproduce."""
        return F.regexp_extract(S.col(sku), r"(\d+)$", 1).cast("long") + F.length(
            S.col(category)
        ) * F.lit(7)

    @staticmethod
    def week_number(week="week_start"):
        return F.datediff(S.col(week), F.lit(dt.date(1990, 1, 1))).cast("long") / F.lit(7)

    @cached_property
    def inventory(self) -> DataFrame:
        """Weekly stock snapshots in proportion to recent sales; some run out."""
        return self.inventory_of(self.panel)

    def inventory_of(self, panel: DataFrame) -> DataFrame:
        w = Window.partitionBy("sku_id").orderBy("week_start").rowsBetween(-3, 0)
        no, wk = self.sku_number(), self.week_number().cast("long")
        recent = F.sum("units").over(w)
        return panel.select(
            F.col("week_start").alias("date"),
            "sku_id",
            F.floor(recent * (2 + F.pmod(7 * wk + 3 * no, F.lit(20))) / 10.0)
            .cast("double").alias("on_hand_units"),
            F.floor(recent * F.pmod(wk + no, F.lit(3)) / 4.0).cast("double").alias(
                "on_order_units"
            ),
            (F.lit(7) + F.pmod(no, F.lit(40))).cast("double").alias("lead_time_days"),
            F.floor(recent / 4.0).cast("double").alias("reorder_point"),
        )

    # ----------------------------------------------------------------- #
    # The extracts as they arrive
    # ----------------------------------------------------------------- #
    @property
    def sales_raw(self) -> DataFrame:
        """Text sales with padded ids, mixed dates, refunds, gaps and repeated rows."""
        key, line = F.col("l_orderkey"), F.col("l_linenumber")
        text = self.lines.select(
            F.when(key % 997 == 0, "not a date")
            .when(line % 4 == 1, F.date_format("date", "dd-MM-yyyy"))
            .otherwise(F.date_format("date", "yyyy-MM-dd"))
            .alias("date"),
            F.when(key % 251 == 0, F.concat(F.lit("GHOST-"), F.col("l_linenumber")))
            .when(line % 3 == 0, F.concat(F.lit(" "), F.lower("sku_id"), F.lit("  ")))
            .otherwise(F.col("sku_id"))
            .alias("sku_id"),
            F.when(
                (F.col("l_returnflag") == "R") & (key % 50 == 0),
                F.concat(F.lit("-"), F.col("units_sold").cast("long").cast("string")),
            )
            .otherwise(F.col("units_sold").cast("long").cast("string"))
            .alias("units_sold"),
            F.when(key % 67 == 3, F.lit(None))
            .when(line == 2, F.format_number("revenue", 2))
            .otherwise((F.round(F.col("revenue") * 100) / 100).cast("string"))
            .alias("revenue"),
            F.when(key % 100 == 1, F.lit(None))
            .when(key % 100 == 2, F.lit("0"))
            .otherwise((F.floor(F.col("unit_price") * 100 + 0.5) / 100).cast("string"))
            .alias("unit_price"),
            F.when(line % 3 == 0, F.col("promo_flag").cast("string"))
            .when(line % 3 == 1, F.when(F.col("promo_flag") == 1, "Y").otherwise("N"))
            .otherwise(F.when(F.col("promo_flag") == 1, "TRUE").otherwise("FALSE"))
            .alias("promo_flag"),
            F.struct(
                "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "units_sold", "revenue",
                F.lit(0).alias("copy"),
            ).alias("_row_seq"),
        )
        again = text.filter(F.col("_row_seq.l_orderkey") % 125 == 0).withColumn(
            "_row_seq", F.col("_row_seq").withField("copy", F.lit(1))
        )
        return text.unionByName(again)

    @property
    def master_raw(self) -> DataFrame:
        """Text master: spelling variants, missing categories, day-first dates, zero costs."""
        no = self.sku_number()
        m = self.master
        variant = (
            F.when(no % 6 == 0, F.lit(None).cast("string"))
            .when(no % 6 == 1, F.upper("category"))
            .when(no % 6 == 2, F.concat(F.lit(" "), F.replace("category", F.lit("e"), F.lit("é"))))
            .when(no % 6 == 3, F.replace("category", F.lit(" & "), F.lit("  and ")))
            .when(no % 6 == 4, F.replace("category", F.lit("isation"), F.lit("ization")))
            .otherwise(F.concat(F.lit("Sundry "), F.col("category")))
        )
        text = m.select(
            F.when(no % 5 == 0, F.concat(F.lower("sku_id"), F.lit(" ")))
            .when(no % 31 == 0, F.concat(F.lit("X"), F.col("sku_id")))
            .otherwise(F.col("sku_id"))
            .alias("sku_id"),
            variant.alias("category"),
            F.when(no % 9 == 0, F.lit(None).cast("string"))
            .otherwise(F.concat(F.lit(" "), F.col("subcategory")))
            .alias("subcategory"),
            F.when(no % 13 == 0, "soon")
            .when(no % 4 == 0, F.date_format("launch_date", "dd-MM-yyyy"))
            .otherwise(F.date_format("launch_date", "yyyy-MM-dd"))
            .alias("launch_date"),
            F.when(no % 8 == 0, F.lit("0")).otherwise(F.col("unit_cost").cast("string")).alias(
                "unit_cost"
            ),
            F.when(no % 10 == 0, F.lit(None).cast("string"))
            .otherwise(F.format_number("list_price", 2))
            .alias("list_price"),
            F.struct(F.lit(0).alias("copy"), no.alias("no")).alias("_row_seq"),
        )
        again = text.filter(F.col("_row_seq.no") % 3 == 0).withColumns(
            {
                "unit_cost": F.lit("1"),
                "_row_seq": F.col("_row_seq").withField("copy", F.lit(1)),
            }
        )
        return text.unionByName(again)

    @property
    def inventory_raw(self) -> DataFrame:
        """Text snapshots: gaps, negatives, impossible lead times, restatements."""
        stock = self.inventory
        wk = self.week_number("date").cast("long")
        no = F.regexp_extract("sku_id", r"(\d+)$", 1).cast("long")
        pick = wk + no
        text = stock.select(
            F.when(wk % 2 == 0, F.date_format("date", "dd-MM-yyyy"))
            .otherwise(F.date_format("date", "yyyy-MM-dd"))
            .alias("date"),
            F.when(no % 2 == 0, F.lower("sku_id")).otherwise(F.col("sku_id")).alias("sku_id"),
            F.when(pick % 7 == 0, F.lit(None))
            .when(pick % 53 == 0, F.lit("-5"))
            .otherwise(F.col("on_hand_units").cast("long").cast("string"))
            .alias("on_hand_units"),
            F.when(pick % 11 == 0, F.lit(None))
            .otherwise(F.col("on_order_units").cast("long").cast("string"))
            .alias("on_order_units"),
            F.when(pick % 17 == 0, F.lit("0"))
            .when(pick % 19 == 0, F.lit("998"))
            .otherwise(F.col("lead_time_days").cast("long").cast("string"))
            .alias("lead_time_days"),
            F.col("reorder_point").cast("long").cast("string").alias("reorder_point"),
            F.struct(F.lit(0).alias("copy"), pick.alias("pick")).alias("_row_seq"),
        )
        again = text.filter(F.col("_row_seq.pick") % 29 == 0).withColumns(
            {
                "on_hand_units": F.lit("777"),
                "_row_seq": F.col("_row_seq").withField("copy", F.lit(1)),
            }
        )
        return text.unionByName(again)

    # ----------------------------------------------------------------- #
    @property
    def marketing_raw(self) -> DataFrame:
        """Media plan text from order lines: one row per line, some negative or null."""
        key = F.col("l_orderkey")
        return self.lines.select(
            F.date_format("date", "yyyy-MM-dd").alias("week_start"),
            F.when(key % 83 == 0, F.lit("GHOST-1")).otherwise(F.lower("sku_id")).alias("sku_id"),
            F.when(key % 61 == 0, F.lit("-10"))
            .when(key % 59 == 0, F.lit(None))
            .otherwise((F.col("units_sold").cast("long") * 10).cast("string"))
            .alias("media_spend"),
            (F.col("units_sold").cast("long") * 300).cast("string").alias("impressions"),
            F.col("l_linenumber").cast("string").alias("email_sends"),
        )

    @property
    def web_raw(self) -> DataFrame:
        """Storefront text: sessions and carts per order line, carts sometimes too many."""
        return self.lines.select(
            F.date_format("date", "yyyy-MM-dd").alias("date"),
            "sku_id",
            (F.col("units_sold").cast("long") * 3).cast("string").alias("sessions"),
            F.when(F.col("l_orderkey") % 71 == 0, F.lit("500"))
            .otherwise(F.col("units_sold").cast("long").cast("string"))
            .alias("add_to_cart"),
        )

    @property
    def conditions_raw(self) -> DataFrame:
        """Weekly competitor index per category; every 17th week a scrape failure."""
        week = S.week_start("date")
        wk = self.week_number("_w").cast("long")
        per = self.lines.groupBy("category", week.alias("_w")).agg(
            F.sum(F.round(F.col("l_tax") * 100).cast("long")).alias("_tax"),
            F.count(F.lit(1)).alias("_n"),
        )
        index = F.when(wk % 17 == 0, F.lit("9.5")).otherwise(
            (F.floor(10000.0 + F.col("_tax") * 100.0 / F.col("_n") + 0.500001) / 10000.0).cast(
                "string"
            )
        )
        return per.select(
            F.date_format("_w", "yyyy-MM-dd").alias("week_start"),
            F.upper("category").alias("category"),
            index.alias("competitor_price_index"),
            F.when(wk % 5 == 0, F.lit(None))
            .otherwise(((wk % 9) - 4).cast("string"))
            .alias("weather_anomaly"),
            F.struct("category", "_w").alias("_row_seq"),
        )

