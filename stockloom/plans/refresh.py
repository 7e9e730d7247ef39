"""Raw extracts to validated tables, and the published refresh (PNL-6, QRY-4)."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockloom import contracts as C
from stockloom.contracts import DEFAULTS, Settings, validate
from stockloom.models.ensemble import assign_regime
from stockloom.operators import cleaning, features, insights, panel, risk
from stockloom.operators.audit import AuditTrail
from stockloom.plans.backtest import staleness_weeks
from stockloom.session import cut
from stockloom.sources import extracts, store
from stockloom.sources.publish import Publication
from stockloom.sources.shelf import fingerprint


#: Tables that every later step reads, with the contract their written rows must keep.
CHECKED = {
    "sku_master_clean": C.CLEAN["sku_master"], "calendar": C.CLEAN["calendar"],
    "sales_clean": C.CLEAN["sales_daily"], "inventory_clean": C.CLEAN["inventory_snapshots"],
    "weekly_panel": C.WEEKLY_PANEL,
}


def _keep(check: bool) -> Callable[[str, DataFrame], DataFrame]:
    def put(name: str, df: DataFrame) -> DataFrame:
        kept = cut(df)
        return validate(kept, CHECKED[name]) if check and name in CHECKED else kept

    return put


def run_tables(spark: SparkSession, raw: dict[str, DataFrame],
               drivers: dict[str, DataFrame | None] | None = None,
               settings: Settings = DEFAULTS, check: bool = True,
               put: Callable[[str, DataFrame], DataFrame] | None = None) -> dict[str, DataFrame]:
    """PNL-6: every processed table of a run.

    The master comes first because sales and stock are checked against it.  ``put`` stores a
    table under its name and gives the stored one back, so what several outputs read is made
    once and nothing stays in memory; without it tables go to the checkpoint folder.
    """
    drivers = drivers or {}
    put = put or _keep(check)
    audit = AuditTrail()
    master = put("sku_master_clean", cleaning.clean_sku_master(raw["sku_master"], audit))
    calendar = put("calendar", cleaning.clean_calendar(raw["calendar"], audit))
    sales = put("sales_clean", cleaning.clean_sales(raw["sales_daily"], master, audit))
    stock = put("inventory_clean", cleaning.clean_inventory(raw["inventory_snapshots"], master, audit, settings))
    optional: dict[str, DataFrame | None] = {"marketing": None, "web": None, "conditions": None}
    if drivers.get("marketing_spend") is not None:
        optional["marketing"] = put("marketing_clean", cleaning.clean_marketing(drivers["marketing_spend"], master, audit))
    if drivers.get("web_analytics") is not None:
        optional["web"] = cleaning.clean_web(drivers["web_analytics"], master, audit)
    if drivers.get("market_conditions") is not None:
        optional["conditions"] = put("market_conditions_clean", cleaning.clean_conditions(drivers["market_conditions"], audit))
    span = panel.date_span(sales)
    grid = panel.daily_grid(sales, master, span, audit)
    daily = put("analysis_ready", panel.attach_dimensions(grid, calendar, optional["web"]))
    weekly = panel.weekly_panel(sales, master, panel.weekly_calendar(calendar), span, audit)
    weekly = put("weekly_panel", panel.attach_drivers(weekly, optional["marketing"], optional["conditions"], optional["web"]))
    return {
        "analysis_ready": daily,
        "weekly_panel": weekly,
        "calendar": calendar,
        "sales_clean": sales,
        "inventory_clean": stock,
        "sku_master_clean": master,
        "cleaning_report": put("cleaning_report", audit.to_df(spark)),
        "marketing_clean": optional["marketing"],
        "market_conditions_clean": optional["conditions"],
    }


def run_folder(spark: SparkSession, folder: str, settings: Settings = DEFAULTS,
               out: str | None = None) -> dict[str, DataFrame]:
    """PNL-6 from CSV extracts, written as Parquet when ``out`` is given."""
    raw = extracts.load_extracts(spark, folder)
    tables = run_tables(spark, raw, extracts.load_optional(spark, folder), settings)
    if out:
        store.write_outputs(tables, out)
    return tables


def score_plan(tables: dict[str, DataFrame], model, settings: Settings = DEFAULTS,
               name: str = "model", use_drivers: bool = False) -> dict[str, DataFrame]:
    """Forecast from the latest week and the risk table on it."""
    weekly = tables["weekly_panel"]
    base = features.base_features(weekly, use_drivers)
    origin = weekly.agg(F.max("week_start").alias("w")).first()["w"]
    weeks = panel.weekly_calendar(tables["calendar"])
    rows = features.inference_frame(
        base, weeks, origin, settings.horizons, use_drivers, tables.get("marketing_clean")
    )
    scored = model.predict(rows)
    if "regime" not in scored.columns:
        scored = assign_regime(scored)
    bounds = ("prediction", "prediction_lower", "prediction_upper")
    forecast = scored.select(
        "sku_id", "week_start", "target_week", "horizon", "category", "subcategory",
        *[F.bround(c, 2).alias(c) for c in bounds],
        F.lit(name).alias("model"), "regime",
    )
    forecast = cut(forecast)  # risk and impact read it again
    table = risk.score_risk(
        forecast, tables["inventory_clean"], tables["sku_master_clean"], settings,
        base.select("sku_id", "week_start", "weeks_since_launch", "cv_13"),
    )
    return {"forecast": forecast, "risk_table": table, "impact": insights.aggregate_impact(table)}


def _inputs(raw: dict[str, DataFrame | None]) -> str:
    """What the extracts hold, whatever files they come in."""
    prints = {n: fingerprint(df.drop("_row_seq")) for n, df in sorted(raw.items()) if df is not None}
    return json.dumps(prints, sort_keys=True)


def report(tables: dict[str, DataFrame], plan: dict[str, DataFrame], trained_to=None) -> DataFrame:
    """The readout as rows (section, item, value): money at stake, work list, cleaning, age of the model."""
    text = lambda c: F.col(c).cast("string")
    impact = plan["impact"]
    sums = impact.select(F.lit("impact").alias("section"), F.explode(F.map_from_entries(F.array(
        *[F.struct(F.lit(c), text(c)) for c in impact.columns]))).alias("item", "value"))
    actions = plan["risk_table"].groupBy("action").agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("action").alias("section"), F.col("action").alias("item"), text("n").alias("value"))
    cleaned = tables["cleaning_report"].select(F.lit("cleaning").alias("section"), F.concat_ws(": ", "table", "issue").alias("item"), text("rows_affected").alias("value"))
    out = sums.unionByName(actions).unionByName(cleaned)
    if trained_to is not None:
        age = staleness_weeks(tables["weekly_panel"], trained_to)
        out = out.unionByName(age.select(F.lit("model").alias("section"), F.lit("weeks_behind").alias("item"), text("weeks_behind").alias("value")))
    return out


def refresh(spark: SparkSession, folder: str, out: str, fit: Callable | None = None, model=None,
            load: Callable | None = None, settings: Settings = DEFAULTS) -> Publication:
    """QRY-4: from CSV extracts to a published plan.

    Extracts that hold what the current version was made from are not cleaned again: its
    processed tables are named in the new version.  The model is the one given, else one trained
    by ``fit(supervised, panel)`` and saved with the version, else the published one, read by
    ``load(spark, path)``.  Forecast, risk, impact and report are made anew and everything is
    published in one step.
    """
    publication = Publication(spark, out)
    current, stage = publication.entries(), publication.stage()
    raw, optional = extracts.load_extracts(spark, folder), extracts.load_optional(spark, folder)
    inputs = _inputs({**raw, **optional})
    names = {*store.OUTPUTS, "sales_clean"}
    same = {n: e for n, e in current.items() if n in names and e["inputs"] == inputs}
    if "weekly_panel" in same:
        stage.reuse(same)
        tables = {n: spark.read.parquet(e["path"]) for n, e in same.items()}
    else:
        tables = run_tables(spark, raw, optional, settings, put=lambda n, df: stage.put(n, df, CHECKED.get(n)))
    if model is None and fit is not None:
        weeks = panel.weekly_calendar(tables["calendar"])
        base = features.base_features(tables["weekly_panel"])
        fitted = fit(features.supervised_frame(base, weeks, settings.horizons), tables["weekly_panel"])
        if hasattr(fitted, "save"):
            fitted.save(stage.path("model"))
            stage.note("model", stage.path("model"))
        model = fitted
    elif model is None:
        if "model" not in current or load is None:
            raise ValueError("no trained model: pass one, or a fit function to retrain")
        model = load(spark, current["model"]["path"])
        stage.reuse({"model": current["model"]})
    plan = score_plan(tables, model, settings)
    written = {n: stage.put(n, df) for n, df in plan.items()}
    stage.put("report", report(tables, written, getattr(model, "trained_to", None)))
    stage.publish(inputs)
    return publication
