"""Runs end to end: tagged outputs, a saved model, tuning, and the published refresh."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry.core import fx, q, query, rounded, style
from registry.decisions import _FC, _risk_from
from registry.models import _TSB, Backtest
from registry.panel import H, test_rows
from registry.sql import bias_sql, wape_sql, with_sql
from stockloom.functions import metrics as M
from stockloom.models import ensemble as E
from stockloom.models import trees as T
from stockloom.operators import features as X
from stockloom.operators.lookup import union_all
from stockloom.plans import backtest as B
from stockloom.plans import refresh as RF
from stockloom.session import cut, scratch_path
from stockloom.sources import store


# --------------------------------------------------------------------------- #
# SNK-2, SNK-3
# --------------------------------------------------------------------------- #
def _tagged_sql(rows: str, tag: str) -> str:
    return f"""SELECT 'backtest_predictions' AS artifact, '{tag}' AS run_tag, count(*) AS rows, {q('sum(baseline)', 2)} AS total FROM {rows}
 UNION ALL SELECT 'metrics_by_horizon', '{tag}', count(DISTINCT horizon), {q('sum(w)', 5)} FROM (SELECT horizon, {wape_sql('y', 'baseline')} AS w FROM {rows} GROUP BY 1)
 UNION ALL SELECT 'metrics_by_category', '{tag}', count(DISTINCT category), {q('sum(w)', 5)} FROM (SELECT category, {wape_sql('y', 'baseline')} AS w FROM {rows} GROUP BY 1)"""


@query("run_tagged_backtest", with_sql("style", "test", _tagged_sql("test", "drivers") + " UNION ALL " + _tagged_sql("(SELECT * FROM test WHERE fold > 3)", "plain")))
def run_tagged_backtest(spark, d):
    """Two runs side by side; the second run of a tag, over the later folds, replaces only its own."""
    rows = cut(test_rows(style(spark, d)).select("sku_id", "week_start", "horizon", "category", "fold", "y", "baseline"))
    folder = scratch_path(spark, "artifacts")

    def artifacts(of):
        return {"backtest_predictions": of, **{f"metrics_by_{by}": of.groupBy(by).agg(M.wape("y", "baseline").alias("wape")) for by in ("horizon", "category")}}

    for tag, of in (("plain", rows), ("drivers", rows), ("plain", rows.where("fold > 3"))):
        store.write_backtest(artifacts(of), folder, tag)
    total = {"backtest_predictions": ("baseline", 2), "metrics_by_horizon": ("wape", 5), "metrics_by_category": ("wape", 5)}
    return union_all([
        store.read_run(spark, folder, name).groupBy("run_tag").agg(F.count(F.lit(1)).alias("rows"), F.sum(c).alias("_t"))
        .select(F.lit(name).alias("artifact"), "run_tag", "rows", fx("_t", n).alias("total"))
        for name, (c, n) in total.items()
    ])


# --------------------------------------------------------------------------- #
# GATE-5
# --------------------------------------------------------------------------- #
@query("serve_saved_model", with_sql("style", "test", "SELECT horizon, count(*) AS rows, count(*) AS equal_rows, 'missing feature column(s): units_lag_0, cv_13' AS refused FROM test WHERE fold = 6 GROUP BY 1"))
def serve_saved_model(spark, d):
    """A saved model scores as it did before; it refuses rows that lack what its contract names."""
    bt = Backtest(style(spark, d))
    fold = B.Fold(6, bt.origins[-1], bt.rows, bt.shelf, bt.spec)
    fitted = T.fit_linear(fold.train, bt.spec, fold.prepared())
    path = scratch_path(spark, "model")
    fitted.save(path)
    served = T.Fitted.load(spark, path)
    try:
        served.predict(fold.test.drop("cv_13", "units_lag_0"))
        refused = "nothing"
    except ValueError as error:
        refused = str(error)
    before = fitted.predict(fold.test).select(*B.KEY, F.col("prediction").alias("before"))
    both = served.predict(fold.test).join(before, B.KEY)
    return both.groupBy("horizon").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("prediction") == F.col("before")).alias("equal_rows")).withColumn("refused", F.lit(refused))


# --------------------------------------------------------------------------- #
# FC-10
# --------------------------------------------------------------------------- #
#: Smoothing constants to choose from: size, chance.
_SMOOTHING = {"slow": (0.05, 0.03), "published": (0.12, 0.06), "quick": (0.3, 0.1), "hasty": (0.6, 0.4)}


def _tsb_sql(name: str, alpha: float, beta: float) -> str:
    text = _TSB.replace("0.88", repr(1.0 - alpha)).replace("0.94", repr(1.0 - beta)).replace("0.12", repr(alpha)).replace("0.06", repr(beta))
    return text.replace("t1 AS", f"t1_{name} AS").replace("FROM t1)", f"FROM t1_{name})").replace("tsb AS", f"tsb_{name} AS")


_TUNE = ",\n ".join(_tsb_sql(n, *c) for n, c in _SMOOTHING.items()) + ",\n lg AS (" + " UNION ALL ".join(
    f"SELECT '{n}' AS candidate, fold, y, greatest(coalesce(tsb_level, units_roll_mean_4, 0), 0) AS p FROM test t LEFT JOIN tsb_{n} s ON s.sku_id = t.sku_id AND s.week_start = t.week_start"
    for n in _SMOOTHING) + f"""),
 po AS (SELECT candidate, {wape_sql('y', 'p')} AS wape, {bias_sql('y', 'p')} AS bias FROM lg GROUP BY 1),
 fw AS (SELECT candidate, fold, {wape_sql('y', 'p')} AS w FROM lg GROUP BY 1, 2),
 ld AS (SELECT fold, w AS best FROM fw WHERE candidate = (SELECT candidate FROM po ORDER BY wape, candidate LIMIT 1)),
 pr AS (SELECT candidate, count(*) AS folds, avg(w - best) AS gap, stddev_samp(w - best)/sqrt(count(*)) AS se FROM fw JOIN ld USING (fold) GROUP BY 1)"""


@query("tune_smoothing", with_sql("style", ("panel", "test"), f"SELECT row_number() OVER (ORDER BY wape, candidate)::INT AS place, candidate, {q('wape', 5)} AS wape, {q('bias + 10', 5)} AS bias_plus_10, folds, {q('gap', 5)} AS gap, {q('se', 5)} AS gap_se, gap <= coalesce(se, 0) AS within_one_se FROM po JOIN pr USING (candidate)", _TUNE))
def tune_smoothing(spark, d):
    """Four pairs of smoothing constants on six folds, compared with the best fold by fold."""
    bt = Backtest(style(spark, d))

    class Smoothed:
        def __init__(self, levels):
            self.levels = levels

        def predict(self, rows):
            return E.tsb_predict(rows, self.levels).withColumnRenamed("tsb", "prediction")

    def candidate(alpha, beta):
        return lambda fold: Smoothed(E.tsb_levels(bt.panel.where(F.col("week_start") <= F.lit(fold.origin)), alpha, beta))

    out = B.tune(bt.rows, {n: candidate(*c) for n, c in _SMOOTHING.items()}, bt.origins, shelf=bt.shelf)
    out = out.withColumn("bias_plus_10", F.col("bias_relative") + 10).drop("bias_relative")
    return rounded(out, wape=5, bias_plus_10=5, gap=5, gap_se=5)


#: Tree settings to choose from, on every fold.
TREE_GRID = {f"depth{depth}_step{int(100 * step)}": {"maxDepth": depth, "stepSize": step, "maxIter": 5} for depth in (3, 5) for step in (0.1, 0.3)}


@query("tune_trees")
def tune_trees(spark, d):
    """Four settings of the boosted trees on six folds."""
    bt = Backtest(style(spark, d))

    def candidate(name, params):
        return lambda fold: fold.model(f"tuned_{name}", lambda rows, prepared: T.fit_trees(rows, bt.spec, params, prepared=prepared))

    return B.tune(bt.rows, {n: candidate(n, p) for n, p in TREE_GRID.items()}, bt.origins, shelf=bt.shelf)


# --------------------------------------------------------------------------- #
# PNL-6, QRY-4
# --------------------------------------------------------------------------- #
class _Level:
    """The 13-week mean with one standard deviation either side, which SQL can give."""

    def predict(self, rows):
        point, spread = F.coalesce("units_roll_mean_13", F.lit(0.0)), F.coalesce("units_roll_std_13", F.lit(1.0))
        return rows.withColumns({"prediction": point, "prediction_lower": F.greatest(point - spread, F.lit(0.0)), "prediction_upper": point + spread})


def clean_csv_folder(R) -> str:
    """The extracts as CSV text, all in order, so that cleaning must leave every value as it is."""
    folder = scratch_path(R.spark, "extracts")
    calendar = R.calendar.withColumns({"week": F.weekofyear("date"), "month": F.month("date")})
    for name, df in {"sales_daily": R.sales, "sku_master": R.master, "calendar": calendar, "inventory_snapshots": R.inventory}.items():
        store.write_csv(df, f"{folder}/{name}.csv")
    return folder


_ROUNDED_FC = _FC.replace("coalesce(units_roll_mean_13, 0) AS p", "round_even(coalesce(units_roll_mean_13, 0), 2) AS p") \
    .replace("greatest(coalesce(units_roll_mean_13, 0) - coalesce(units_roll_std_13, 1), 0) AS lo", "round_even(greatest(coalesce(units_roll_mean_13, 0) - coalesce(units_roll_std_13, 1), 0), 2) AS lo") \
    .replace("coalesce(units_roll_mean_13, 0) + coalesce(units_roll_std_13, 1) AS hi", "round_even(coalesce(units_roll_mean_13, 0) + coalesce(units_roll_std_13, 1), 2) AS hi")
_PUBLISHED = """pb AS (SELECT 'weekly_panel' AS name, count(*) AS rows, sum(units) AS total, true AS kept FROM panel UNION ALL SELECT 'sku_master_clean', count(*), sum(list_price), true FROM master
 UNION ALL SELECT 'inventory_clean', count(*), sum(on_hand_units), true FROM inventory UNION ALL SELECT 'forecast', count(*), sum(p), false FROM fc UNION ALL SELECT 'risk_table', count(*), sum(round_even(rar, 2)), false FROM k2
 UNION ALL SELECT 'impact', 1, sum(round_even(lc, 2)), false FROM k2)"""


@query("refresh_publish", with_sql("style", ("panel", "feat", "inventory", "master"), f"SELECT version, name, rows, {q('total', 0)} AS total, kept AND version = 2 AS reused FROM pb CROSS JOIN (SELECT unnest([1, 2])::BIGINT AS version) v", _ROUNDED_FC + ",\n " + _risk_from("pos") + ",\n " + _PUBLISHED))
def refresh_publish(spark, d):
    """Raw CSV to a published plan, twice over the same extracts; both versions are read back."""
    R = style(spark, d)
    R.panel, R.master = cut(R.panel), cut(R.master)
    folder, out = clean_csv_folder(R), scratch_path(spark, "published")
    for _ in range(2):
        publication = RF.refresh(spark, folder, out, model=_Level())
    total = {"weekly_panel": "units", "sku_master_clean": "list_price", "inventory_clean": "on_hand_units", "forecast": "prediction",
             "risk_table": "revenue_at_risk", "impact": "locked_capital_total"}
    first = publication.entries(1)
    parts = []
    for version in (1, 2):
        entries = publication.entries(version)
        for name, column in total.items():
            facts = publication.read(name, version).agg(F.count(F.lit(1)).alias("rows"), F.sum(column).alias("_t"))
            parts.append(facts.select(F.lit(version).cast("long").alias("version"), F.lit(name).alias("name"), "rows", fx("_t", 0).alias("total"),
                                      F.lit(version > 1 and entries[name]["path"] == first[name]["path"]).alias("reused")))
    return union_all(parts)
