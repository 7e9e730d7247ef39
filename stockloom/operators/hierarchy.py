"""The product hierarchy and coherent forecasts (HIE-*, AGG-10/11, REC-*).

The hierarchy is a table of edges and a table of memberships, never a matrix.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockloom.contracts import DEFAULTS, DataQualityError, InsufficientHistoryError
from stockloom.functions import metrics as M
from stockloom.functions import scalar as S
from stockloom.operators.ranking import exact_percentile
from stockloom.session import cut, small_side

# Node names and the constants of the reconciliation.
TOTAL = "TOTAL"
CATEGORY = "CAT::"
SUBCATEGORY = "SUB::"
ALL = "__ALL__"
LEVELS = ("total", "category", "subcategory", "sku")
LEAST_NODE_ROWS = 8
LEAST_CORRELATION_ROWS = 30
UNKNOWN_INFLATION = 2.0
LEAST_SCALE = 1e-3
VALIDATION_SHARE = 0.35
LAMBDAS = (0.1, 0.2, 0.3, 0.4, 0.5, 0.65, 0.8, 1.0)
LEAST_COVERAGE = 0.5

ADDITIVE = ("units", "revenue", "media_spend", "impressions", "email_sends", "sessions",
            "add_to_cart")
WEIGHTED = ("list_price", "unit_cost", "promo_days", "discount_pct", "competitor_price_index",
            "weather_anomaly")


def category_node(category) -> Column:
    return F.concat(F.lit(CATEGORY), S.col(category))


def subcategory_node(category, subcategory) -> Column:
    return F.concat(F.lit(SUBCATEGORY), S.col(category), F.lit("|"), S.col(subcategory))


def hierarchy_edges(master: DataFrame, check: bool = True) -> DataFrame:
    """HIE-1: ``node, parent, level`` of every node, TOTAL's parent null."""
    if check:
        bad = master.groupBy("sku_id").agg(F.count(F.lit(1)).alias("_n")).filter(
            (F.col("_n") > 1)
            | (F.col("sku_id") == TOTAL)
            | F.col("sku_id").startswith(CATEGORY)
            | F.col("sku_id").startswith(SUBCATEGORY)
        )
        offenders = [r["sku_id"] for r in bad.orderBy("sku_id").limit(5).collect()]
        if offenders:
            raise DataQualityError(
                "duplicate sku ids or ids that collide with node names: " + ", ".join(offenders)
            )
    cat, sub = category_node("category"), subcategory_node("category", "subcategory")
    skus = master.select(F.col("sku_id").alias("node"), sub.alias("parent"),
                         F.lit("sku").alias("level"))
    subs = master.select("category", "subcategory").distinct().select(
        sub.alias("node"), cat.alias("parent"), F.lit("subcategory").alias("level")
    )
    cats = master.select("category").distinct().select(
        cat.alias("node"), F.lit(TOTAL).alias("parent"), F.lit("category").alias("level")
    )
    top = master.sparkSession.range(1).select(
        F.lit(TOTAL).alias("node"), F.lit(None).cast("string").alias("parent"),
        F.lit("total").alias("level"),
    )
    return skus.unionByName(subs).unionByName(cats).unionByName(top)


def memberships(df: DataFrame) -> DataFrame:
    """Each row once per aggregate node above it: ``node, level`` and the row's columns."""
    return df.select(
        "*",
        F.inline(
            F.array(
                F.struct(F.lit(TOTAL).alias("node"), F.lit("total").alias("level")),
                F.struct(category_node("category").alias("node"),
                         F.lit("category").alias("level")),
                F.struct(subcategory_node("category", "subcategory").alias("node"),
                         F.lit("subcategory").alias("level")),
            )
        ),
    )


def aggregate_panel(panel: DataFrame) -> DataFrame:
    """AGG-10: the weekly series of every aggregate node, in the panel's own columns.

    SKU rows are summed once to (category, subcategory, week) and rolled up from
    there with grouping sets, so the total does not re-read the SKU level.
    """
    additive = [c for c in ADDITIVE if c in panel.columns]
    weighted = [c for c in WEIGHTED if c in panel.columns]
    weight = F.greatest(F.col("units"), F.lit(0.0))
    cells = panel.groupBy("category", "subcategory", "week_start").agg(
        *[F.sum(c).alias(c) for c in additive],
        F.sum(weight).alias("_w"),
        F.count(F.lit(1)).alias("_n"),
        *[F.sum(F.col(c) * weight).alias(f"_x_{c}") for c in weighted],
        *[F.sum(c).alias(f"_p_{c}") for c in weighted],
        F.max("holiday_days").alias("holiday_days"),
        F.max("weeks_since_launch").alias("weeks_since_launch"),
        F.min("launch_date").alias("launch_date"),
        F.max("is_post_launch").alias("is_post_launch"),
    )
    key = [F.col("week_start"), F.col("category"), F.col("subcategory")]
    sets = [[F.col("week_start")], [F.col("week_start"), F.col("category")], key]
    rolled = cells.groupingSets(sets, *key).agg(
        F.grouping_id().alias("_g"),
        *[F.sum(c).alias(c) for c in additive],
        F.sum("_w").alias("_w"),
        F.sum("_n").alias("_n"),
        *[F.sum(f"_x_{c}").alias(f"_x_{c}") for c in weighted],
        *[F.sum(f"_p_{c}").alias(f"_p_{c}") for c in weighted],
        F.max("holiday_days").alias("holiday_days"),
        F.max("weeks_since_launch").alias("weeks_since_launch"),
        F.min("launch_date").alias("launch_date"),
        F.max("is_post_launch").alias("is_post_launch"),
    )
    g = F.col("_g")
    named = rolled.withColumns(
        {
            "node_level": F.when(g == 3, "total").when(g == 1, "category").otherwise(
                "subcategory"
            ),
            "sku_id": F.when(g == 3, F.lit(TOTAL))
            .when(g == 1, category_node("category"))
            .otherwise(subcategory_node("category", "subcategory")),
            **{
                c: F.coalesce(
                    F.when(F.col("_w") > 0, F.try_divide(F.col(f"_x_{c}"), F.col("_w"))),
                    F.col(f"_p_{c}") / F.col("_n"),
                )
                for c in weighted
            },
        }
    ).withColumns(
        {
            "category": F.coalesce("category", F.lit(ALL)),
            "subcategory": F.coalesce("subcategory", F.lit(ALL)),
            "avg_price": F.when(
                F.col("units") > 0, F.try_divide(F.col("revenue"), F.col("units"))
            ).otherwise(F.col("list_price")),
        }
    )
    return named.select(*panel.columns, "node_level")


def bottom_up(forecast: DataFrame, master: DataFrame, column: str = "prediction") -> DataFrame:
    """AGG-11: SKU forecasts summed to every aggregate node."""
    skus = master.select("sku_id", "category", "subcategory")
    rows = forecast.select("sku_id", "week_start", "horizon", column).join(skus, "sku_id")
    cells = rows.groupBy("category", "subcategory", "week_start", "horizon").agg(
        F.sum(column).alias(column)
    )
    return memberships(cells).groupBy("node", "level", "week_start", "horizon").agg(
        F.sum(column).alias("bottom_up")
    )


def coherence_error(values: DataFrame, edges: DataFrame) -> DataFrame:
    """HIE-2: largest gap between a node and the sum of its children.

    ``values`` has ``node, week_start, horizon, value`` for every node.
    """
    key = ["week_start", "horizon"]
    children = (
        values.join(edges.select("node", "parent"), "node")
        .groupBy(F.col("parent").alias("node"), *key)
        .agg(F.sum("value").alias("_children"))
    )
    gap = values.join(children, ["node", *key]).select(
        F.abs(F.col("value") - F.col("_children")).alias("_gap")
    )
    return gap.agg(F.coalesce(F.max("_gap"), F.lit(0.0)).alias("coherence_error"))


# --------------------------------------------------------------------------- #
# Residuals and their scales
# --------------------------------------------------------------------------- #
def harvest_residuals(supervised: DataFrame, cutoff, fit: Callable[[DataFrame], Callable],
                      least: bool = True) -> DataFrame:
    """REC-1: fit once at ``cutoff``, score every later origin out of sample.

    ``fit(train)`` returns a function from rows to rows with ``prediction``.
    """
    train = supervised.filter(F.col("target_week") <= F.lit(cutoff))
    later = supervised.filter(F.col("week_start") >= F.lit(cutoff))
    if least and (train.limit(1).count() == 0 or later.limit(1).count() == 0):
        raise InsufficientHistoryError(f"no rows on one side of {cutoff}")
    scored = fit(train)(later)
    return scored.select(
        F.col("sku_id").alias("node"), "week_start", "horizon", "target_week",
        F.col("y").alias("actual"), "prediction",
        (F.col("y") - F.col("prediction")).alias("residual"),
    )


def residual_scales(residuals: DataFrame, edges: DataFrame,
                    horizons=DEFAULTS.horizons) -> DataFrame:
    """REC-2: error scale of every node and horizon.

    A node with fewer than eight residuals takes twice the median scale of its
    level: unknown reliability must read as low reliability.
    """
    # A row per node and horizon, read by the medians and by the scales.
    own = cut(residuals.groupBy("node", "horizon").agg(
        F.count("residual").alias("observations"), F.stddev_samp("residual").alias("_own")
    ))
    grid = edges.select(
        "node", "level", F.explode(F.array(*[F.lit(int(h)) for h in horizons])).alias("horizon")
    )
    grid = grid.join(own, ["node", "horizon"], "left").withColumn(
        "observations", F.coalesce("observations", F.lit(0))
    )
    reliable = (F.col("observations") >= LEAST_NODE_ROWS) & F.col("_own").isNotNull()
    medians = exact_percentile(
        grid.filter(reliable), ["level", "horizon"], "_own", 0.5, "_median", few_keys=True
    )
    scale = F.when(reliable, F.col("_own")).otherwise(
        F.coalesce("_median", F.lit(LEAST_SCALE)) * UNKNOWN_INFLATION
    )
    return (
        grid.join(small_side(medians.drop("n")), ["level", "horizon"], "left")
        .select("node", "level", "horizon", "observations",
                F.greatest(scale, F.lit(LEAST_SCALE)).alias("scale"))
    )


def shrunk_correlation(residuals: DataFrame, scales: DataFrame) -> DataFrame:
    """REC-3: how strongly node errors move together, as a shrinkage intensity.

    The two sums over pairs of aggregate nodes need no pairs of nodes.  With T
    observations (week, horizon), the squared covariances sum to the squared products of
    pairs of observations, and the squared products of two nodes to the squares of each
    observation's sum of squares; the diagonal is taken off by sums per node.  T follows
    the weeks of the holdout: each node is one series of length T, the matrix that the driver
    gets is T x T, and the number of nodes is free.  Only observations at which
    every reliable node reports count.  Returns one row: nodes, observations, intensity.
    """
    reliable = (
        scales.filter(F.col("level") != "sku")
        .groupBy("node")
        .agg(F.min("observations").alias("_least"))
        .filter(F.col("_least") >= LEAST_NODE_ROWS)
        .select("node")
    )
    reliable = cut(reliable)
    nodes = reliable.count()
    scaled = (
        residuals.join(small_side(reliable), "node")
        .join(scales.select("node", "horizon", "scale"), ["node", "horizon"])
        .select("node", "week_start", "horizon", (F.col("residual") / F.col("scale")).alias("x"))
    )
    complete = scaled.groupBy("week_start", "horizon").agg(
        F.count(F.lit(1)).alias("_n")
    ).filter(F.col("_n") == nodes)
    rows = scaled.join(small_side(complete.drop("_n")), ["week_start", "horizon"])
    stats = rows.groupBy("node").agg(
        F.avg("x").alias("_m"), F.stddev_samp("x").alias("_s"), F.count(F.lit(1)).alias("_t")
    )
    z = rows.join(small_side(stats), "node").select(
        "node", "week_start", "horizon", "_t",
        ((F.col("x") - F.col("_m")) / F.greatest(F.col("_s"), F.lit(LEAST_SCALE))).alias("z"),
    )
    z = cut(z)
    # sum over i, j of (sum_t z_ti z_tj)^2 is the sum over t, s of (sum_i z_ti z_si)^2: the squares
    # of the T x T Gram matrix of the nodes' series, added up partition by partition.
    series = z.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("week_start", "horizon", "z"))).alias("_s"))
    vectors = series.select(array_to_vector(F.transform("_s", lambda x: x["z"])).alias("v"))
    if nodes and not z.isEmpty():
        gram = RowMatrix(MLUtils.convertVectorColumnsFromML(vectors, "v")).computeGramianMatrix().toArray()
    else:
        gram = np.zeros((1, 1))
    c_all, q_all = float((gram**2).sum()), float((gram.diagonal() ** 2).sum())
    square = F.col("z") * F.col("z")
    single = z.groupBy("node").agg(
        F.sum(square).alias("_c"), F.sum(square * square).alias("_q"), F.max("_t").alias("_t")
    ).agg(
        F.coalesce(F.sum(F.col("_c") * F.col("_c")), F.lit(0.0)).alias("_c_own"),
        F.coalesce(F.sum("_q"), F.lit(0.0)).alias("_q_own"), F.max("_t").alias("_t"),
    )
    t = F.col("_t")
    c2, q1 = F.lit(c_all) - F.col("_c_own"), F.lit(q_all) - F.col("_q_own")
    variance = t / F.pow(t - 1, F.lit(3)) * (q1 - c2 / t)
    corr = c2 / F.pow(t - 1, F.lit(2))
    raw = F.when(corr > 0, S.clip(variance / corr, 0.0, 1.0)).otherwise(1.0)
    enough = F.coalesce(t, F.lit(0)) >= LEAST_CORRELATION_ROWS
    return single.select(
        F.lit(nodes).alias("nodes"), F.coalesce(t, F.lit(0)).alias("observations"),
        F.when(enough, raw).otherwise(1.0).alias("intensity"),
    )


# --------------------------------------------------------------------------- #
# Reconciliation
# --------------------------------------------------------------------------- #
def tree_reconcile(base: DataFrame, scales: DataFrame, master: DataFrame) -> DataFrame:
    """REC-4: minimum-variance coherent forecasts on the tree.

    With a diagonal error covariance the projection has an exact two-pass form.
    Upwards, a node merges its own forecast with the sum of its children,
    ``v = 1/(1/w + 1/sum v)`` and ``m = v (y/w + sum m / sum v)``.  Downwards,
    a child takes its share of the parent's adjustment.  Each level is one
    aggregation and one join, linear in the nodes.

    ``base`` has ``node, week_start, horizon, prediction`` for SKUs and, where
    available, aggregates.  Returns ``sku_id, week_start, horizon, reconciled``.
    """
    key = ["week_start", "horizon"]
    var = scales.select("node", "horizon", F.pow("scale", F.lit(2.0)).alias("_w"))
    own = base.join(var, ["node", "horizon"]).select(
        "node", *key, F.col("prediction").alias("y"), "_w"
    )
    skus = master.select(
        F.col("sku_id").alias("node"), category_node("category").alias("_cat"),
        subcategory_node("category", "subcategory").alias("_sub"),
    )
    leaves = own.join(skus, "node").select(
        F.col("node").alias("sku_id"), "_cat", "_sub", *key,
        F.col("y").alias("_m"), F.col("_w").alias("_v"),
    )

    def merge(children: DataFrame, node: str, keep: list[str]) -> DataFrame:
        sums = children.groupBy(node, *keep, *key).agg(
            F.sum("_m").alias("_sm"), F.sum("_v").alias("_sv")
        )
        joined = sums.join(
            own.select(F.col("node").alias(node), *key, "y", F.col("_w").alias("_own")),
            [node, *key], "left",
        )
        # A node without its own forecast adds nothing: its variance is infinite.
        precision = F.coalesce(F.lit(1.0) / F.col("_own"), F.lit(0.0))
        v = F.lit(1.0) / (precision + F.lit(1.0) / F.col("_sv"))
        m = v * (F.coalesce(F.col("y") * precision, F.lit(0.0)) + F.col("_sm") / F.col("_sv"))
        return joined.select(node, *keep, *key, "_sm", "_sv", m.alias("_m"), v.alias("_v"))

    subs = merge(leaves, "_sub", ["_cat"])
    cats = merge(subs, "_cat", [])
    top = merge(cats.withColumn("_top", F.lit(TOTAL)), "_top", [])

    def share(children: DataFrame, parent: DataFrame, on: list[str]) -> DataFrame:
        above = parent.select(
            *on, *key, F.col("_f").alias("_pf"), F.col("_sm").alias("_psm"),
            F.col("_sv").alias("_psv"),
        )
        gain = F.col("_v") / F.col("_psv") * (F.col("_pf") - F.col("_psm"))
        return children.join(above, [*on, *key]).withColumn("_f", F.col("_m") + gain).drop(
            "_pf", "_psm", "_psv"
        )

    top = top.withColumn("_f", F.col("_m"))
    cats = share(cats.withColumn("_top", F.lit(TOTAL)), top, ["_top"])
    subs = share(subs, cats, ["_cat"])
    leaves = share(leaves, subs, ["_sub"])
    return leaves.select("sku_id", *key, F.col("_f").alias("reconciled"))


def aggregate_advantage(direct: DataFrame, summed: DataFrame) -> DataFrame:
    """REC-5: do direct aggregate forecasts beat the summed SKU forecasts?

    ``direct`` has ``node, week_start, horizon, actual, prediction``; ``summed`` is
    :func:`bottom_up`.
    """
    joined = direct.join(summed, ["node", "week_start", "horizon"], "left")
    sums = joined.agg(
        F.sum(F.abs(F.col("actual") - F.col("prediction"))).alias("direct_error"),
        F.sum(F.abs(F.col("actual") - F.coalesce("bottom_up", F.lit(0.0)))).alias(
            "bottom_up_error"
        ),
        F.sum(F.abs("actual")).alias("_total"),
    )
    gain = F.when(
        (F.col("_total") > 0) & (F.col("bottom_up_error") > 0),
        F.try_divide(F.col("bottom_up_error") - F.col("direct_error"), F.col("bottom_up_error")),
    )
    return sums.select("direct_error", "bottom_up_error", gain.alias("advantage"))


def blend_scores(validation: DataFrame, lambdas=LAMBDAS) -> DataFrame:
    """REC-6: error of every blend of bottom-up and reconciled forecasts.

    ``validation`` has ``actual, prediction, reconciled`` per SKU row; the grid has
    nine values, so each row becomes nine error terms in an array rather than nine rows.
    """
    grid = [0.0, *lambdas]
    base = F.abs(F.greatest(F.col("prediction"), F.lit(0.0)) - F.col("actual"))
    cols = []
    for i, lam in enumerate(grid):
        mixed = F.greatest(
            F.lit(1.0 - lam) * F.col("prediction") + F.lit(lam) * F.col("reconciled"), F.lit(0.0)
        )
        err = F.abs(mixed - F.col("actual"))
        cols += [F.sum(err).alias(f"e{i}"), F.stddev_samp(err - base).alias(f"s{i}")]
    sums = validation.agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.abs("actual")).alias("total"), *cols
    )
    rows = F.array(
        *[
            F.struct(F.lit(lam).alias("lambda"), F.col(f"e{i}").alias("_e"),
                     F.col(f"s{i}").alias("_s"))
            for i, lam in enumerate(grid)
        ]
    )
    return sums.select("n", "total", F.inline(rows)).select(
        "lambda",
        S.ratio_or_null("_e", "total").alias("wape"),
        (F.coalesce("_s", F.lit(0.0)) / F.sqrt("n") * F.col("n") / F.col("total")).alias(
            "standard_error"
        ),
    )


def choose_blend(scores: DataFrame, advantage: DataFrame) -> DataFrame:
    """REC-6: how far to trust the reconciled forecasts, as one row.

    ``scores`` is :func:`blend_scores` and ``advantage`` is :func:`aggregate_advantage`.  The gate
    declines, and the strength is 0, when direct aggregate forecasts do not beat the sum of the
    SKU forecasts.  Otherwise the smallest strength counts whose WAPE lies within one standard
    error (of the paired errors against no blending) of the best.  Without any actuals there is
    nothing to choose by and the strength is 0.
    """
    best = F.min_by(F.struct("lambda", "wape", "standard_error"), F.struct("wape", "lambda"))
    facts = scores.agg(best.alias("_b"), F.max(F.when(F.col("lambda") == 0.0, F.col("wape"))).alias("base_wape"),
                       F.collect_list(F.struct("lambda", "wape")).alias("_all"))  # nine rows
    limit = F.when(F.col("_b.lambda") == 0.0, F.col("_b.wape")).otherwise(F.col("_b.wape") + F.col("_b.standard_error"))
    near = F.filter("_all", lambda x: x["wape"] <= F.col("tolerance"))
    declined = F.col("advantage").isNotNull() & (F.col("advantage") <= 0.0)
    out = facts.crossJoin(F.broadcast(advantage.select("advantage"))).withColumn("tolerance", limit)  # one row each
    pick = F.when(declined, 0.0).otherwise(F.coalesce(F.array_min(F.transform(near, lambda x: x["lambda"])), F.lit(0.0)))
    out = out.withColumn("strength", F.when(F.col("_b.lambda") == 0.0, 0.0).otherwise(pick))
    chosen = F.get(F.filter("_all", lambda x: x["lambda"] == F.col("strength")), F.lit(0))
    return out.select(
        F.when(declined, "declined").otherwise("passed").alias("gate"), "advantage", "base_wape", F.col("_b.lambda").alias("best_lambda"),
        F.col("_b.wape").alias("best_wape"), "tolerance", "strength", chosen["wape"].alias("wape"),
    )


def check_bottom(bottom: DataFrame, master: DataFrame) -> None:
    """REC-7 guards: unknown SKUs, duplicates and coverage below half are errors."""
    unknown = bottom.join(master.select("sku_id"), "sku_id", "left_anti").limit(1).count()
    if unknown:
        raise InsufficientHistoryError("forecasts for SKUs absent from the hierarchy")
    per = bottom.groupBy("week_start", "horizon", "sku_id").agg(F.count(F.lit(1)).alias("_n"))
    origin = per.groupBy("week_start", "horizon").agg(
        F.max("_n").alias("_most"), F.count(F.lit(1)).alias("_skus")
    )
    size = master.count()
    worst = origin.agg(F.max("_most").alias("most"), F.min("_skus").alias("least")).first()
    if worst["most"] and worst["most"] > 1:
        raise InsufficientHistoryError("more than one forecast for the same SKU and horizon")
    if worst["least"] and worst["least"] / size < LEAST_COVERAGE:
        raise InsufficientHistoryError(
            f"an origin covers only {worst['least']} of {size} SKUs"
        )


def reconcile(bottom: DataFrame, aggregates: DataFrame | None, scales: DataFrame,
              master: DataFrame, strength: float, column: str = "prediction",
              check: bool = True) -> DataFrame:
    """REC-7: blend bottom-up and tree-reconciled forecasts.

    SKUs absent at an origin are not launched: they neither receive nor contribute.
    """
    if check:
        check_bottom(bottom, master)
    if strength <= 0.0:
        fixed = F.greatest(F.col(column), F.lit(0.0))
        return bottom.withColumn("reconciled", fixed).withColumn(
            "adjustment", F.col("reconciled") - F.col(column)
        )
    key = ["week_start", "horizon"]
    base = bottom.select(F.col("sku_id").alias("node"), *key, F.col(column).alias("prediction"))
    if aggregates is not None:
        base = base.unionByName(aggregates.select("node", *key, "prediction"))
    tree = tree_reconcile(base, scales, master)
    mixed = F.greatest(
        F.lit(1.0 - strength) * F.col(column) + F.lit(strength) * F.col("_tree"), F.lit(0.0)
    )
    return (
        bottom.join(tree.withColumnRenamed("reconciled", "_tree"), ["sku_id", *key], "left")
        .withColumn("reconciled", mixed)
        .drop("_tree")
        .withColumn("adjustment", F.col("reconciled") - F.col(column))
    )


def wape_by_level(rows: DataFrame, models) -> DataFrame:
    """REC-8: accuracy per hierarchy level for several forecasts side by side."""
    return rows.groupBy("level").agg(
        F.count(F.lit(1)).alias("rows"), *[M.wape("actual", m).alias(f"{m}_wape") for m in models]
    )
