import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import Window

from stockloom.contracts import LeakageError
from stockloom.models import ensemble as E
from stockloom.operators import coldstart as C
from stockloom.operators import features as X
from stockloom.operators import hierarchy as G
from stockloom.plans import backtest as B
from stockloom.sources.retail import Retail

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def retail(spark):
    return Retail(spark, SF, "style")


@pytest.fixture(scope="module")
def panel(retail):
    return retail.panel.persist()


def test_gate_passes_and_catches_a_planted_leak(retail, panel):
    assert X.assert_no_leakage(panel, retail.weeks, [1, 4]) > 0

    def centred(p):
        w = Window.partitionBy("sku_id").orderBy("week_start").rowsBetween(-2, 2)
        return X.base_features(p).withColumn("units_roll_mean_4", F.avg("units").over(w))

    with pytest.raises(LeakageError, match="units_roll_mean_4"):
        X.assert_no_leakage(panel, retail.weeks, [1], build=centred)


def test_origins_and_split(spark):
    weeks = [dt.date(2020, 1, 6) + dt.timedelta(weeks=i) for i in range(120)]
    origins = B.select_origins(weeks, 8, 6, 4, 60)
    assert origins[-1] == weeks[111] and len(origins) == 6
    with pytest.raises(ValueError):
        B.select_origins(weeks[:60], 8, 6, 4, 60)
    df = spark.createDataFrame([(weeks[0], weeks[8]), (weeks[2], weeks[3])], "week_start date, target_week date")
    train, test = B.split_fold(df, weeks[3])
    assert train.count() == 1 and test.count() == 0


def test_tsb_matches_the_recursion(panel):
    got = E.tsb_levels(panel).toPandas().sort_values(["sku_id", "week_start"])
    want = []
    frame = panel.select("sku_id", "week_start", "units").toPandas().sort_values(["sku_id", "week_start"])
    for _, part in frame.groupby("sku_id"):
        u = part["units"].to_numpy()
        head = u[: E.SEED_WEEKS]
        z = head[head > 0].mean() if (head > 0).any() else 0.0
        p = (head > 0).mean()
        for y in u:
            if y > 0:
                z += E.TSB_ALPHA * (y - z)
                p += E.TSB_BETA * (1 - p)
            else:
                p -= E.TSB_BETA * p
            want.append(p * z)
    assert np.allclose(got["tsb_level"], want)


def test_simplex():
    grid = E.simplex()
    assert len(grid) == 66 and all(abs(sum(w) - 1) < 1e-12 for w in grid)
    assert grid == sorted(grid)


def test_nearest_donors_match_brute_force(spark):
    rng = np.random.default_rng(3)
    n = 160
    frame = pd.DataFrame({
        "sku_id": [f"s{i:03d}" for i in range(n)],
        "category": rng.choice(["a", "b", "c"], n, p=[0.8, 0.15, 0.05]),
        "subcategory": rng.choice(["x", "y"], n),
        **{c: np.round(rng.normal(size=n) * 2, 1) for c in C.SHAPE},
    })
    frame.loc[:40, list(C.SHAPE)] = 0.0  # many identical products
    frame.loc[:40, ["category", "subcategory"]] = "a", "x"
    df = spark.createDataFrame(frame)
    got = C.nearest_donors(df, df, 5).toPandas()
    v = frame[list(C.SHAPE)].to_numpy()
    for i in (0, 20, 41, 90, 150):
        d = np.sqrt(((v - v[i]) ** 2).sum(axis=1))
        d = d + (frame["subcategory"] != frame["subcategory"][i]) + 4.0 * (frame["category"] != frame["category"][i])
        order = sorted((round(x, 9), s) for x, s in zip(d, frame["sku_id"]) if s != frame["sku_id"][i])[:5]
        mine = got[got["sku_id"] == frame["sku_id"][i]].sort_values("donor_rank")
        assert mine["donor"].tolist() == [s for _, s in order]


def test_tree_reconcile_is_the_dense_solution(spark):
    skus = [("a", "C1", "S1"), ("b", "C1", "S1"), ("c", "C1", "S2"), ("d", "C2", "S3"), ("e", "C2", "S3")]
    master = spark.createDataFrame(skus, "sku_id string, category string, subcategory string")
    nodes = [r["node"] for r in G.hierarchy_edges(master).orderBy("node").collect()]
    rng = np.random.default_rng(5)
    y, scale = rng.uniform(5, 50, len(nodes)), rng.uniform(0.5, 4, len(nodes))
    day = dt.date(2020, 1, 6)
    base = spark.createDataFrame([(n, day, 1, float(v)) for n, v in zip(nodes, y)], "node string, week_start date, horizon int, prediction double")
    scales = spark.createDataFrame([(n, 1, float(s)) for n, s in zip(nodes, scale)], "node string, horizon int, scale double")
    got = {r["sku_id"]: r["reconciled"] for r in G.tree_reconcile(base, scales, master).collect()}
    S = np.array([[float(n in (s, f"SUB::{c}|{u}", f"CAT::{c}", "TOTAL")) for s, c, u in skus] for n in nodes])
    W = np.diag(1 / scale**2)
    want = np.linalg.solve(S.T @ W @ S, S.T @ W @ y)
    assert np.allclose([got[s] for s, _, _ in skus], want)


def test_intervals_are_ordered_and_weights_sum_to_one(spark):
    rng = np.random.default_rng(2)
    rows = [(("steady", "new")[i % 2], float(y), float(y + rng.normal()), float(y + 3), float(y - 2))
            for i, y in enumerate(rng.uniform(1, 20, 200))]
    df = spark.createDataFrame(rows, "regime string, y double, gbm double, tsb double, seasonal_profile double")
    weights = E.fit_blend(df, by="regime", barred=E.BARRED).collect()
    assert {r["group"] for r in weights} == {"steady", "new"}
    for r in weights:
        assert r["gbm"] + r["tsb"] + r["seasonal_profile"] == pytest.approx(1.0)
        if r["group"] == "new":
            assert r["tsb"] == 0.0


def test_nearest_donors_in_a_dense_cell(spark):
    rng = np.random.default_rng(9)
    n = 3000
    frame = pd.DataFrame({
        "sku_id": [f"s{i:04d}" for i in range(n)], "category": "a", "subcategory": np.where(np.arange(n) % 500 == 7, "rare", "x"),
        **{c: np.where(np.arange(n) < 2800, 1e-3, 1.0) * rng.normal(size=n) for c in C.SHAPE},  # nearly all in one small spot
    })
    frame.loc[5, C.SHAPE[0]] = None
    df = spark.createDataFrame(frame).withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in C.SHAPE})
    targets = df.where(F.col("sku_id").isin("s0000", "s0005", "s0007", "s1500", "s2990"))
    got = C.nearest_donors(targets, df, 12).toPandas()
    v = frame[list(C.SHAPE)].to_numpy(dtype=float)
    assert "s0005" not in set(got["sku_id"])
    for i in (0, 7, 1500, 2990):
        d = np.sqrt(((v - v[i]) ** 2).sum(axis=1)) + (frame["subcategory"] != frame["subcategory"][i])
        order = sorted((x, s) for x, s in zip(d, frame["sku_id"]) if s != frame["sku_id"][i] and not np.isnan(x))[:12]
        mine = got[got["sku_id"] == frame["sku_id"][i]].sort_values("donor_rank")
        assert mine["donor"].tolist() == [s for _, s in order]
    assert C.nearest_donors(targets, df.where("false"), 3).count() == 0
