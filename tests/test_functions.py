from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stockloom import contracts as C
from stockloom.functions import metrics as M
from stockloom.functions import scalar as S
from stockloom.operators import cleaning as K
from stockloom.operators.ranking import avg_pct_rank, exact_percentile, ordered


def one(spark, expr, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values))
    return df.select(expr.alias("x")).first()["x"]


def test_ids_labels_and_flags(spark):
    assert one(spark, S.norm_sku("a"), a="  nbl-lgt \t 004 ") == "NBL-LGT 004"
    for text in ("Décor", " DECOR ", "decor", "Ｄｅｃｏｒ"):
        assert one(spark, S.fold_label("a"), a=text) == "decor"
    assert one(spark, S.fold_label("a"), a="Storage  and Organization") == "storage & organisation"
    assert [one(spark, S.parse_flag("a"), a=t) for t in ("TRUE", " y ", "promo", "2", "")] == [1, 1, 1, 0, 0]


def test_dates_and_numbers(spark):
    read = lambda t: str(one(spark, S.parse_dates("a"), a=t))
    assert read("2021-09-04") == "2021-09-04"
    assert read("04-09-2021") == "2021-09-04"
    assert read("4/9/2021") == "2021-09-04"
    assert read("soon") == "None"
    assert one(spark, S.to_number("a"), a=" 1,234.5 ") == 1234.5
    assert one(spark, S.to_number("a"), a="12d") is None


def test_category_recovery(spark):
    rows = [("Kitchen and Dining", "NBL-KTD-001"), (None, "NBL-LGT-002"), ("toys", "X-1")]
    df = spark.createDataFrame(rows, "label string, sku string")
    label, recovered = K.norm_category("label", "sku")
    got = [tuple(r) for r in df.select(label, recovered).collect()]
    assert got == [("Kitchen & Dining", False), ("Lighting", True), ("Unclassified", False)]


def test_normal_distribution(spark):
    xs = [float(x) for x in np.linspace(-4, 4, 33)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = [r[0] for r in df.orderBy("x").select(S.norm_cdf("x")).collect()]
    want = [NormalDist().cdf(x) for x in xs]
    assert np.max(np.abs(np.array(got) - want)) < 2e-7


def test_clip_keeps_null_and_rupees(spark):
    df = spark.createDataFrame([(None,), (7.0,)], "x double")
    assert [r[0] for r in df.select(S.clip("x", 0.0, 5.0)).collect()] == [None, 5.0]
    assert one(spark, S.format_inr("a"), a=12_000_000.0) == "Rs 1.20 Cr"
    assert one(spark, S.format_inr("a"), a=-250_000.0) == "-Rs 2.50 L"


def test_metrics(spark):
    df = spark.createDataFrame([(10.0, 8.0), (0.0, 1.0), (5.0, 5.0), (None, 3.0)], "y double, p double")
    r = M.evaluate(df, "y", "p").first()
    assert r["n_observations"] == 3
    assert r["wape"] == pytest.approx(3 / 15)
    assert r["mape_coverage"] == pytest.approx(2 / 3)
    zero = spark.createDataFrame([(0.0, 1.0)], "y double, p double")
    assert zero.agg(M.wape("y", "p")).first()[0] is None


def test_contract_reports_every_problem(spark):
    rules = C.contract("t", "a:integer! b:string! c:date", "a")
    df = spark.createDataFrame([(1, None), (1, "x")], "a int, b string")
    with pytest.raises(C.ContractError) as error:
        C.validate(df, rules)
    text = "; ".join(error.value.problems)
    assert "missing column" in text and "'b'" in text and "not unique" in text


def test_ordered_and_percentiles_with_a_hot_group(spark):
    rng = np.random.default_rng(1)
    frame = pd.DataFrame({"g": rng.choice(["hot", "a", "b"], 900, p=[0.9, 0.05, 0.05]),
                          "v": rng.integers(0, 50, 900) / 4.0})
    frame["id"] = range(900)
    df = spark.createDataFrame(frame).repartition(7)
    placed = ordered(df, F.desc("v"), "id", totals={"cum": "v"}).toPandas().sort_values("position")
    want = frame.sort_values(["v", "id"], ascending=[False, True])
    assert placed["id"].tolist() == want["id"].tolist()
    assert np.allclose(placed["cum"], want["v"].cumsum())
    got = exact_percentile(df, ["g"], "v", 0.3).toPandas().set_index("g")["value"]
    for g, part in frame.groupby("g"):
        assert got[g] == pytest.approx(np.quantile(part["v"], 0.3))
    ranks = avg_pct_rank(df, "v", "g").toPandas().set_index("id")["pct_rank"]
    assert np.allclose(ranks.sort_index(), frame.groupby("g")["v"].rank(pct=True))
