"""Global models on the feature table, with MLlib (FC-3..FC-8, FC-10, GATE-5)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Imputer, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockloom.contracts import DEFAULTS, Settings
from stockloom.operators.features import FeatureSpec
from stockloom.operators.lookup import POOLED
from stockloom.operators.ranking import exact_percentile
from stockloom.session import small_side

TREE_DEFAULTS = {"maxIter": 30, "maxDepth": 5, "stepSize": 0.1, "subsamplingRate": 0.85}


def _inputs(df: DataFrame, spec: FeatureSpec) -> DataFrame:
    """Numbers as doubles plus a flag where one is missing (MLlib trees need no gaps)."""
    return df.withColumns(
        {
            **{c: F.col(c).cast("double") for c in spec.numeric},
            **{f"{c}_missing": F.col(c).isNull().cast("double") for c in spec.numeric},
        }
    )


class Prepared:
    """The preprocessing of one training window, fitted once and shared by every model on it.

    Medians fill gaps, categories become numbers.  Trees see the filled numbers, a flag for each
    number that had gaps in training, and the category numbers; linear models see the filled
    numbers and one-hot categories.
    """

    def __init__(self, train: DataFrame, spec: FeatureSpec):
        counts = train.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(c).alias(c) for c in spec.numeric]).first().asDict()
        # A column without any value has no median; one without gaps needs no flag.
        self.spec = FeatureSpec(tuple(c for c in spec.numeric if counts[c]), spec.categorical)
        gaps = [c for c in self.spec.numeric if counts[c] < counts["_rows"]]
        numeric, labels = list(self.spec.numeric), list(self.spec.categorical)
        filled, index, hot = ([f"{c}_{k}" for c in names] for names, k in ((numeric, "filled"), (labels, "index"), (labels, "hot")))
        self.stages = list(
            Pipeline(stages=[
                Imputer(strategy="median", inputCols=numeric, outputCols=filled),
                StringIndexer(inputCols=labels, outputCols=index, handleInvalid="keep"),
            ]).fit(_inputs(train, self.spec)).stages
        )
        self.for_trees = [VectorAssembler(inputCols=[*filled, *[f"{c}_missing" for c in gaps], *index], outputCol="features", handleInvalid="keep")]
        one_hot = OneHotEncoder(inputCols=index, outputCols=hot)
        self.for_lines = [self._encoder(one_hot, train), VectorAssembler(inputCols=[*filled, *hot], outputCol="features", handleInvalid="keep")]

    def _encoder(self, one_hot: OneHotEncoder, train: DataFrame):
        # The encoder only reads how many categories the indexer knows, which its output states.
        return one_hot.fit(self.stages[1].transform(train.limit(1)))

    def steps(self, one_hot: bool) -> list:
        return [*self.stages, *(self.for_lines if one_hot else self.for_trees)]

    def vectors(self, df: DataFrame, one_hot: bool = False) -> DataFrame:
        """``y`` and ``features`` of every row."""
        return PipelineModel(self.steps(one_hot)).transform(_inputs(df, self.spec)).select("y", "features")


class Fitted:
    """A fitted pipeline with the feature contract it was trained on."""

    def __init__(self, model: PipelineModel, spec: FeatureSpec, trained_to=None):
        self.model, self.spec, self.trained_to = model, spec, trained_to

    def problems(self, df: DataFrame) -> list[str]:
        """What keeps this model from scoring ``df``: missing features and features of another kind."""
        kinds = dict(df.dtypes)
        missing = [c for c in self.spec.columns if c not in kinds]
        text = [c for c in self.spec.numeric if kinds.get(c) in ("string", "date", "timestamp", "binary")]
        return ([f"missing feature column(s): {', '.join(missing)}"] if missing else []) + (
            [f"feature column(s) that are not numbers: {', '.join(text)}"] if text else [])

    def predict(self, df: DataFrame) -> DataFrame:
        problems = self.problems(df)
        if problems:
            raise ValueError("; ".join(problems))
        scored = self.model.transform(_inputs(df, self.spec).withColumnRenamed("y", "_y"))
        # MLlib's own columns go; the input's columns come back as they were.
        out = scored.withColumnRenamed("_y", "y")
        keep = [F.col(f.name).cast(f.dataType) for f in df.schema.fields if f.name != "prediction"]
        return out.select(*keep, F.greatest("prediction", F.lit(0.0)).alias("prediction"))

    def save(self, path: str) -> None:
        """The model, then its contract beside it."""
        self.model.write().overwrite().save(f"{path}/model")
        rows = [(i, c, kind) for kind, names in (("numeric", self.spec.numeric), ("categorical", self.spec.categorical)) for i, c in enumerate(names)]
        contract = SparkSession.active().createDataFrame(rows, "place int, feature string, kind string")
        contract.withColumn("trained_to", F.lit(self.trained_to).cast("date")).coalesce(1).write.mode("overwrite").parquet(f"{path}/contract")

    @classmethod
    def load(cls, spark, path: str) -> "Fitted":
        """GATE-5: serve with the contract the model carries, never with one from configuration."""
        rows = spark.read.parquet(f"{path}/contract").orderBy("place").collect()  # one row a feature
        names = {k: tuple(r["feature"] for r in rows if r["kind"] == k) for k in ("numeric", "categorical")}
        spec = FeatureSpec(names["numeric"], names["categorical"])
        return cls(PipelineModel.load(f"{path}/model"), spec, rows[0]["trained_to"] if rows else None)


def _fit(train: DataFrame, spec: FeatureSpec, estimator, one_hot: bool = False, prepared: Prepared | None = None) -> Fitted:
    prepared = prepared or Prepared(train, spec)
    rows = prepared.vectors(train, one_hot).persist()
    try:
        model = estimator.fit(rows)
    finally:
        rows.unpersist()
    last = train.agg(F.max("target_week").alias("w")).first()["w"] if "target_week" in train.columns else None
    return Fitted(PipelineModel([*prepared.steps(one_hot), model]), prepared.spec, last)


def fit_trees(train: DataFrame, spec: FeatureSpec, params: dict | None = None, squared: bool = False,
              settings: Settings = DEFAULTS, prepared: Prepared | None = None) -> Fitted:
    """FC-3 (absolute error) and FC-8 (squared error)."""
    chosen = {**TREE_DEFAULTS, **(params or {})}
    trees = GBTRegressor(
        featuresCol="features", labelCol="y", lossType="squared" if squared else "absolute",
        seed=settings.random_seed, maxBins=32, **chosen,
    )
    return _fit(train, spec, trees, prepared=prepared)


def fit_linear(train: DataFrame, spec: FeatureSpec, prepared: Prepared | None = None) -> Fitted:
    """FC-6."""
    return _fit(train, spec, LinearRegression(labelCol="y", regParam=1e-6), one_hot=True, prepared=prepared)


def fit_forest(train: DataFrame, spec: FeatureSpec, trees: int = 300, depth: int = 12, leaf: int = 5,
               share: float = 1.0, settings: Settings = DEFAULTS, prepared: Prepared | None = None) -> Fitted:
    """FC-7; ``share`` of the rows is drawn for each tree."""
    forest = RandomForestRegressor(
        labelCol="y", numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf, maxBins=32,
        subsamplingRate=share, maxMemoryInMB=512, seed=settings.random_seed,
    )
    return _fit(train, spec, forest, prepared=prepared)


def feature_importance(fitted: Fitted, spark) -> DataFrame:
    """FC-5: importance per feature; the missing flag counts for its feature."""
    assembler = fitted.model.stages[-2]
    weights = fitted.model.stages[-1].featureImportances.toArray().tolist()
    totals: dict[str, float] = {}
    for name, weight in zip(assembler.getInputCols(), weights):
        for suffix in ("_filled", "_missing", "_index"):
            name = name.removesuffix(suffix)
        totals[name] = totals.get(name, 0.0) + float(weight)
    return spark.createDataFrame(list(totals.items()), "feature string, importance double")


def residual_quantiles(validation: DataFrame, groups: Sequence[str], coverage: float = 0.8,
                       least: int = 30) -> DataFrame:
    """FC-4: residual quantiles per group on held-out rows, with a pooled row.

    MLlib has no quantile loss; the interval is the point forecast plus these.
    ``validation`` has ``y``, ``prediction`` and the group columns.
    """
    tail = (1.0 - coverage) / 2.0
    key = F.concat_ws("|", *[F.col(g).cast("string") for g in groups])
    rows = validation.select(key.alias("cell"), (F.col("y") - F.col("prediction")).alias("_r"))
    out = None
    for name, level in (("low", tail), ("high", 1.0 - tail)):
        own = exact_percentile(rows, ["cell"], "_r", level, name, few_keys=True)
        pooled = exact_percentile(rows, [], "_r", level, name).select(
            F.lit(POOLED).alias("cell"), "n", name
        )
        table = own.filter(F.col("n") >= least).unionByName(pooled).drop("n")
        out = table if out is None else out.join(table, "cell")
    return out


def residual_interval(df: DataFrame, quantiles: DataFrame, groups: Sequence[str]) -> DataFrame:
    """FC-4: interval of each row, sorted so that lower <= point <= upper."""
    own = quantiles.filter(F.col("cell") != POOLED).withColumnsRenamed({"low": "_l", "high": "_h"})
    pooled = quantiles.filter(F.col("cell") == POOLED).agg(
        F.max("low").alias("_pl"), F.max("high").alias("_ph")
    )
    key = F.concat_ws("|", *[F.col(g).cast("string") for g in groups])
    out = df.withColumn("cell", key).join(small_side(own), "cell", "left").crossJoin(
        F.broadcast(pooled)  # a global aggregate is one row, also over nothing
    )
    p, zero = F.col("prediction"), F.lit(0.0)
    low = F.greatest(p + F.coalesce("_l", "_pl", zero), zero)
    high = F.greatest(p + F.coalesce("_h", "_ph", zero), zero)
    return out.withColumns(
        {"prediction_lower": F.least(low, p, high), "prediction_upper": F.greatest(low, p, high)}
    ).drop("cell", "_l", "_h", "_pl", "_ph")
