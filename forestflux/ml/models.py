"""Features, splits, models, evaluation and inference. Boosted trees are pyspark.ml's, not bit-equal to other libraries'."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import bias, mae, r2
from ..operators.filters import complete_rows
from ..sources.catalog import exists

# The features of the models, in order.
FEATURES = [
    "SR_B1", "SR_B2", "SR_B3", "SR_B4", "SR_B5", "SR_B7", "NDVI", "NDII", "NIR_V", *[f"BIO{i:02d}" for i in range(1, 20)], "prec", "srad", "tavg", "tmax", "tmin", "vapr", "wind", "elev", "slope", "aspect",
]
LABEL = "biomass"


def feature_rows(df: DataFrame, features: list[str] = FEATURES, label: str | None = LABEL) -> DataFrame:
    """Asserts that features exist (NIR_V is added if absent), and keeps complete rows."""
    if "NIR_V" in features and "NIR_V" not in df.columns:
        df = df.withColumn("NIR_V", F.col("SR_B4") * F.col("NDVI"))
    missing = [c for c in [*features, *([label] if label else [])] if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return complete_rows(df, [*features, *([label] if label else [])])


def split_by_year(df: DataFrame, first: int, last: int, validation: str = "last") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Train, test and validation rows: validation is the first or last year or none, test the year beside it."""
    year = F.col("year")
    if validation == "none":
        return df.where(year < last), df.where(year == last), df.where(F.lit(False))
    held, test = (first, first + 1) if validation == "first" else (last, last - 1)
    return df.where(~year.isin(held, test)), df.where(year == test), df.where(year == held)


def split_stratified(df: DataFrame, key: str, label: str = LABEL, strata: int = 10, share: float = 0.8, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Train and test rows by the hash of a key, with the same share of each k-means cluster of the label."""
    from ..operators.ranks import kth_smallest

    vec = VectorAssembler(inputCols=[label], outputCol="__v", handleInvalid="skip").transform(df)
    rows = KMeans(k=strata, seed=seed, featuresCol="__v", predictionCol="__s").fit(vec).transform(vec).drop("__v").withColumn("__h", F.xxhash64(key, F.lit(seed)))
    # of each stratum the hash up to which its share of rows lies, found by counting
    wanted = rows.groupBy("__s").agg(F.count(F.lit(1)).alias("n")).select("__s", F.array(F.ceil(F.col("n") * share) - 1).alias("ranks"))
    limits = kth_smallest(rows, ["__s"], F.col("__h"), wanted).select("__s", F.col("keys")[0].alias("__limit"))
    marked = rows.join(limits, "__s").withColumn("__train", F.col("__h") <= F.col("__limit")).drop("__s", "__h", "__limit")
    return marked.where("__train").drop("__train"), marked.where("not __train").drop("__train")


def scaler(df: DataFrame, features: list[str]) -> PipelineModel:
    stages = [VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip"), StandardScaler(inputCol="features", outputCol="scaled", withMean=True)]
    return Pipeline(stages=stages).fit(df)


def _fit(model, df: DataFrame, features: list[str]) -> PipelineModel:
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip"), model]).fit(df)


def random_forest(df: DataFrame, features: list[str] = FEATURES, label: str = LABEL, trees: int = 200, depth: int = 14, seed: int = 0) -> PipelineModel:
    return _fit(RandomForestRegressor(labelCol=label, numTrees=trees, maxDepth=depth, minInstancesPerNode=4, featureSubsetStrategy="0.5", subsamplingRate=0.5, seed=seed), df, features)


def gradient_boost(df: DataFrame, features: list[str] = FEATURES, label: str = LABEL, trees: int = 200, depth: int = 10, rate: float = 0.05, seed: int = 0) -> PipelineModel:
    return _fit(GBTRegressor(labelCol=label, maxIter=trees, maxDepth=depth, stepSize=rate, seed=seed), df, features)


def boosted_with_stop(df: DataFrame, held: str, features: list[str] = FEATURES, label: str = LABEL, trees: int = 999, depth: int = 14, rate: float = 0.2, seed: int = 0) -> PipelineModel:
    """Boosting that stops when rows flagged `held` no longer improve."""
    return _fit(GBTRegressor(labelCol=label, maxIter=trees, maxDepth=depth, stepSize=rate, validationIndicatorCol=held, seed=seed), df, features)


def baseline(train: DataFrame, rows: DataFrame, label: str = LABEL) -> DataFrame:
    """Every row is predicted the training mean."""
    return rows.join(F.broadcast(train.agg(F.avg(label).alias("prediction"))))


def evaluate(df: DataFrame, keys: list[str] = [], label: str = LABEL, predicted: str = "prediction") -> DataFrame:  # noqa: B006
    y, p = F.col(label).cast("double"), F.col(predicted).cast("double")
    return df.dropna(subset=[label, predicted]).groupBy(*keys).agg(bias(y, p).alias("bias"), mae(y, p).alias("mae"), r2(y, p).alias("r2"))


def load_or_fit(df: DataFrame, path: str, fit, overwrite: bool = False) -> PipelineModel:
    if exists(df.sparkSession, path) and not overwrite:
        return PipelineModel.load(path)
    model = fit(df)
    model.write().overwrite().save(path)
    return model


def infer_by_realm(df: DataFrame, models: dict[str, PipelineModel]) -> DataFrame:
    """(x, y, biomass) of every realm by its own model; realms without one give none."""
    from ..operators.setops import union_all

    parts = [m.transform(df.where(F.col("realm") == r)).select("x", "y", F.col("prediction").alias("biomass")) for r, m in models.items()]
    return union_all(parts)


def importances(model: PipelineModel, features: list[str]) -> list[tuple[str, float]]:
    return sorted(zip(features, map(float, model.stages[-1].featureImportances.toArray())), key=lambda x: -x[1])


def principal_components(df: DataFrame, features: list[str], k: int) -> PipelineModel:
    stages = [VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip"), StandardScaler(inputCol="features", outputCol="centred", withMean=True, withStd=False), PCA(k=k, inputCol="centred", outputCol="components")]
    return Pipeline(stages=stages).fit(df)
