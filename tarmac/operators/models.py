"""Model building blocks on ``pyspark.ml``.

Training runs on the executors (tree learners aggregate split statistics per
partition; linear models aggregate gradients per partition). Class weights,
the split and all metrics are DataFrame expressions and aggregates.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Spark's tree depth limit.
MAX_TREE_DEPTH = 30


def assembler(cols: list[str], out: str = "features") -> VectorAssembler:
    return VectorAssembler(inputCols=cols, outputCol=out, handleInvalid="keep")


def scaled_numeric(numeric: list[str], out: str = "num_scaled") -> list:
    return [
        VectorAssembler(inputCols=numeric, outputCol="num_raw", handleInvalid="keep"),
        StandardScaler(inputCol="num_raw", outputCol=out, withMean=True, withStd=True),
    ]


def linear_features(numeric: list[str], categorical: list[str]) -> list:
    """Scaled numerics followed by the one-hot columns of an encoder (sparse)."""
    return scaled_numeric(numeric) + [
        VectorAssembler(inputCols=["num_scaled"] + [f"{c}__oh" for c in categorical], outputCol="features")]


def l2_for_sklearn_c(sum_weights: float, c: float = 1.0) -> float:
    """Spark's mean-loss objective with ``regParam`` equals the summed-loss
    objective with inverse strength ``C`` when regParam = 1 / (C * sum_w)."""
    return 1.0 / (c * max(sum_weights, 1.0))


def logistic(max_iter: int = 200, reg: float = 0.0, weight_col: str | None = "weight") -> LogisticRegression:
    lr = LogisticRegression(maxIter=max_iter, regParam=reg, elasticNetParam=0.0, standardization=False,
                            featuresCol="features", labelCol="label")
    if weight_col:
        lr.setWeightCol(weight_col)
    return lr


def _depth(max_depth: int) -> int:
    if max_depth > MAX_TREE_DEPTH:
        raise ValueError(f"trees deeper than {MAX_TREE_DEPTH} are not supported: {max_depth}")
    return max_depth


def boosted_regressor(max_iter: int = 200, step: float = 0.05, max_depth: int = 5, seed: int = 42,
                      max_bins: int = 32) -> GBTRegressor:
    return GBTRegressor(maxIter=max_iter, stepSize=step, maxDepth=_depth(max_depth), seed=seed,
                        maxBins=max_bins, featuresCol="features", labelCol="label")


def linear_regression() -> LinearRegression:
    return LinearRegression(regParam=0.0, elasticNetParam=0.0, standardization=False, featuresCol="features",
                            labelCol="label")


def fit(stages: list, train: DataFrame) -> PipelineModel:
    return Pipeline(stages=stages).fit(train)


def score(model: PipelineModel, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Model output as plain columns: ``prediction`` and, for classifiers,
    ``p`` = probability of the positive class."""
    out = model.transform(df)
    cols = [F.col(c) for c in (keep or [])] + [F.col("label"), F.col("prediction").cast("int").alias("prediction")]
    if "probability" in out.columns:
        cols.append(vector_to_array("probability")[1].alias("p"))
    return out.select(*cols)


def silhouette(clustered: DataFrame) -> float:
    return ClusteringEvaluator(featuresCol="features", predictionCol="cluster",
                               metricName="silhouette", distanceMeasure="squaredEuclidean").evaluate(clustered)
