"""Stacking: aligned out-of-fold predictions of several models and the model fitted on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, functions as F

REG_GRID = (0.001, 0.01, 0.1, 1.0)


def oof_matrix(oof: DataFrame, labels: DataFrame, models: Sequence[str], keys: Sequence[str] = ("ts",)) -> DataFrame:
    """One row per timestamp that every model predicted and that has a label.

    ``oof``: model, fold, keys, prediction. A timestamp predicted in several folds keeps the newest.
    Alignment is one aggregation per key instead of a chain of joins.
    """
    newest = lambda m: F.max_by(F.when(F.col("model") == m, F.col("prediction")), F.when(F.col("model") == m, F.col("fold")))
    wide = oof.filter(F.col("model").isin(list(models)) & F.col("prediction").isNotNull()).groupBy(*keys).agg(
        *[newest(m).alias(m) for m in models])
    return wide.dropna(subset=list(models)).join(labels.filter(F.col("y").isNotNull()), list(keys))


def train_stacker(
    matrix: DataFrame, models: Sequence[str], objective: str, folds: int = 5, seed: int = 0
) -> PipelineModel:
    """Ridge-penalised logistic or linear model over the models' predictions, strength by
    cross-validation."""
    if objective not in ("binary", "regression"):
        raise ValueError(f"stacking needs a binary or regression objective, got {objective!r}")
    stats = matrix.agg(
        F.count(F.lit(1)).alias("n"), F.min("y").alias("lo"), F.max("y").alias("hi"),
        F.count_if(F.isnan("y") | F.greatest(*[F.isnan(m) for m in models]) if len(models) > 1 else F.isnan("y")).alias("bad"),
    ).head()
    if stats.n < 2 * folds:
        raise ValueError(f"{stats.n} rows are too few for {folds} folds")
    if stats.bad:
        raise ValueError("predictions or labels contain NaN")
    if objective == "binary":
        if stats.lo == stats.hi:
            raise ValueError("labels hold a single class")
        estimator = LogisticRegression(labelCol="y", elasticNetParam=0.0)
        evaluator = BinaryClassificationEvaluator(labelCol="y")
    else:
        estimator = LinearRegression(labelCol="y", elasticNetParam=0.0)
        evaluator = RegressionEvaluator(labelCol="y", metricName="rmse")
    grid = ParamGridBuilder().addGrid(estimator.regParam, list(REG_GRID)).build()
    search = CrossValidator(estimator=estimator, estimatorParamMaps=grid, evaluator=evaluator, numFolds=folds, seed=seed)
    return Pipeline(stages=[VectorAssembler(inputCols=list(models), outputCol="features"), search]).fit(matrix)


def predict_stacked(model: PipelineModel, matrix: DataFrame, models: Sequence[str]) -> DataFrame:
    """Adds ``stacked``: P(class 1) or the regression value. Columns must match the fit."""
    wanted = model.stages[0].getInputCols()
    if list(models) != list(wanted):
        raise ValueError(f"stacker was fitted on {wanted}, got {list(models)}")
    from pyspark.ml.functions import vector_to_array

    scored = model.transform(matrix)
    value = F.get(vector_to_array("probability"), F.lit(1)) if "probability" in scored.columns else F.col("prediction")
    return scored.withColumn("stacked", value).drop("features", "rawPrediction", "probability", "prediction")
