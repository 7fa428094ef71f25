"""Model fits on Spark ML: single models, ensembles, meta-label gating and adversarial validation."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRestModel, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.storagelevel import StorageLevel

from barlab.operators.metrics import balanced_weights, eval_binary, eval_multiclass, eval_regression, meta_features
from barlab.operators.ranks import auc
from barlab.operators.splits import early_stopping_carve
from barlab.session import cut_lineage

N_CLASSES = 3
L1_GRID = (0.001, 0.01, 0.1)
ADVERSARIAL_FOLDS = 5
PRIMARY = {"binary": "auc", "regression": "pearson_r", "multiclass": "macro_auc_ovr"}


@dataclass(frozen=True)
class ModelSpec:
    """What to fit. ``params`` go to the boosted trees; ``early_stopping`` names the validation share."""

    name: str
    objective: str
    features: tuple[str, ...]
    interval: str = "1h"
    params: Mapping[str, float] = field(default_factory=dict)
    early_stopping: float = 0.0
    seed: int = 42


def _trees(spec: ModelSpec, **extra) -> dict:
    return {"maxIter": 20, "maxDepth": 4, "seed": spec.seed, "labelCol": "y", "featuresCol": "features",
            **spec.params, **extra}


@contextmanager
def kept(rows: DataFrame) -> Iterator[DataFrame]:
    """Rows held in memory, spilling to disk, while an iterative fit passes over them."""
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield rows
    finally:
        rows.unpersist()


def assembler(features: Sequence[str]) -> VectorAssembler:
    """A missing feature raises: rows are completed or dropped, and counted, before a model sees them."""
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="error")


def _normalized(raw: Column) -> Column:
    """Scores of independent one-vs-rest models squashed to probabilities that sum to one."""
    p = F.transform(raw, lambda r: 1.0 / (1.0 + F.exp(-2.0 * r)))
    total = F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
    return F.transform(p, lambda x: x / total)


def _array(scored: DataFrame, spec_objective: str) -> Column:
    if "probability" in scored.columns:
        return vector_to_array("probability")
    return _normalized(vector_to_array("rawPrediction"))


def concurrently(spark: SparkSession, tasks: Sequence[Callable]) -> list:
    """Results of ``tasks``, run side by side, each with local properties of its own.

    The ``parallelism`` of Spark's own estimators hands one set of properties to all their threads, and a query that ends
    in one thread takes the execution id from a query that starts in another; they keep to 1 here.
    """
    with ThreadPoolExecutor(len(tasks)) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(t)) for t in tasks]]


def _one_vs_rest(rows: DataFrame, spec: ModelSpec, extra: Mapping[str, str]) -> OneVsRestModel:
    """One boosted sequence per class. With a validation column each class stops on its own validation loss, so the
    sequences have lengths of their own."""
    trees = GBTClassifier(**{**_trees(spec, **extra), "labelCol": "_class"})
    models = concurrently(rows.sparkSession, [
        lambda c=c: trees.fit(rows.withColumn("_class", (F.col("y") == c).cast("double"))) for c in range(N_CLASSES)])
    return OneVsRestModel(models=models).setFeaturesCol("features").setPredictionCol("prediction").setRawPredictionCol("rawPrediction")


def fit(train: DataFrame, spec: ModelSpec, order: Sequence[str] = ("ts",), keys: Sequence[str] = ()) -> PipelineModel:
    """Boosted trees for the objective. With early stopping the tail of the train rows (behind an
    embargo gap) is the validation set; when the carve's guards fail all rows are used."""
    extra = {}
    if spec.early_stopping > 0:
        carved = early_stopping_carve(train, spec.early_stopping, spec.interval, keys, order)
        if not carved.filter(F.col("role").isNull()).limit(1).count():
            train = carved.filter(F.col("role") != "embargo").withColumn("is_val", F.col("role") == "es_val")
            extra["validationIndicatorCol"] = "is_val"
    if spec.objective == "binary":
        model = GBTClassifier(**_trees(spec, **extra))
    elif spec.objective == "regression":
        model = GBTRegressor(**_trees(spec, **extra))
    elif spec.objective != "multiclass":
        raise ValueError(f"unknown objective {spec.objective!r}")
    used = [*spec.features, "y", *([extra["validationIndicatorCol"]] if extra else [])]
    with kept(train.select(*used)) as rows:
        if spec.objective == "multiclass":
            columns = assembler(spec.features)
            return PipelineModel([columns, _one_vs_rest(columns.transform(rows), spec, extra)])
        return Pipeline(stages=[assembler(spec.features), model]).fit(rows)


def predict(model: PipelineModel, rows: DataFrame, spec: ModelSpec) -> DataFrame:
    """Adds ``predicted`` (P(class 1) or value) or ``probs`` (multiclass); drops the model's columns."""
    scored = model.transform(rows)
    if spec.objective == "regression":
        out = scored.withColumn("predicted", F.col("prediction"))
    else:
        probs = _array(scored, spec.objective)
        out = (scored.withColumn("probs", probs) if spec.objective == "multiclass"
               else scored.withColumn("predicted", F.get(probs, F.lit(1))))
    return out.drop("features", "rawPrediction", "probability", "prediction")


def evaluate(predicted: DataFrame, spec: ModelSpec, keys: Sequence[str] = ()) -> DataFrame:
    if spec.objective == "binary":
        return eval_binary(predicted, keys, "y")
    if spec.objective == "regression":
        return eval_regression(predicted, keys, "y")
    return eval_multiclass(predicted, N_CLASSES, keys)


def fit_and_evaluate(train: DataFrame, val: DataFrame, spec: ModelSpec) -> tuple[PipelineModel, DataFrame]:
    model = fit(train, spec)
    return model, evaluate(predict(model, val, spec), spec)


def importances(models: Mapping[str, PipelineModel], features: Sequence[str], top: int = 10) -> list[tuple[str, float]]:
    """Mean gain importance over the models that have one, ``top`` largest, two decimals."""
    found = [getattr(m.stages[-1], "featureImportances", None) for m in models.values()]
    found = [v.toArray() for v in found if v is not None]
    if not found:
        return []
    mean = sum(found) / len(found)
    ranked = sorted(zip(features, mean), key=lambda fv: (-fv[1], features.index(fv[0])))
    return [(f, round(float(v), 2)) for f, v in ranked[:top]]


def fit_ensemble(train: DataFrame, spec: ModelSpec, folds: int = 3) -> dict[str, PipelineModel]:
    """Random forest, boosted trees and L1 logistic regression on the same class-weighted rows."""
    weighted = balanced_weights(train, "y")
    common = dict(labelCol="y", weightCol="weight", featuresCol="features")
    forest = RandomForestClassifier(numTrees=20, maxDepth=5, seed=spec.seed, **common)
    linear = LogisticRegression(elasticNetParam=1.0, labelCol="y", weightCol="weight", featuresCol="scaled", maxIter=25)
    tuned = CrossValidator(
        estimator=linear, estimatorParamMaps=ParamGridBuilder().addGrid(linear.regParam, list(L1_GRID)).build(),
        evaluator=MulticlassClassificationEvaluator(labelCol="y", metricName="logLoss"), numFolds=folds, seed=spec.seed)
    scale = StandardScaler(inputCol="features", outputCol="scaled", withMean=True)
    first = assembler(spec.features)
    with kept(weighted.select(*spec.features, "y", "weight")) as rows:
        return {
            "rf": Pipeline(stages=[first, forest]).fit(rows),
            "gbt": PipelineModel([first, _one_vs_rest(first.transform(rows), spec, {"weightCol": "weight"})]),
            "lr": Pipeline(stages=[first, scale, tuned]).fit(rows),
        }


def predict_ensemble(models: Mapping[str, PipelineModel], rows: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Long (keep..., model, class, p)."""
    parts = None
    for name, model in models.items():
        scored = model.transform(rows)
        long = scored.select(*keep, F.lit(name).alias("model"), F.posexplode(_array(scored, "multiclass")).alias("class", "p"))
        parts = long if parts is None else parts.unionByName(long)
    return parts


def fit_meta_label(probas: DataFrame, row: Sequence[str], folds: int = 3, seed: int = 42) -> PipelineModel | None:
    """P(the ensemble is right) from its confidence, spread, disagreement and direction; None when the
    tail holds a single outcome (gating is then off)."""
    table = cut_lineage(meta_features(probas, row, N_CLASSES, "y"))
    if table.select("meta_target").distinct().limit(2).count() < 2:
        return None
    names = ["confidence", "spread", "disagreement", *[f"direction_{c}" for c in range(N_CLASSES)]]
    linear = LogisticRegression(elasticNetParam=1.0, labelCol="meta_target", featuresCol="scaled", maxIter=25)
    tuned = CrossValidator(
        estimator=linear, estimatorParamMaps=ParamGridBuilder().addGrid(linear.regParam, list(L1_GRID)).build(),
        evaluator=BinaryClassificationEvaluator(labelCol="meta_target"), numFolds=folds, seed=seed)
    scale = StandardScaler(inputCol="features", outputCol="scaled", withMean=True)
    with kept(table.select(*names, "meta_target")) as rows:
        return Pipeline(stages=[assembler(names), scale, tuned]).fit(rows)


def predict_pwin(meta: PipelineModel, probas: DataFrame, row: Sequence[str], y: str | None = "y") -> DataFrame:
    scored = meta.transform(meta_features(probas, row, N_CLASSES, y))
    return scored.withColumn("pwin", F.get(vector_to_array("probability"), F.lit(1))).drop(
        "features", "scaled", "rawPrediction", "probability", "prediction")


def labelled_union(train: DataFrame, test: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Train rows with ``y`` 0 above test rows with ``y`` 1."""
    return train.select(*columns).withColumn("y", F.lit(0.0)).unionByName(test.select(*columns).withColumn("y", F.lit(1.0)))


def adversarial_auc(
    train: DataFrame, test: DataFrame, features: Sequence[str], row: Sequence[str], folds: int = ADVERSARIAL_FOLDS,
    seed: int = 42, drop: Sequence[str] = ("interval_indicator",), max_iter: int = 50,
) -> DataFrame:
    """Mean held-out AUC of telling test rows from train rows by their features (0.5: alike).

    A row's fold is a seeded hash of its key, so folds are stable and balanced within both sides.
    One scored union gives all fold AUCs in one job.
    """
    names = [f for f in features if f not in drop]
    both = labelled_union(train, test, [*row, *names])
    folded = both.withColumn("_fold", F.pmod(F.xxhash64(F.lit(seed), *row), F.lit(folds)).cast("int"))
    ready = cut_lineage(assembler(names).transform(folded).select("_fold", "y", "features"))
    scored = None
    for k in range(folds):
        model = GBTClassifier(labelCol="y", maxIter=max_iter, maxDepth=3, seed=seed).fit(ready.filter(F.col("_fold") != k))
        part = model.transform(ready.filter(F.col("_fold") == k)).select(
            "_fold", "y", F.get(vector_to_array("probability"), F.lit(1)).alias("p"))
        scored = part if scored is None else scored.unionByName(part)
    per_fold = auc(scored, ["_fold"], "p", F.col("y") == 1.0)
    return per_fold.agg(F.avg("auc").alias("adversarial_auc"), F.count("auc").alias("n_folds"))
