"""Fit classifiers per split, score test rows, and list importances. All fitting is Spark ML."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.operators.impute import SEED
from panelwright.operators.ranking import GROUP, with_ranks

FEATURES, LABEL = "_features", "_label"


def estimator(algorithm: str, parameters: Mapping | None = None):
    """An estimator by family name; parameters are Spark ML parameter names.

    Lasso is L1 logistic regression, Ridge is L2; the CV families choose their penalty by cross-validation.
    """
    common = {"featuresCol": FEATURES, "labelCol": LABEL}
    given = dict(parameters or {})
    if algorithm == "DecisionTreeClassifier":
        return DecisionTreeClassifier(**common, seed=SEED, **given)
    if algorithm == "RandomForestClassifier":
        return RandomForestClassifier(**common, seed=SEED, **given)
    if algorithm == "GradientBoostingClassifier":
        return GBTClassifier(**common, seed=SEED, **given)
    if algorithm == "SVC":
        # Without a penalty the hinge loss has no unique minimum, and a tight tolerance only adds passes.
        return LinearSVC(**common, **{"regParam": 1e-3, "tol": 1e-3, "maxIter": 50, **given})
    penalty = {"Lasso": 1.0, "LassoCV": 1.0, "RidgeClassifier": 0.0, "RidgeClassifierCV": 0.0}
    if algorithm in penalty or algorithm in ("LogisticRegression", "LogisticRegressionCV"):
        base = LogisticRegression(**common, **{"elasticNetParam": penalty.get(algorithm, 0.0), **given})
        if not algorithm.endswith("CV"):
            return base
        grid = ParamGridBuilder().addGrid(base.regParam, [0.001, 0.01, 0.1, 1.0]).build()
        judge = BinaryClassificationEvaluator(labelCol=LABEL)
        return CrossValidator(estimator=base, estimatorParamMaps=grid, evaluator=judge, numFolds=3, seed=SEED)
    raise ValueError(f"unknown model family {algorithm!r}")


def fit(train: DataFrame, features: Sequence[str], label: str, algorithm: str, parameters: Mapping | None = None) -> PipelineModel:
    """Fit on rows with a known label; missing features must be imputed before. A feature may be a column of vectors, sparse ones included."""
    rows = train.where(F.col(label).isNotNull()).select(*features, F.col(label).cast("double").alias(LABEL))
    stages = [VectorAssembler(inputCols=list(features), outputCol=FEATURES), estimator(algorithm, parameters)]
    return Pipeline(stages=stages).fit(rows)


def score(model: PipelineModel, rows: DataFrame, keep: Sequence[str], name: str = "score") -> DataFrame:
    """Kept columns and the score: probability of 1, or the squashed margin where a model has none."""
    scored = model.transform(rows)
    return scored.select(*keep, _score_column(scored, "probability", "rawPrediction").alias(name))


def _score_column(scored: DataFrame, probability: str, raw: str) -> Column:
    if probability in scored.columns:
        return vector_to_array(probability)[1]
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-vector_to_array(raw)[1]))


def score_all(fitted: Mapping[int, PipelineModel], rows: DataFrame, keep: Sequence[str], name: str = "score") -> DataFrame:
    """Kept columns, model_id and score, long by model: all models that take the same features score in one pass over the rows."""
    named, values = rows, {}
    for at, (model_id, model) in enumerate(fitted.items()):
        if at == 0:
            for stage in model.stages[:-1]:
                named = stage.transform(named)
        last, out = _last_stage(model), {}
        for column in ("prediction", "rawPrediction", "probability"):
            if last.hasParam(f"{column}Col"):
                out[last.getParam(f"{column}Col")] = f"_{column}_{at}"
        named = last.copy(out).transform(named)
        values[model_id] = _score_column(named, f"_probability_{at}", f"_rawPrediction_{at}")
    wide = named.select(*keep, *[value.alias(str(model_id)) for model_id, value in values.items()])
    long = wide.unpivot(list(keep), [str(m) for m in values], "model_id", name)
    return long.withColumn("model_id", F.col("model_id").cast("long"))


def _last_stage(model: PipelineModel):
    last = model.stages[-1]
    return getattr(last, "bestModel", last)


def importances(spark: SparkSession, model: PipelineModel, features: Sequence[str]) -> DataFrame:
    """(feature, feature_importance): tree importances, or coefficients; one row per feature."""
    last = _last_stage(model)
    values = last.featureImportances if hasattr(last, "featureImportances") else last.coefficients
    rows = list(zip(features, (float(v) for v in values.toArray())))
    return spark.createDataFrame(rows, "feature string, feature_importance double")


def importance_rows(importance: DataFrame, model_id: int | None = None) -> DataFrame:
    """Importance rows with rank and percent rank; one row per feature of a model, so a plain window. Without a model_id, the rows' own column counts."""
    model = F.col("model_id") if model_id is None else F.lit(model_id)
    rows = importance.select(model.cast("long").alias("model_id"), "feature", "feature_importance")
    return with_ranks(rows, ["model_id"], "feature_importance", bounded=True)


def prediction_rows(
    scored: DataFrame,
    model_id: int | None,
    label: str,
    train_name: str,
    top_k,
    boroughs: Sequence[str],
    entity: str = "address_id",
    month: str = "month_start",
) -> DataFrame:
    """Prediction rows: score, rank in model and month, label-observed flag, k. Without a model_id, the rows' own column counts."""
    k = F.lit(top_k).cast("long") if isinstance(top_k, (int, float)) else F.col(top_k).cast("long")
    rows = scored.select(
        (F.col("model_id") if model_id is None else F.lit(model_id)).cast("long").alias("model_id"),
        F.col(month).alias("as_of_date"),
        F.lit("_".join(boroughs)).alias("borough_predicted_for"),
        F.col(entity).alias("entity_id"),
        F.lit(train_name).alias("training_table_name"),
        "score",
        k.alias("top_k"),
        F.col(label).isNotNull().cast("int").alias("label_observed"),
    )
    return with_ranks(rows, GROUP)
