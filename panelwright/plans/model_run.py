"""The whole model run, which can be called again: model groups, what is still to fit, ids, features, fits, and four result tables.

A folder holds the results store. Rows of models, predictions, feature importances and evaluations are written first; then one marker per model is
published, by name of what was fitted (group, train set, test set, label method). Readers see the rows of published models only, so all four tables of
a model become visible at one moment, a run that is killed shows nothing by half, and of two runs that fit the same model at the same time one is seen.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.functions.sizing import broadcast_if_small
from panelwright.operators import encode, evaluate, impute, models, registry, splits
from panelwright.operators.panel import MONTH
from panelwright.operators.ranking import GROUP
from panelwright.plans import monthly_run
from panelwright.session import durable
from panelwright.sources import once

TABLES = {
    "models": "model_id bigint, model_group_id bigint, model_type string, model_parameters string, training_table_name string, "
    "label_imputation_method string, model_comment string",
    "predictions": "model_id bigint, as_of_date date, borough_predicted_for string, entity_id bigint, training_table_name string, score double, "
    "top_k bigint, label_observed int, rank_abs int, rank_pct double",
    "feature_importances": "model_id bigint, feature string, feature_importance double, rank_abs int, rank_pct double",
    "evaluations": "model_id bigint, as_of_date date, metric string, parameters string, value double, test_matrix_name string, top_k string",
}
GROUP_SCHEMA = "model_group_id bigint, algorithm_type string, label string, hyperparameters string, feature_list string, borough_fit_on string"
MARKER_SCHEMA = "attempt string, model_id bigint"


@dataclass(frozen=True)
class Settings:
    """What a run does beside its list of models. ``levels`` are text features; those with few entities are pooled."""

    label: str
    features: Sequence[str]
    levels: Sequence[str] = ()
    level_threshold: int = 1
    feature_list_name: str | None = None
    boroughs_fit: Sequence[str] = ("all",)
    boroughs_predict: Sequence[str] = ("all",)
    label_method: str = "none"
    label_share: float | None = None
    binary: str = impute.ZEROS
    continuous: str = impute.MEAN
    months: int = 1
    train_start: str | None = None
    units: str = "internal_units_static"
    entity: str = "address_id"
    target: str | None = "internal_peu_target_zip"
    comment: str = "None"
    parameters: Mapping = field(default_factory=dict)


# --- the store --------------------------------------------------------------------------------


def published(spark: SparkSession, folder: str) -> DataFrame:
    """(attempt, model_id) of all models that readers see."""
    if not once.names_in(spark, f"{folder}/published"):
        return spark.createDataFrame([], MARKER_SCHEMA)
    return spark.read.schema(MARKER_SCHEMA).json(f"{folder}/published")


def results(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """The rows of a result table, of published models only."""
    if not once.names_in(spark, f"{folder}/{table}"):
        return spark.createDataFrame([], TABLES[table])
    rows = spark.read.schema(f"{TABLES[table]}, attempt string").parquet(f"{folder}/{table}")
    seen = broadcast_if_small(durable(published(spark, folder)))
    return rows.join(seen, ["attempt", "model_id"], "left_semi").drop("attempt")


def model_groups(spark: SparkSession, folder: str) -> DataFrame:
    if not once.names_in(spark, f"{folder}/model_group"):
        return spark.createDataFrame([], GROUP_SCHEMA)
    return spark.read.schema(GROUP_SCHEMA).json(f"{folder}/model_group")


def _name_of(parts) -> str:
    return hashlib.sha256(json.dumps(parts, sort_keys=True).encode()).hexdigest()


def register_groups(spark: SparkSession, folder: str, specs: Sequence[Mapping]) -> list[int]:
    """Ids of the specs' model groups: stored ones that are equal, new ones under new ids; equal specs share one, by another writer too."""
    wanted = registry.model_group_rows(spark, specs).collect()
    rows = [(at, *r) for at, r in enumerate(wanted)]
    candidates = spark.createDataFrame(rows, f"candidate_id int, {GROUP_SCHEMA.partition(', ')[2]}")
    found = {r["candidate_id"]: r["model_group_id"] for r in registry.match_model_groups(candidates, model_groups(spark, folder)).collect()}
    fresh = [at for at, group in found.items() if group is None]
    first = once.reserve_ids(spark, f"{folder}/ids/model_group", len(fresh)) if fresh else 0
    for n, at in enumerate(sorted(fresh)):
        row = wanted[at].asDict()
        same = [row["algorithm_type"], row["label"], json.loads(row["hyperparameters"]), sorted(set(row["feature_list"].split(","))), sorted(set(row["borough_fit_on"].split("_")))]
        path = f"{folder}/model_group/{_name_of(same)}.json"
        if once.put_if_absent(spark, path, json.dumps({"model_group_id": first + n, **row})):
            found[at] = first + n
        else:
            found[at] = json.loads(once.read_text(spark, path))["model_group_id"]
    return [found[at] for at in range(len(specs))]


# --- what is to fit ---------------------------------------------------------------------------


def labelled_splits(panel: DataFrame, split_list: Sequence, s: Settings) -> list[str]:
    """Splits whose test months have a known label; the others wait until they have one. One pass over the panel for all of them."""
    tests = splits.with_test_splits(panel.select(MONTH, s.label, *([s.target] if s.target else [])), split_list, s.months, s.target)
    known = evaluate.labelled_per_month(tests, s.label, "split_date").where("labelled > 0").select(F.col("split_date").cast("string").alias("d"))
    days = {r["d"] for r in known.collect()}
    return [str(x) for x in split_list if str(x) in days]


def candidates(spark: SparkSession, groups: Sequence[int], days: Sequence[str], s: Settings) -> DataFrame:
    name = s.feature_list_name or "all"
    rows = [
        (day, at, group, f"train_split_{day}_features_{name}", f"test_split_{day}_features_{name}", s.label_method)
        for day in days
        for at, group in enumerate(groups)
    ]
    kind = "split_date string, spec int, model_group_id bigint, training_table_name string, test_matrix_name string, label_imputation_method string"
    return spark.createDataFrame(rows, kind)


# --- one split --------------------------------------------------------------------------------


def split_features(panel: DataFrame, day: str, s: Settings) -> tuple[DataFrame, DataFrame, list[str], list[str]]:
    """Stored train and test rows with labels filled, levels as a sparse vector, numbers imputed and scaled by the train rows; the features and their names."""
    keep = [F.col(c).alias(monthly_run._KEPT + c) for c in dict.fromkeys([s.entity, MONTH, s.units, s.label])]
    needed = list(dict.fromkeys([s.entity, MONTH, s.label, impute.BOROUGH, *s.features, *s.levels]))
    filled = s.label_method != "none"
    train = splits.train_rows(panel, day, None if filled else s.label, s.train_start).select(*needed, *keep)
    test = splits.test_rows(panel, day, s.months, s.target).select(*needed, *keep)
    if filled:
        train = impute.impute_labels(train, s.label, s.label_method, (s.entity, MONTH), s.label_share)
        train = train.drop(f"{s.label}_imputed_flag").withColumn(s.label, F.col(f"{s.label}_imputed")).drop(f"{s.label}_imputed")
    names, inputs = list(s.features), list(s.features)
    train, test = monthly_run.prepared(train, test, names, s.binary, s.continuous) if names else (train, test.withColumn(monthly_run.UNSEEN, F.lit(0)))
    if s.levels:
        places = encode.level_places(encode.number_levels(encode.fit_levels(train, s.levels, s.level_threshold, s.entity)))
        train, test = (encode.level_vector(part, places, s.levels, "_levels") for part in (train, test))
        inputs, names = [*inputs, "_levels"], [*names, *[f"{f}_{v}" for f, v in places]]
    return durable(train), durable(test), inputs, names


def fit_split(panel: DataFrame, day: str, todo: Sequence, specs: Sequence[Mapping], capacity: DataFrame, s: Settings) -> dict[str, DataFrame]:
    """Rows of the four result tables for the models ``todo`` (rows with model_id, spec, model_group_id) on one split.

    All models score the test rows in one pass, and are ranked and measured together.
    """
    spark = panel.sparkSession
    train, test, inputs, names = split_features(panel, day, s)
    fitted = {c["model_id"]: models.fit(train, inputs, s.label, specs[c["spec"]]["algorithm"], specs[c["spec"]].get("parameters")) for c in todo}
    kept = [c for c in test.columns if c.startswith(monthly_run._KEPT)]
    scored = models.score_all(fitted, test, kept).withColumnsRenamed({c: c.removeprefix(monthly_run._KEPT) for c in kept})
    limits = broadcast_if_small(durable(capacity.select(F.col(MONTH).cast("date").alias(MONTH), F.col("top_k").cast("long").alias("top_k"))))
    scored = durable(scored.join(limits, MONTH, "left"))
    train_name, test_name = todo[0]["training_table_name"], todo[0]["test_matrix_name"]
    weights = [models.importances(spark, model, names).select(F.lit(m).alias("model_id"), "*") for m, model in fitted.items()]
    importance = weights[0]
    for one in weights[1:]:
        importance = importance.unionByName(one)
    importance = durable(importance)
    labelled = evaluate.drop_unlabelled_months(scored, s.label).select(
        "model_id", F.col(MONTH).alias("as_of_date"), F.col(s.entity).alias("entity_id"), "score", F.col(s.units).cast("int").alias("units"),
        F.col(s.label).alias("label"), "top_k",
    )
    metrics = evaluate.metrics_at_k(labelled, "label", F.col("top_k"), GROUP)
    own = spark.createDataFrame(
        [(c["model_id"], c["model_group_id"], specs[c["spec"]]["algorithm"]) for c in todo], "model_id bigint, model_group_id bigint, algorithm_type string"
    )
    coefficients = importance.join(own, "model_id").select("model_group_id", "feature", F.col("feature_importance").alias("coefficient"))
    rows = registry.model_rows(own, coefficients, train_name, s.label_method, s.comment)
    return {
        "models": rows.join(own.select("model_id", "model_group_id"), "model_group_id").select("model_id", *rows.columns),
        "predictions": models.prediction_rows(scored, None, s.label, train_name, "top_k", s.boroughs_predict, s.entity),
        "feature_importances": models.importance_rows(importance),
        "evaluations": evaluate.metric_rows(metrics, GROUP, test_name),
    }


def publish(spark: SparkSession, folder: str, tables: Mapping[str, DataFrame], todo: Sequence) -> int:
    """Write the rows of all tables, then a marker per model; the number of models that are seen because of it."""
    attempt = uuid4().hex
    for name, rows in tables.items():
        rows.selectExpr(*[f"cast({c} as {kind}) as {c}" for c, kind in (x.split() for x in TABLES[name].split(", "))]).write.parquet(
            f"{folder}/{name}/attempt={attempt}"
        )
    seen = 0
    for c in todo:
        key = [c["model_group_id"], c["training_table_name"], c["test_matrix_name"], c["label_imputation_method"]]
        text = json.dumps({"attempt": attempt, "model_id": c["model_id"]})
        seen += once.put_if_absent(spark, f"{folder}/published/{_name_of(key)}.json", text)
    return seen


def run(panel: DataFrame, split_list: Sequence, model_list: Sequence[Mapping], visited: DataFrame, folder: str, s: Settings, run_key: str | None = None) -> int:
    """Fit what is not fitted yet of models x splits; the number of models added to the store.

    ``visited`` has the units visited per month (month_start, units_canvassed): half of them is the month's capacity. Under a ``run_key`` the run's
    parameters are stored once. A split without a known label in its test months is left for a later call.
    """
    spark = panel.sparkSession
    if run_key is not None:
        registry.append_config(spark, f"{folder}/configs", run_key, {**s.parameters, "label": s.label, "features": list(s.features), "splits": [str(x) for x in split_list]})
    s = replace(s, feature_list_name=s.feature_list_name or _name_of([list(s.features), list(s.levels)])[:12])
    specs = [
        {"algorithm_type": m["algorithm"], "label": s.label, "parameters": dict(m.get("parameters") or {}), "feature_list_name": s.feature_list_name, "boroughs": list(s.boroughs_fit)}
        for m in model_list
    ]
    groups = register_groups(spark, folder, specs)
    days = labelled_splits(panel, split_list, s)
    if not days:
        return 0
    fresh = registry.still_to_fit(candidates(spark, groups, days, s), results(spark, folder, "models"), results(spark, folder, "evaluations"))
    todo = [r.asDict() for r in fresh.dropDuplicates(["model_group_id", "split_date"]).orderBy("split_date", "spec").collect()]
    if not todo:
        return 0
    first = once.reserve_ids(spark, f"{folder}/ids/models", len(todo))
    added, capacity = 0, evaluate.half_of_visited(visited)
    for at, c in enumerate(todo):
        c["model_id"] = first + at
    for day in dict.fromkeys(c["split_date"] for c in todo):
        own = [c for c in todo if c["split_date"] == day]
        added += publish(spark, folder, fit_split(panel, day, own, model_list, capacity, s), own)
    return added
