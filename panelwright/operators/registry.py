"""The results store's bookkeeping: ids, fingerprints, and what was fitted before.

Checks are joins over candidate rows, so many candidates are checked in one job.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.functions.scalars import as_col
from panelwright.operators.prefix import running_totals
from panelwright.sources import once

# Fixed value: share of features that counts as nearly the same set.
NEAR_SHARE = 0.8
RECENT = 5
CONFIG_SCHEMA = "run_key string, name string, value string"
TREES = [
    # Families that store no coefficients.
    "DecisionTreeClassifier",
    "RandomForestClassifier",
    "GradientBoostingClassifier",
    "AdaBoostClassifier",
    "SVC",
]


# --- order-free forms of stored text ----------------------------------------------------------------


def parameter_set(text) -> Column:
    """JSON text of parameters as sorted key/value entries."""
    return F.array_sort(F.map_entries(F.from_json(as_col(text), "map<string,string>")))


def feature_set(text) -> Column:
    return F.array_sort(F.array_distinct(F.split(as_col(text), ",")))


def borough_set(text) -> Column:
    return F.array_sort(F.array_distinct(F.split(as_col(text), "_")))


def _group_keys(df: DataFrame) -> DataFrame:
    return df.select(
        "*",
        parameter_set("hyperparameters").alias("_parameters"),
        feature_set("feature_list").alias("_features"),
        borough_set("borough_fit_on").alias("_boroughs"),
    )


def match_model_groups(candidates: DataFrame, groups: DataFrame, key: str = "candidate_id") -> DataFrame:
    """(key, model_group_id): the newest group equal in algorithm, label, parameters, features and boroughs.

    Null where no group matches. Equal groups are folded to their newest id before the join.
    """
    on = ["algorithm_type", "label", "_parameters", "_features", "_boroughs"]
    newest = _group_keys(groups).groupBy(*on).agg(F.max("model_group_id").alias("model_group_id"))
    return _group_keys(candidates).select(key, *on).join(newest, on, "left").select(key, "model_group_id")


def match_recent_groups(
    candidates: DataFrame, groups: DataFrame, key: str = "candidate_id", recent: int = RECENT, share: float = NEAR_SHARE
) -> DataFrame:
    """As above among the newest few groups, with a feature overlap above the share of the candidate's."""
    on = ["algorithm_type", "label", "_parameters", "_boroughs"]
    last = _group_keys(newest(groups, "model_group_id", recent)).select(
        "model_group_id", *on, F.col("_features").alias("_theirs")
    )
    mine = _group_keys(candidates).select(key, *on, F.col("_features").alias("_mine"))
    enough = F.size(F.array_intersect("_theirs", "_mine")) > F.lit(share) * F.size("_mine")
    joined = mine.join(last, on, "left")
    return joined.groupBy(key).agg(F.max(F.when(enough, F.col("model_group_id"))).alias("model_group_id"))


def fitted_models(models: DataFrame, evaluations: DataFrame) -> DataFrame:
    """Distinct (model_group_id, train matrix, test matrix, label method) of models and their evaluations."""
    tests = evaluations.select("model_id", "test_matrix_name").distinct()
    return models.join(tests, "model_id", "left").select(
        "model_group_id", "training_table_name", "test_matrix_name", "label_imputation_method"
    ).distinct()


def still_to_fit(candidates: DataFrame, models: DataFrame, evaluations: DataFrame) -> DataFrame:
    """Candidates not yet fitted with that train set, test set and label method."""
    on = ["model_group_id", "training_table_name", "test_matrix_name", "label_imputation_method"]
    return candidates.join(fitted_models(models, evaluations), on, "left_anti")


# --- rows, ids and fingerprints ---------------------------------------------------------------------


def model_group_rows(spark: SparkSession, specs: Sequence[Mapping]) -> DataFrame:
    """Model-group rows from {algorithm_type, label, parameters, features or feature_list_name, boroughs}."""
    rows = [
        (
            s["algorithm_type"],
            s["label"],
            json.dumps(s["parameters"], sort_keys=True),
            s.get("feature_list_name") or ",".join(s["features"]),
            "_".join(s["boroughs"]),
        )
        for s in specs
    ]
    return spark.createDataFrame(
        rows, "algorithm_type string, label string, hyperparameters string, feature_list string, borough_fit_on string"
    )


def model_rows(
    groups: DataFrame, coefficients: DataFrame | None, train_name: str, label_method: str, comment: str = "None"
) -> DataFrame:
    """Model rows for groups; coefficients (model_group_id, feature, coefficient) become JSON, trees 'N/A'."""
    base = groups.select("model_group_id", F.col("algorithm_type").alias("model_type"))
    if coefficients is None:
        stored = base.withColumn("model_parameters", F.lit("N/A"))
    else:
        pairs = F.map_from_entries(F.array_sort(F.collect_list(F.struct("feature", "coefficient"))))
        texts = coefficients.groupBy("model_group_id").agg(F.to_json(pairs).alias("_json"))
        stored = base.join(texts, "model_group_id", "left").select(
            "model_group_id",
            "model_type",
            F.when(F.col("model_type").isin(TREES), F.lit("N/A")).otherwise(F.coalesce("_json", F.lit("N/A"))).alias(
                "model_parameters"
            ),
        )
    return stored.select(
        "*",
        F.lit(train_name).alias("training_table_name"),
        F.lit(label_method).alias("label_imputation_method"),
        F.lit(comment).alias("model_comment"),
    )


def with_serial_ids(rows: DataFrame, existing: DataFrame, id_column: str, order: Sequence[str]) -> DataFrame:
    """Number new rows behind the largest existing id, in the order of a unique natural key.

    For a single writer. The numbering is a distributed running count, not one sorted partition.
    """
    top = existing.agg(F.max(id_column).alias("top")).first()["top"] or 0
    numbered = running_totals(rows, [], [F.col(c) for c in order], row_number=id_column)
    return numbered.select((F.col(id_column) + F.lit(top)).cast("long").alias(id_column), *rows.columns)


def by_id(df: DataFrame, id_column: str, value) -> DataFrame:
    return df.where(F.col(id_column) == F.lit(value))


def newest(df: DataFrame, id_column: str, n: int = 1) -> DataFrame:
    return df.orderBy(F.desc(id_column)).limit(n)


def newest_model_of_group(models: DataFrame, model_group_id, train_name: str, recent: int = RECENT) -> DataFrame:
    """Among the newest few models of a group, the newest one fitted on that train set."""
    last = newest(by_id(models, "model_group_id", model_group_id), "model_id", recent)
    return newest(last.where(F.col("training_table_name") == train_name), "model_id")


def fingerprint(
    df: DataFrame, time: str, columns: Sequence[str] | None = None, boroughs: Sequence[str] | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """start, end, rows and an md5 over column names, dates, row count and boroughs; one row per ``by`` group."""
    names = ", ".join(columns if columns is not None else [c for c in df.columns if c not in by])
    at = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    parts = [F.lit(names), at("start_date"), at("end_date"), F.col("n_rows").cast("string")]
    if boroughs is not None:
        parts.append(F.lit("_".join(boroughs)))
    return (
        df.groupBy(*by)
        .agg(F.min(time).alias("start_date"), F.max(time).alias("end_date"), F.count(F.lit(1)).alias("n_rows"))
        .select("*", F.md5(F.concat_ws("_", *parts)).alias("uuid"))
    )


def only_new(candidates: DataFrame, existing: DataFrame, keys: Sequence[str] = ("uuid",)) -> DataFrame:
    """Candidates whose key is not stored yet."""
    return candidates.join(existing.select(*keys).distinct(), list(keys), "left_anti")


def already_known(candidates: DataFrame, existing: DataFrame, keys: Sequence[str] = ("uuid",)) -> DataFrame:
    return candidates.join(existing.select(*keys).distinct(), list(keys), "left_semi")


def run_config(spark: SparkSession, run_key: str, parameters: Mapping[str, object]) -> DataFrame:
    """A run's parameters as (run_key, name, value) rows, values as JSON text."""
    rows = [(run_key, name, json.dumps(value, default=str)) for name, value in parameters.items()]
    return spark.createDataFrame(rows, CONFIG_SCHEMA)


def append_config(spark: SparkSession, folder: str, run_key: str, parameters: Mapping[str, object]) -> bool:
    """Store a run's parameters under its key, once: False, and nothing changes, if the key is taken, by another writer at this moment too."""
    rows = [{"run_key": run_key, "name": name, "value": json.dumps(value, default=str)} for name, value in parameters.items()]
    text = "\n".join(json.dumps(r) for r in rows or [{"run_key": run_key}])
    return once.put_if_absent(spark, f"{folder}/{hashlib.sha256(run_key.encode()).hexdigest()}.json", text)


def read_configs(spark: SparkSession, folder: str) -> DataFrame:
    """(run_key, name, value) of all runs stored below the folder."""
    if not once.names_in(spark, folder):
        return spark.createDataFrame([], CONFIG_SCHEMA)
    return spark.read.schema(CONFIG_SCHEMA).json(folder).where(F.col("name").isNotNull())


def updated_rows(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """The table with the columns of ``changes`` replaced where the key matches and the new value is not null."""
    fresh = changes.withColumnsRenamed({c: f"_new_{c}" for c in changes.columns if c != key})
    joined = table.join(fresh, key, "left")
    return joined.select(
        *[F.coalesce(f"_new_{c}", c).alias(c) if c != key and c in changes.columns else F.col(c) for c in table.columns]
    )
