"""Evaluations to comparisons: clean, widen, rate, and rank models across months."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions.scalars import guarded_ratio, model_key, ratio
from panelwright.operators.evaluate import CAPACITY_SHARES

# The default label and borough set, and the metric names that become columns.
DEFAULT_LABEL = "internal_cases_opened_any_next_month"
DEFAULT_BOROUGHS = "Bronx_Queens_Staten Island_Brooklyn_Manhattan"
OLDER_KEYS = ["model_group_id", "borough_predicted_for", "borough_fit_on", "test_set_month", "metric", "top_k"]
NEWER_KEYS = ["model_group_id", "test_set_month", "metric", "top_k"]
OLDER_METRICS = {
    "precision_baseline": "precision_baseline",
    "precision_no_imputed": "precision_no_imputed",
    "recall_of_0_all": "recall_of_0",
    "recall_not_imputed": "recall_of_1",
}
NEWER_METRICS = {
    "confusion_false_negative_no_impute": "confusion_fn",
    "confusion_false_positive_no_impute": "confusion_fp",
    "confusion_true_negative_no_impute": "confusion_tn",
    "confusion_true_positive_no_impute": "confusion_tp",
    "precision_baseline": "precision_baseline",
    "precision_no_imputed": "precision_at_k",
    "recall_not_imputed": "recall_of_1",
}
MODEL = ["algorithm_type", "hyperparameters", "model_and_hyp"]


def evaluation_view(evaluations: DataFrame, models: DataFrame, groups: DataFrame) -> DataFrame:
    """Evaluations with their model and model group."""
    return evaluations.join(models, "model_id").join(groups, "model_group_id")


def pick_evaluations(
    view: DataFrame,
    ids: Sequence[int] | None = None,
    low: int | None = None,
    high: int | None = None,
    label: str = DEFAULT_LABEL,
    boroughs: str = DEFAULT_BOROUGHS,
) -> DataFrame:
    """Evaluations of listed model ids, or of an id range that is open where no bound is given, for one label and borough set."""
    mine = F.col("model_id").isin(list(ids)) if ids is not None else F.lit(True)
    for bound, holds in ((low, F.col("model_id") >= low), (high, F.col("model_id") <= high)) if ids is None else ():
        mine = mine & holds if bound is not None else mine
    return view.where(mine & (F.col("label") == label) & (F.col("borough_fit_on") == boroughs))


def drop_older(data: DataFrame, keys: Sequence[str], newest: str = "model_id") -> DataFrame:
    """One row per key set, from the newest model; of several rows of that model the first by the remaining columns."""
    rest = [c for c in data.columns if c not in (*keys, newest)]
    w = Window.partitionBy(*keys).orderBy(F.desc(newest), *rest)
    # The = 1 filter lets Spark cut each group before the shuffle.
    return data.withColumn("_place", F.row_number().over(w)).where(F.col("_place") == 1).drop("_place")


def clean_results_older(data: DataFrame, min_feature_list_length: int, metrics: Sequence[str]) -> DataFrame:
    kept = drop_older(data, OLDER_KEYS).where(
        (F.length("feature_list") > min_feature_list_length) & F.col("metric").isin(list(metrics))
    )
    return kept.select(
        "algorithm_type",
        "hyperparameters",
        model_key("algorithm_type", "hyperparameters", "").alias("model_and_hyp"),
        "metric",
        "value",
        "top_k",
        "training_end_date",
        "model_id",
        "test_set_month",
        "borough_predicted_for",
        "borough_fit_on",
    )


def clean_results_newer(data: DataFrame, label: str = DEFAULT_LABEL) -> DataFrame:
    kept = drop_older(data, NEWER_KEYS).where(F.col("label") == label)
    return kept.select(
        "model_group_id", "model_id", "algorithm_type", "metric", "value", "top_k", "hyperparameters", "test_set_month",
        "feature_list",
    )


def widen(data: DataFrame, keys: Sequence[str], metrics: Mapping[str, str]) -> DataFrame:
    """One column per metric, named by metric and not by position; repeated values are averaged."""
    value = F.col("value").cast("double")
    return data.where(F.col("metric").isin(list(metrics))).groupBy(*keys).agg(
        *[F.avg(F.when(F.col("metric") == m, value)).alias(name) for m, name in metrics.items()]
    )


def capacity_share(rank: Column, shares: Sequence[float] = CAPACITY_SHARES) -> Column:
    """The share behind the n-th smallest k of a model; ranks behind the list stay as they are."""
    listed = F.array(*[F.lit(float(s)) for s in shares])
    return F.coalesce(F.get(listed, rank - 1), rank.cast("double"))


def wide_metrics_older(cleaned: DataFrame) -> DataFrame:
    """Wide metrics with the test month, the capacity share of each k, and both ratios."""
    keys = [*MODEL, "borough_fit_on", "borough_predicted_for", "training_end_date", "top_k", "model_id"]
    wide = widen(cleaned, keys, OLDER_METRICS).withColumnRenamed("training_end_date", "split_date")
    # One group holds the k values of one model: a handful of rows.
    per_model = Window.partitionBy(*MODEL, "split_date", "model_id", "borough_predicted_for", "borough_fit_on")
    rank = F.rank().over(per_model.orderBy(F.col("top_k").cast("double")))
    return wide.select(
        "*",
        F.add_months(F.col("split_date").cast("date"), 1).alias("test_set_month"),
        capacity_share(rank).alias("top_k_rank"),
        ratio("precision_no_imputed", "precision_baseline").alias("precision_ratio"),
        guarded_ratio("recall_of_1", "recall_of_0").alias("recall_ratio"),
    )


def wide_metrics_newer(cleaned: DataFrame) -> DataFrame:
    keyed = cleaned.withColumn("model_and_hyp", model_key("algorithm_type", "hyperparameters"))
    wide = widen(keyed, [*MODEL, "top_k", "model_id", "model_group_id", "test_set_month"], NEWER_METRICS)
    return wide.withColumn("precision_ratio", ratio("precision_at_k", "precision_baseline"))


def cut_by_month(wide: DataFrame, cutoff: str, month: str = "test_set_month") -> tuple[DataFrame, DataFrame]:
    """(validation, test): before the date, and from it on."""
    return wide.where(F.col(month) < cutoff), wide.where(F.col(month) >= cutoff)


def joined_values(data: DataFrame, by: str, value: Column, name: str) -> DataFrame:
    """Distinct values per group, sorted and joined with '; '."""
    return data.groupBy(by).agg(F.array_join(F.array_sort(F.collect_set(value.cast("string"))), "; ").alias(name))


def months_of(data: DataFrame, month: str = "test_set_month") -> DataFrame:
    return joined_values(data, "model_and_hyp", F.col(month), "test_set_months_all")


def model_ids_of(data: DataFrame) -> DataFrame:
    return joined_values(data, "model_and_hyp", F.col("model_id"), "model_id_all")


def best_rows(data: DataFrame, by: str, order: Column) -> DataFrame:
    """Rows that hold the group's first place; ties are kept."""
    w = Window.partitionBy(by).orderBy(order)
    return data.withColumn("_place", F.rank().over(w)).where(F.col("_place") == 1).drop("_place")


def best_models(
    wide: DataFrame,
    shares: Sequence[float],
    months: Sequence,
    metric: str = "precision_ratio",
    distinct_months: bool = False,
    month: str = "test_set_month",
) -> DataFrame:
    """Mean, min and max of a metric per model over months, with months, ids, best and worst month.

    Models with fewer rows than months are left out; distinct_months=True counts months instead of rows.
    A tie for the best or worst month gives one row per tied month.
    """
    picked = wide.where(F.col("top_k_rank").isin(list(shares)) & F.col(month).isin([str(m) for m in months]))
    seen = F.count_distinct(month) if distinct_months else F.count(F.lit(1))
    by = "model_and_hyp"
    stats = (
        picked.groupBy(by)
        .agg(
            seen.alias("_seen"),
            F.avg(metric).alias(f"{metric}_mean"),
            F.min(metric).alias(f"{metric}_min"),
            F.max(metric).alias(f"{metric}_max"),
            F.array_join(F.array_sort(F.collect_set(F.col(month).cast("string"))), "; ").alias("test_set_months_all"),
            F.array_join(F.array_sort(F.collect_set(F.col("model_id").cast("string"))), "; ").alias("model_id_all"),
        )
        .where(F.col("_seen") >= len(months))
        .drop("_seen")
    )
    rated = picked.where(F.col(metric).isNotNull())
    top = best_rows(rated, by, F.desc(metric)).select(
        by, F.col(month).cast("string").alias("testmonth_ofmax"), F.col("model_id").alias("modelid_ofmax")
    )
    low = best_rows(rated, by, F.asc(metric)).select(
        by, F.col(month).cast("string").alias("testmonth_ofmin"), F.col("model_id").alias("modelid_ofmin")
    )
    return stats.join(top.distinct(), by).join(low.distinct(), by)


def ordered_by_mean(summary: DataFrame, metric: str = "precision_ratio") -> DataFrame:
    """For showing: best mean first."""
    return summary.orderBy(F.desc(f"{metric}_mean"), "model_and_hyp")


# --- lookups behind maps and plots --------------------------------------------------------------------


def predictions_with_place(predictions: DataFrame, entities: DataFrame, model_id, columns: Sequence[str]) -> DataFrame:
    """One model's predictions with entity columns (units, coordinates)."""
    side = entities.select(F.col("address_id").alias("entity_id"), *columns)
    return predictions.where(F.col("model_id") == model_id).join(side, "entity_id", "left")


def predictions_of_models(predictions: DataFrame, panel: DataFrame, model_ids: Sequence, units: str) -> DataFrame:
    """Predictions of some models with units from the distinct (entity, units) rows of a panel."""
    side = panel.select(F.col("address_id").alias("entity_id"), units).distinct()
    return predictions.where(F.col("model_id").isin(list(model_ids))).join(side, "entity_id", "left")


def top_features(importances: DataFrame, model_id, below: int = 20) -> DataFrame:
    """A model's features ranked strictly above the threshold: below=20 shows 19 when ranks do not tie."""
    return importances.where((F.col("model_id") == model_id) & (F.col("rank_abs") < below)).orderBy("rank_abs", "feature")
