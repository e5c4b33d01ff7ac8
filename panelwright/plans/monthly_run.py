"""The whole run: panel, split, features, fit, score, rank, evaluate; one call per split or a list of them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.operators import columns, evaluate, impute, models, scale, splits
from panelwright.session import durable
from panelwright.sources import tables


@dataclass
class SplitResult:
    """Result rows of one model on one split, ready to append."""

    predictions: DataFrame
    importances: DataFrame
    evaluations: DataFrame


UNSEEN = "group_unseen"
_KEPT = "_kept_"


def prepared(train: DataFrame, test: DataFrame, features: Sequence[str], binary: str = impute.ZEROS,
             continuous: str = impute.MEAN) -> tuple[DataFrame, DataFrame]:
    """Impute what is missing in either part, by column class, and scale, all with statistics of the training part.

    A row whose group has no statistic (its group was not in train) falls back to 0 for what it misses and is flagged in ``group_unseen``.
    """
    classes = columns.classify_columns(columns.column_table(train))
    missing = list(dict.fromkeys([*impute.missing_features(train, features), *impute.missing_features(test, features)]))
    methods = impute.methods_by_class(classes, features, missing, binary, continuous)
    stats = impute.fit_group_stats(train, methods)

    def filled(part: DataFrame) -> DataFrame:
        rows = impute.impute_features(part, stats, methods)
        gaps = [F.col(f).isNull() for f in features]
        flag = reduce(lambda a, b: a | b, gaps, F.lit(False)).cast("int").alias(UNSEEN)
        return rows.select(*[F.coalesce(F.col(c), F.lit(0)).alias(c) if c in features else F.col(c) for c in rows.columns], flag)

    parts = [filled(train), filled(test)]
    kinds = {r.column_name: r.var_type for r in classes.collect()}
    bounds = scale.fit_minmax(parts[0], [f for f in features if kinds.get(f) == "continuous"])
    return scale.minmax_scale(parts[0], bounds), scale.minmax_scale(parts[1], bounds)


def split_rows(
    panel: DataFrame,
    split,
    features: Sequence[str],
    label: str,
    months: int = 1,
    units: str = "internal_units_static",
    target: str = "internal_peu_target_zip",
) -> DataFrame:
    """What a split reads of a panel, in one pass: the labelled months before it, its test months in target areas, and the columns used.

    Most months of an entity have no label, so storing these rows is far less than storing the panel.
    """
    month, first = F.col("month_start"), F.lit(str(split)).cast("date")
    train = (month < first) & F.col(label).isNotNull()
    test = (month >= first) & (month < F.add_months(first, months)) & (F.col(target) == 1)
    return panel.where(train | test).select(*dict.fromkeys(["address_id", "month_start", impute.BOROUGH, units, label, target, *features]))


def prepared_split(
    panel: DataFrame,
    split,
    features: Sequence[str],
    label: str,
    months: int = 1,
    units: str = "internal_units_static",
    train_start=None,
) -> tuple[DataFrame, DataFrame]:
    """Stored train and test rows of a split, ready for any number of models.

    Kept columns lie beside the features under names of their own, so a column that is both is kept raw and prepared as well.
    """
    keep = ["address_id", "month_start", impute.BOROUGH, units, label]
    kept = [F.col(c).alias(_KEPT + c) for c in keep]
    needed = list(dict.fromkeys([label, impute.BOROUGH, *features]))
    train = splits.train_rows(panel, split, label, train_start).select(*needed, *kept)
    test = splits.test_rows(panel, split, months).select(*needed, *kept)
    train, test = prepared(train, test, list(features))
    return durable(train), durable(test)


def fit_prepared(
    parts: tuple[DataFrame, DataFrame],
    split,
    features: Sequence[str],
    label: str,
    model_id: int,
    algorithm: str,
    parameters: Mapping | None,
    top_k,
    boroughs: Sequence[str] = (),
    units: str = "internal_units_static",
) -> SplitResult:
    """One model on prepared parts. ``top_k`` is a capacity or a list of them; predictions and metrics have rows for each."""
    train, test = parts
    model = models.fit(train, features, label, algorithm, parameters)
    named = [c for c in test.columns if c.startswith(_KEPT)]
    scored = models.score(model, test, [*named, UNSEEN])
    scored = durable(scored.withColumnsRenamed({c: c.removeprefix(_KEPT) for c in named}))
    every_k = list(top_k) if isinstance(top_k, (list, tuple)) else [top_k]
    ranked = models.prediction_rows(scored, model_id, label, f"train_split_{split}", every_k[0], boroughs)
    # Ranks do not depend on k: the rows are ranked once and repeated for each.
    repeated = F.explode(F.array(*[F.lit(k).cast("long") for k in every_k])).alias("top_k")
    predictions = ranked.select(*[repeated if c == "top_k" else F.col(c) for c in ranked.columns])
    importance = models.importance_rows(models.importances(train.sparkSession, model, features), model_id)
    rows = scored.selectExpr(
        f"cast({model_id} as bigint) as model_id", "month_start as as_of_date", "address_id as entity_id", "score",
        f"cast({units} as int) as units", f"{label} as label",
    )
    metrics = evaluate.metrics_at_k(rows, "label", top_k)
    return SplitResult(predictions, importance, evaluate.metric_rows(metrics, test_matrix=f"test_split_{split}"))


def run_split(
    panel: DataFrame,
    split,
    features: Sequence[str],
    label: str,
    model_id: int,
    algorithm: str,
    parameters: Mapping | None = None,
    *,
    top_k,
    boroughs: Sequence[str] = (),
    months: int = 1,
    units: str = "internal_units_static",
    train_start=None,
) -> SplitResult:
    """Fit one model on one split and give its result rows; only model-sized values reach the driver. The capacity has no default."""
    parts = prepared_split(panel, split, features, label, months, units, train_start)
    return fit_prepared(parts, split, features, label, model_id, algorithm, parameters, top_k, boroughs, units)


def store_result(result: SplitResult, folder: str) -> None:
    """Append the result rows to the results tables below a folder, dated ones partitioned by date."""
    tables.append_rows(result.predictions, f"{folder}/predictions")
    tables.append_rows(result.importances, f"{folder}/feature_importances")
    tables.append_rows(result.evaluations, f"{folder}/evaluations")


def run_models(panel: DataFrame, split_list: Sequence, model_list: Sequence[Mapping], features: Sequence[str], label: str,
               first_id: int = 1, *, top_k, boroughs: Sequence[str] = (), months: int = 1, units: str = "internal_units_static",
               train_start=None):
    """Models x splits, one result at a time. A split is prepared and stored once for all models; ids count splits within models."""
    for at, split in enumerate(split_list):
        parts = prepared_split(panel, split, features, label, months, units, train_start)
        for nth, spec in enumerate(model_list):
            model_id = first_id + nth * len(split_list) + at
            yield fit_prepared(parts, split, features, label, model_id, spec["algorithm"], spec.get("parameters"), top_k, boroughs, units)
