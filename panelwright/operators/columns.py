"""Column names: clean-up, feature lists by pattern, classes by name and type, common features.

Names are schema, not data: they live in plain lists and only steer projections.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Name patterns of the feature families, and of the column classes.
FEATURE_PATTERNS = {
    "internal_all": "^internal.*",
    "internal_static": "^internal.*static",
    "internal_continuous_labels": "^internal.*count_next.*",
    "internal_binary_labels": "^internal.*any_next.*",
    "internal_lagged_labels": ".*cases.*this.*|.*knocks.*this.*|.*opens.*this.*",
    "hpd": "^hpd.*",
    "housing_litigation": "^housinglitig.*",
    "pluto": "^pluto.*",
    "acs_all": "^acs_tract_.*",
    "acs_percent": "^acs_tract_percent.*",
    "misc": "^subs|^rent.*",
}
SHIELDED = ["month_year_tomerge_exact", "year_tomerge_rounded", "address_id"]
CALENDAR = ["month_start", "month_end", "month", "year"]
STATIC_LEFT_OUT = ["bbl", "bin", "county", "census_block_group", "census_block", "census_tract"]
RATIO_LABELS = [
    "internal_cases_opened_per_unit_next_month",
    "internal_cases_opened_per_open_next_month",
    "internal_cases_opened_per_knock_next_month",
]
BINARY_NAMES = ".*_any.*|.*sp_.*|.*team.*|.*borough.*|internal_rent_stabilized_.*|.*heating_season.*|.*peu_target.*|.*bldg_wide.*|.*flag.*"
FACTOR_NAMES = ".*factor.*"
LABEL_NAMES = ".*next_month"
CHARACTER_NAMES = ".*tract$|.*tract_static$"
WHOLE_NUMBERS = ["integer", "bigint", "numeric"]
TEXT_TYPES = ["character varying", "text"]


def unique_names(names: Iterable[str]) -> list[str]:
    """Lower case; a name seen before gets the first free suffix _1, _2, …"""
    out: list[str] = []
    taken: set[str] = set()
    for name in names:
        base = name.lower()
        pick = next(c for c in _suffixed(base) if c not in taken)
        taken.add(pick)
        out.append(pick)
    return out


def _suffixed(base: str):
    yield base
    n = 0
    while True:
        n += 1
        yield f"{base}_{n}"


def with_unique_names(df: DataFrame) -> DataFrame:
    return df.toDF(*unique_names(df.columns))


def mark_static(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rename the given columns with the suffix _static."""
    return df.withColumnsRenamed({n: f"{n}_static" for n in names})


def matching(names: Iterable[str], pattern: str) -> list[str]:
    return [n for n in names if re.search(pattern, n)]


def combine(lists: Mapping[str, Sequence[str]], keys: Sequence[str]) -> list[str]:
    """The named lists one after another."""
    return [name for key in keys for name in lists[key]]


def without(names: Iterable[str], other: Iterable[str]) -> list[str]:
    drop = set(other)
    return [n for n in dict.fromkeys(names) if n not in drop]


def feature_lists(
    columns: Sequence[str], shielded: Sequence[str] = SHIELDED, patterns: Mapping[str, str] = FEATURE_PATTERNS
) -> dict[str, list[str]]:
    """All named feature lists for a set of columns, with the combined ones."""
    ready = without(columns, shielded)
    lists = {name: matching(ready, pattern) for name, pattern in patterns.items()}
    labels = combine(lists, ["internal_binary_labels", "internal_continuous_labels", "internal_lagged_labels"])
    lists["internal_dynamic_nolabels_orlaggedlabels"] = without(
        without(lists["internal_all"], lists["internal_static"]), labels
    )
    lists["allfeatures_nolabels_orlaggedlabels"] = without(without(ready, labels), CALENDAR)
    lists["external_violations"] = combine(lists, ["hpd", "housing_litigation"])
    lists["internal_static"] = without(lists["internal_static"], [f"internal_{n}_static" for n in STATIC_LEFT_OUT])
    lists["internal_only"] = combine(lists, ["internal_static", "internal_lagged_labels"])
    lists["all_external"] = combine(lists, ["external_violations", "pluto", "misc", "acs_all"])
    lists["all_features_minusACS"] = without(
        combine(lists, ["allfeatures_nolabels_orlaggedlabels", "internal_lagged_labels"]), lists["acs_all"]
    )
    lists["internal_ratio_labels"] = list(RATIO_LABELS)
    return lists


def deep_dive_list(lists: Mapping[str, Sequence[str]], tract_columns: Sequence[str]) -> list[str]:
    """The widest hand-made list: buildings, violations, own records and chosen tract columns."""
    names = combine(lists, ["pluto", "external_violations", "internal_only"])
    return [*names, "subsidized_housing_flag_static", "internal_cases_opened_count_ever", *tract_columns]


def list_table(spark, lists: Mapping[str, Sequence[str]]) -> DataFrame:
    """Feature lists as (list_name, position, column) rows, the stored form."""
    rows = [(name, i, c) for name, columns in lists.items() for i, c in enumerate(columns)]
    return spark.createDataFrame(rows, "list_name string, position int, column string")


def column_table(df: DataFrame) -> DataFrame:
    """(column_name, data_type) of a DataFrame, with the SQL type names the classes are defined on."""
    names = {"string": "text", "int": "integer", "smallint": "integer", "tinyint": "integer", "double": "double precision",
             "float": "double precision", "timestamp_ntz": "timestamp"}
    rows = [(n, "numeric" if t.startswith("decimal") else names.get(t, t)) for n, t in df.dtypes]
    return df.sparkSession.createDataFrame(rows, "column_name string, data_type string")


def classify_columns(table: DataFrame) -> DataFrame:
    """Add var_type: continuous, character, date, label or binary; null for other types."""
    name, kind = F.col("column_name"), F.col("data_type")

    def like(pattern: str) -> Column:
        return name.rlike(f"^(?:{pattern})")

    binary = like(BINARY_NAMES) & ~like(FACTOR_NAMES) & ~like(LABEL_NAMES) & ~like(CHARACTER_NAMES)
    whole = (
        F.when(like(LABEL_NAMES), "label")
        .when(binary, "binary")
        .when(like(CHARACTER_NAMES), "character")
        .otherwise("continuous")
    )
    return table.withColumn(
        "var_type",
        F.when(kind == "double precision", "continuous")
        .when(kind.isin(TEXT_TYPES), "character")
        .when(kind == "date", "date")
        .when(kind.isin(WHOLE_NUMBERS), whole),
    )


def names_of_class(classes: DataFrame, var_type: str) -> list[str]:
    """Column names of one class; one row per column of a schema."""
    return [r.column_name for r in classes.where(F.col("var_type") == var_type).select("column_name").collect()]


def common_features(
    train_names: Sequence[str], test_names: Sequence[str], present: Sequence[str], excluded: Sequence[str] = ()
) -> list[str]:
    """Names in train and test, also present in the training frame, without commas, without the excluded."""
    both = set(test_names) & set(present)
    return [n for n in without(train_names, excluded) if n in both and "," not in n]


def model_columns(
    df: DataFrame, label: str, features: Sequence[str], keys: Sequence[str] = ("address_id", "month_start")
) -> DataFrame:
    """Keys, label and features only: the scan reads nothing else."""
    return df.select(*dict.fromkeys([*keys, label, *features]))
