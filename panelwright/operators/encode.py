"""Categorical levels: frequent ones kept, the rest pooled, then 0/1 columns or places in a sparse vector.

Columns are meant for the few levels that a threshold leaves. Where levels are many, number_levels and encode_sparse keep them as
rows of a table and meet them in joins, whatever their number.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.functions.sizing import bounded_rows, broadcast_if_small
from panelwright.operators.prefix import running_totals
from panelwright.session import durable

# Names of the level for missing values and of the pooled level.
MISSING, OTHER = "missing", "OTHER"
ENTITY = "address_id"
MAX_PLACES = 5_000_000


def known_level(feature: str) -> Column:
    return F.coalesce(F.col(feature).cast("string"), F.lit(MISSING))


def level_counts(df: DataFrame, features: Sequence[str], entity: str = ENTITY) -> DataFrame:
    """Entities per (feature, level), missing values as a level of their own."""
    levels = df.select(entity, *[known_level(f).alias(f) for f in features])
    long = levels.unpivot([entity], list(features), "feature", "level").distinct()
    return long.groupBy("feature", "level").agg(F.count(F.lit(1)).alias("entities"))


def fit_levels(train: DataFrame, features: Sequence[str], threshold: int, entity: str = ENTITY) -> DataFrame:
    """(feature, level, entities) of the levels at or above the threshold."""
    return level_counts(train, features, entity).where(F.col("entities") >= threshold)


def levels_by_feature(levels: DataFrame) -> dict[str, list[str]]:
    """Fitted levels as lists, for encodings with a column per level."""
    out: dict[str, list[str]] = {}
    for row in levels.select("feature", "level").toLocalIterator():
        out.setdefault(row.feature, []).append(row.level)
    return {f: sorted(v) for f, v in out.items()}


def dummy_names(kept: dict[str, Sequence[str]]) -> dict[tuple[str, str], str]:
    """(feature, level) -> column name {feature}_{level}; dots and backticks, which a plain column name cannot hold, become underscores.

    Names that would then meet get a number, in the order of features and levels.
    """
    names: dict[tuple[str, str], str] = {}
    taken: set[str] = set()
    for feature, levels in kept.items():
        for level in levels:
            base = name = re.sub("[.`]", "_", f"{feature}_{level}")
            number = 2
            while name.lower() in taken:
                name, number = f"{base}_{number}", number + 1
            taken.add(name.lower())
            names[feature, level] = name
    return names


def number_levels(levels: DataFrame) -> DataFrame:
    """(feature, level, place): a place from 0 for each level, by a distributed running count in the order of feature and level."""
    rows = levels.select("feature", "level").distinct()
    numbered = running_totals(rows, [], [F.col("feature"), F.col("level")], row_number="_number")
    return numbered.select("feature", "level", (F.col("_number") - 1).cast("long").alias("place"))


def encode_sparse(df: DataFrame, numbered: DataFrame, features: Sequence[str], key: str, out: str = "places") -> DataFrame:
    """df with the sorted places of its rows' levels, an array as long as the features at most: a sparse vector of any width.

    Levels without a place give none. ``key`` identifies a row of df; levels are met in one join, broadcast if small.
    """
    long = df.select(key, *[known_level(f).alias(f) for f in features]).unpivot([key], list(features), "feature", "level")
    placed = long.join(broadcast_if_small(durable(numbered)), ["feature", "level"])
    rows = placed.groupBy(key).agg(F.sort_array(F.collect_list("place")).alias(out))
    return df.join(rows, key, "left").withColumn(out, F.coalesce(out, F.array().cast("array<bigint>")))


def level_places(numbered: DataFrame, most: int = MAX_PLACES) -> list[tuple[str, str]]:
    """(feature, level) in the order of their places. As many as a model's weights, which the driver holds as well; more than ``most`` is an error."""
    rows = bounded_rows(numbered.select("feature", "level", "place"), most, "levels")
    return [(r["feature"], r["level"]) for r in sorted(rows, key=lambda r: r["place"])]


def level_vector(df: DataFrame, places: Sequence[tuple[str, str]], features: Sequence[str], out: str = "levels") -> DataFrame:
    """df with a sparse vector of its rows' levels, 1 at the place of each known one: input for any model, beside the rows, without a join.

    A level without a place gives no entry: the pooled level is the one that all zeros stand for.
    """
    word = lambda f, level: F.concat(F.lit(f"{len(f)}:{f}="), level)
    words = F.array(*[word(f, known_level(f)) for f in features])
    counter = CountVectorizerModel.from_vocabulary([f"{len(f)}:{f}={v}" for f, v in places] or [""], inputCol="_words", outputCol=out)
    return counter.setBinary(True).transform(df.withColumn("_words", words)).drop("_words")


def pooled(feature: str, kept: Sequence[str]) -> Column:
    """The level where it was kept, else OTHER; missing is a level like any other."""
    return F.when(known_level(feature).isin(list(kept)), known_level(feature)).otherwise(OTHER)


def recode(df: DataFrame, kept: dict[str, list[str]], features: Sequence[str]) -> DataFrame:
    """Replace each feature by its pooled level."""
    return df.select(*[pooled(c, kept.get(c, [])).alias(c) if c in features else F.col(c) for c in df.columns])


def recode_by_join(df: DataFrame, levels: DataFrame, feature: str) -> DataFrame:
    """Pooled level for a feature whose kept levels are too many for columns: a left join on the level."""
    kept = broadcast_if_small(durable(levels.where(F.col("feature") == feature).select(F.col("level").alias("_level"))))
    joined = df.withColumn("_value", known_level(feature)).join(kept, F.col("_value") == F.col("_level"), "left")
    value = F.when(F.col("_level").isNull(), OTHER).otherwise(F.col("_value"))
    return joined.select(*[value.alias(c) if c == feature else F.col(c) for c in df.columns])


def level_dummies(df: DataFrame, kept: dict[str, list[str]], features: Sequence[str]) -> DataFrame:
    """0/1 columns {feature}_{level} for every kept level and OTHER, the same for train and test."""
    wanted = {f: list(dict.fromkeys([*kept.get(f, []), OTHER])) for f in features}
    made = [(pooled(f, kept.get(f, [])) == v).cast("int").alias(name) for (f, v), name in dummy_names(wanted).items()]
    return df.select("*", *made)


def common_levels(train: DataFrame, test: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, level) seen in train and in test; nulls are no level."""

    def seen(df: DataFrame) -> DataFrame:
        wide = df.select(*[F.col(f).cast("string").alias(f) for f in features])
        long = wide.unpivot([], list(features), "feature", "level").where(F.col("level").isNotNull())
        # Distinct first: the intersection then meets each level once, however many rows carry it.
        return long.distinct()

    return seen(train).intersect(seen(test))


def one_hot(df: DataFrame, common: dict[str, list[str]]) -> DataFrame:
    """Add a 0/1 column per common level; null gives all zeros."""
    return df.select(
        "*",
        *[
            F.coalesce((F.col(f).cast("string") == v).cast("int"), F.lit(0)).alias(name)
            for (f, v), name in dummy_names(common).items()
        ],
    )


def attach_by_entity(long: DataFrame, encoded: DataFrame, entity: str = ENTITY) -> DataFrame:
    """Left-join encoded columns back to long rows; encoded must have one row per entity."""
    return long.join(encoded, entity, "left")
