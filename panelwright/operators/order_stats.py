"""Exact medians, quantiles and modes per group, for groups of any size.

The exact percentile aggregate keeps every distinct value of a group in one buffer. Here equal
values are counted first (combined on the map side), running counts are taken over the distinct
values with a distributed prefix sum, and the rows at the wanted positions are picked.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.operators.prefix import running_totals


def value_counts(df: DataFrame, group: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Long form (group, feature, value, n) of the non-null values of numeric features."""
    wide = df.select(*group, *[F.col(f).cast("double").alias(f) for f in features])
    long = wide.unpivot(list(group), list(features), "feature", "value").where(F.col("value").isNotNull())
    return long.groupBy(*group, "feature", "value").agg(F.count(F.lit(1)).alias("n"))


def modes(counts: DataFrame, group: Sequence[str]) -> DataFrame:
    """Most frequent value per (group, feature); the smallest one on ties."""
    best = F.max(F.struct(F.col("n"), (-F.col("value")).alias("negated")))
    return counts.groupBy(*group, "feature").agg(best.alias("best")).select(
        *group, "feature", (F.lit(0.0) - F.col("best.negated")).alias("mode")
    )


def quantiles(counts: DataFrame, group: Sequence[str], q: float | Mapping[str, float], name: str = "quantile") -> DataFrame:
    """Quantile per (group, feature) with linear interpolation between the two nearest values; a column each for {name: q}.

    Running counts are made once for all of them: the value at a position is the least one whose running count lies above it.
    """
    wanted = q if isinstance(q, Mapping) else {name: q}
    keys = [*group, "feature"]
    placed = running_totals(counts, keys, [F.col("value")], {"upto": F.col("n")}, {"total": F.col("n")})
    parts = []
    for i, share in enumerate(wanted.values()):
        position = (F.col("total") - 1) * F.lit(float(share))
        for side, place in (("low", F.floor(position)), ("high", F.ceil(position))):
            parts.append(F.min(F.when(F.col("upto") > place, F.col("value"))).alias(f"_{side}_{i}"))
        parts.append(F.max(position - F.floor(position)).alias(f"_share_{i}"))
    picked = placed.groupBy(*keys).agg(*parts)
    between = lambda i: F.col(f"_low_{i}") + (F.col(f"_high_{i}") - F.col(f"_low_{i}")) * F.col(f"_share_{i}")
    return picked.select(*keys, *[between(i).alias(n) for i, n in enumerate(wanted)])


def medians(counts: DataFrame, group: Sequence[str]) -> DataFrame:
    return quantiles(counts, group, 0.5, "median")


def label_quantile(train: DataFrame, label: str, q: float) -> float | None:
    """Quantile of one label over the training rows; one number."""
    row = quantiles(value_counts(train, [], [label]), [], q).first()
    return None if row is None else row["quantile"]


def label_over_quantile(df: DataFrame, label: str, threshold: float | None, name: str | None = None) -> DataFrame:
    """0/1 label: above the training quantile or not; null stays null."""
    over = F.when(F.col(label).isNull(), None).otherwise((F.col(label) > F.lit(threshold)).cast("int"))
    return df.withColumn(name or f"{label}_binary", over)
