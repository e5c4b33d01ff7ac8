"""Missing labels and missing features. Statistics are fitted on training rows only."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.functions.sizing import broadcast_if_small
from panelwright.operators import order_stats
from panelwright.session import durable

# Method names and the seed.
ZEROS, ONES = "impute_allzeros", "impute_allones"
RANDOM, WITH_PROBABILITY = "impute_random", "impute_wprob"
MEAN, MEDIAN, MODE = "impute_mean", "impute_median", "impute_mode"
SEED = 20171107
BOROUGH = "internal_borough_factor_static"
_KIND = {MEAN: "mean", MEDIAN: "median", MODE: "mode"}


def uniform(keys: Sequence[str], seed: int = SEED) -> Column:
    """A number in [0, 1) from the row's key and a seed, by 48 bits of an MD5: the same on any partitioning and in any engine."""
    text = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys], F.lit(str(seed)))
    return F.conv(F.left(F.md5(text), F.lit(12)), 16, 10).cast("bigint") / F.lit(float(1 << 48))


def impute_labels(
    df: DataFrame, label: str, method: str, keys: Sequence[str] = ("address_id", "month_start"), p: float | None = None,
    seed: int = SEED,
) -> DataFrame:
    """Add {label}_imputed and {label}_imputed_flag (1 where the label was missing)."""
    if method == WITH_PROBABILITY and p is None:
        raise ValueError("impute_wprob needs p")
    fills = {
        ZEROS: F.lit(0),
        ONES: F.lit(1),
        RANDOM: (uniform(keys, seed) < 0.5).cast("int"),
        WITH_PROBABILITY: (uniform(keys, seed) < F.lit(p)).cast("int"),
    }
    value = F.coalesce(F.col(label), fills[method]) if method in fills else F.col(label)
    return df.select(
        "*", value.alias(f"{label}_imputed"), F.col(label).isNull().cast("int").alias(f"{label}_imputed_flag")
    )


def columns_with_nulls(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: per column 1 if any value is missing. One pass for all columns."""
    return df.agg(*[F.max(F.col(c).isNull().cast("int")).alias(c) for c in columns])


def missing_features(df: DataFrame, columns: Sequence[str]) -> list[str]:
    row = columns_with_nulls(df, columns).first()
    return [c for c in columns if row[c] == 1]


def fit_group_stats(train: DataFrame, methods: Mapping[str, str], group: str = BOROUGH) -> DataFrame:
    """One row per group value with column {feature} = the group's statistic, 0 where the group has none.

    ``methods`` is {feature: method}. Means come from one aggregate; medians and modes from value counts,
    exact and without holding a group in memory. The result is stored, as it is used for train and test.
    """
    wanted = {f: m for f, m in methods.items() if m in _KIND}
    rows = train.where(F.col(group).isNotNull())
    averaged = [f for f, m in wanted.items() if m == MEAN]
    counted = [f for f, m in wanted.items() if m != MEAN]
    stats = rows.groupBy(group).agg(F.count(F.lit(1)).alias("_n"), *[F.avg(f).alias(f) for f in averaged])
    if counted:
        counts = durable(order_stats.value_counts(rows, [group], counted))
        found = order_stats.modes(counts, [group])
        if any(wanted[f] == MEDIAN for f in counted):
            found = found.join(order_stats.medians(counts, [group]), [group, "feature"], "full")
        value = {f: F.max(F.when(F.col("feature") == f, F.col(_KIND[wanted[f]]))).alias(f) for f in counted}
        stats = stats.join(found.groupBy(group).agg(*value.values()), group, "left")
    return durable(stats.select(group, *[F.coalesce(F.col(f), F.lit(0.0)).alias(f) for f in wanted]))


def impute_features(df: DataFrame, stats: DataFrame, methods: Mapping[str, str], group: str = BOROUGH) -> DataFrame:
    """Fill missing features of train or test rows from fitted group statistics.

    A group unseen in training keeps its missing values; rows without a group fall back to 0.
    """
    grouped = [f for f, m in methods.items() if m in _KIND]
    side = broadcast_if_small(stats.select(group, *[F.col(f).alias(f"_stat_{f}") for f in grouped]))
    joined = df.join(side, group, "left") if grouped else df

    def filled(name: str) -> Column:
        method = methods.get(name)
        if method in _KIND:
            fallback = F.when(F.col(group).isNull(), F.lit(0.0))
            return F.coalesce(F.col(name).cast("double"), F.col(f"_stat_{name}"), fallback).alias(name)
        if method == ZEROS:
            return F.coalesce(F.col(name), F.lit(0)).alias(name)
        if method == ONES:
            return F.coalesce(F.col(name), F.lit(1)).alias(name)
        return F.col(name)

    return joined.select(*[filled(c) for c in df.columns])


def methods_by_class(
    classes: DataFrame, features: Sequence[str], missing: Sequence[str], binary_method: str, continuous_method: str
) -> dict[str, str]:
    """{feature: method} for features with missing values, by column class (binary or continuous)."""
    kind = {r.column_name: r.var_type for r in classes.select("column_name", "var_type").collect()}
    by_class = {"binary": binary_method, "continuous": continuous_method}
    return {f: by_class[kind[f]] for f in features if f in set(missing) and kind.get(f) in by_class}
