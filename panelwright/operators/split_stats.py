"""Statistics of the training rows of all splits in one job, from sketches of months.

A month's sketch is its exact value counts per group and feature. Sketches add up, and a split trains on a prefix of months: its counts are
running sums over months, one column a split. So the panel is read once whatever the number of splits, and a later month adds its own sketch
to the stored ones; no split reads its training rows again. Mean, median, mode, bounds and any quantiles come from the counts, exactly.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.operators import encode, order_stats
from panelwright.operators.panel import MONTH
from panelwright.operators.prefix import running_totals
from panelwright.session import durable
from panelwright.sources import tables

MEDIAN = {"median": 0.5}


def month_sketch(panel: DataFrame, group: str, features: Sequence[str], label: str | None = None, month: str = MONTH) -> DataFrame:
    """(month, group, feature, value, n): exact value counts of each month; with a label named, of rows where it is known. Rows without a group are left out."""
    rows = panel.where(F.col(group).isNotNull())
    rows = rows if label is None else rows.where(F.col(label).isNotNull())
    return order_stats.value_counts(rows, [month, group], features)


def store_sketch(sketch: DataFrame, name: str, month: str = MONTH) -> None:
    """Write the sketches of the months that df holds, in place of older ones of these months; all other months stay."""
    tables.replace_splits(sketch, name, month)


def _in_split(split, month: str, through_split: bool) -> Column:
    day = F.lit(str(split)).cast("date")
    return F.col(month) <= day if through_split else F.col(month) < day


def split_statistics(
    sketch: DataFrame, splits: Sequence, group: str, quantiles: Mapping[str, float] | None = None, through_split: bool = False, month: str = MONTH
) -> DataFrame:
    """(split_date, group, feature, n, mean, min, max, mode, and a column per quantile) over the months before each split.

    The smallest of equally frequent values is the mode. A split without a value of a feature in a group has no row.
    """
    quantiles = MEDIAN if quantiles is None else quantiles
    days = {str(s): f"_n{i}" for i, s in enumerate(splits)}
    counted = [F.sum(F.when(_in_split(d, month, through_split), F.col("n")).otherwise(0)).alias(c) for d, c in days.items()]
    # A row per value from here on; each split is a column, so running counts over values are made once for all splits.
    wide = sketch.groupBy(group, "feature", "value").agg(*counted)
    wide = wide.where(reduce(lambda a, b: a | b, [F.col(c) > 0 for c in days.values()]))
    own = {f"upto{c}": F.col(c) for c in days.values()}
    placed = running_totals(wide, [group, "feature"], [F.col("value")], own, {f"total{c}": F.col(c) for c in days.values()})
    found = []
    for c in days.values():
        n, total, upto = F.col(c), F.col(f"total{c}"), F.col(f"upto{c}")
        there = n > 0
        parts = {
            "n": F.max(total),
            "mean": F.try_divide(F.sum(n * F.col("value")), F.max(total)),
            "min": F.min(F.when(there, F.col("value"))),
            "max": F.max(F.when(there, F.col("value"))),
            "mode": F.lit(0.0) - F.max(F.when(there, F.struct(n.alias("n"), (-F.col("value")).alias("negated"))))["negated"],
        }
        for name, q in quantiles.items():
            position = (total - 1) * F.lit(float(q))
            low = F.min(F.when(upto > F.floor(position), F.col("value")))
            high = F.min(F.when(upto > F.ceil(position), F.col("value")))
            parts[name] = low + (high - low) * F.max(position - F.floor(position))
        found.append(F.struct(*[v.alias(k) for k, v in parts.items()]).alias(c))
    long = placed.groupBy(group, "feature").agg(*found).withColumnsRenamed({c: d for d, c in days.items()})
    long = long.unpivot([group, "feature"], list(days), "split_date", "found").where("found.n > 0")
    return long.select(F.col("split_date").cast("date").alias("split_date"), group, "feature", "found.*")


def group_stats_of(stats: DataFrame, split, methods: Mapping[str, str], group: str) -> DataFrame:
    """One split's statistics in the form that impute_features takes: a row per group, a column per feature, 0 where a group has none.

    ``methods`` is {feature: column of split_statistics}.
    """
    rows = stats.where(F.col("split_date") == F.lit(str(split)).cast("date"))
    value = {f: F.max(F.when(F.col("feature") == f, F.col(m))) for f, m in methods.items()}
    return durable(rows.groupBy(group).agg(*[F.coalesce(v, F.lit(0.0)).alias(f) for f, v in value.items()]))


def split_levels(panel: DataFrame, splits: Sequence, features: Sequence[str], entity: str = encode.ENTITY, through_split: bool = False, month: str = MONTH) -> DataFrame:
    """(split_date, feature, level, entities): level counts of every split's training rows. An entity counts for a level from its first month with it on."""
    rows = panel.select(entity, month, *[encode.known_level(f).alias(f) for f in features])
    long = rows.unpivot([entity, month], list(features), "feature", "level")
    first = long.groupBy(entity, "feature", "level").agg(F.min(month).alias(month))
    sketch = first.groupBy("feature", "level", month).agg(F.count(F.lit(1)).alias("n"))
    days = [str(s) for s in splits]
    sums = [F.sum(F.when(_in_split(d, month, through_split), F.col("n"))).alias(d) for d in days]
    long = sketch.groupBy("feature", "level").agg(*sums).unpivot(["feature", "level"], days, "split_date", "entities")
    return long.where("entities is not null").select(F.col("split_date").cast("date").alias("split_date"), "feature", "level", "entities")
