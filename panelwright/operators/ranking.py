"""Ranks by score, curves along the ranking, and the entities a capacity in units can reach.

A group is one model and month. All rankings order by score, then units, then entity id, so that
they are the same on any partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.operators.prefix import running_totals

GROUP = ("model_id", "as_of_date")


def by_score(score: str, units: str, entity: str) -> list[Column]:
    return [F.col(score).desc(), F.col(units).desc(), F.col(entity).asc()]


def with_ranks(
    df: DataFrame,
    group: Sequence[str] = GROUP,
    score: str = "score",
    rank: str = "rank_abs",
    share: str = "rank_pct",
    bounded: bool = False,
) -> DataFrame:
    """Average rank on ties (cut to an integer) and that rank over the group size.

    A null score comes last, a null group is a group. Ties are counted first: ranks come from running counts over distinct scores, so a score shared
    by a third of all rows is one row in the ranking and is joined back.
    """
    ties = df.groupBy(*group, score).agg(F.count(F.lit(1)).alias("_ties"))
    placed = running_totals(
        ties, group, [F.col(score).desc_nulls_last()], {"_upto": F.col("_ties")}, {"_rows": F.col("_ties")}, bounded=bounded
    )
    ranked = placed.select(
        *group,
        score,
        F.floor(F.col("_upto") - (F.col("_ties") - 1) / 2).cast("int").alias(rank),
        F.col("_rows"),
    )
    # Null groups and null scores are ranked too (nulls last), so the join treats nulls as equal.
    keys = [*group, score]
    side = ranked.withColumnsRenamed({c: f"_of_{i}" for i, c in enumerate(keys)})
    same = [df[c].eqNullSafe(side[f"_of_{i}"]) for i, c in enumerate(keys)]
    joined = df.join(side, reduce(lambda a, b: a & b, same), "left")
    return joined.select(*[df[c] for c in df.columns], rank, (F.col(rank) / F.col("_rows")).alias(share))


def label_fills(label: str) -> dict[str, Column]:
    """The label with null as 0 and as 1, the flipped one, and the null flag."""
    value = F.col(label).cast("long")
    low, high = F.coalesce(value, F.lit(0).cast("long")), F.coalesce(value, F.lit(1).cast("long"))
    return {"l0": low, "l1": high, "flip": F.lit(1).cast("long") - high, "missing": value.isNull().cast("long")}


def ranked_rows(
    df: DataFrame,
    label: str,
    group: Sequence[str] = GROUP,
    score: str = "score",
    units: str = "units",
    entity: str = "entity_id",
    keep: Sequence[str] = (),
    bounded: bool = False,
    pieces: Column | None = None,
) -> DataFrame:
    """Rows in rank order: row_number, running units and label sums, and the group's totals; of the range pieces wanted only, if stated."""
    narrow = df.select(*dict.fromkeys([*group, entity, score, units, label, *keep]))
    fills = label_fills(label)
    held = F.coalesce(F.col(units).cast("long"), F.lit(0).cast("long"))
    sums = {
        "num_units_so_far": held,
        "known_units_so_far": F.when(F.col(label).isNotNull(), held).otherwise(F.lit(0).cast("long")),
        **{f"c_{name}": value for name, value in fills.items()},
    }
    totals = {f"t_{name}": fills[name] for name in ("l0", "l1", "flip", "missing")}
    return running_totals(
        narrow,
        group,
        by_score(score, units, entity),
        sums,
        totals,
        row_number="row_number",
        row_count="t_rows",
        bounded=bounded,
        pieces=pieces,
    )


def observed_curve(df: DataFrame, label: str, group: Sequence[str] = GROUP, **columns) -> DataFrame:
    """Precision and recall at every row, over rows with a known label only."""
    rows = ranked_rows(df.where(F.col(label).isNotNull()), label, group, **columns)
    entity = columns.get("entity", "entity_id")
    return rows.select(
        *group,
        entity,
        "row_number",
        "num_units_so_far",
        (F.col("row_number") / F.col("t_rows")).alias("k_proportion"),
        F.try_divide("c_l0", "row_number").alias("precision_not_imputed"),
        F.try_divide("c_l0", "t_l0").alias("recall_not_imputed"),
    )


def bounds(n: Column, c: dict[str, Column], t: dict[str, Column]) -> dict[str, Column]:
    """Precision, recall and their bounds at a row, from running sums c and totals t.

    l0 and l1 are labels with null as 0 and 1, flip is 1 - l1, missing counts unknown labels so far.
    """
    div = F.try_divide
    return {
        "precision_all": F.coalesce(div(c["l0"], n - c["missing"]), F.lit(0.0)),
        "precision_all_all": F.coalesce(div(c["l0"], n), F.lit(0.0)),
        "precision_upper_bound": div(c["l1"], n),
        "precision_lower_bound": div(c["l0"], n),
        "recall_all": div(c["l0"], t["l0"]),
        "recall_of_0_all": div(c["flip"], t["flip"]),
        "recall_imputed_1": div(c["l1"], t["l1"]),
        "recall_upper_bound": div(c["l1"], c["l1"] + t["l0"] - c["l0"]),
        "recall_lower_bound": div(c["l0"], c["l0"] + t["l1"] - c["l1"]),
    }


def bounds_curve(df: DataFrame, label: str, group: Sequence[str] = GROUP, **columns) -> DataFrame:
    """Precision, recall and their bounds at every row, over all rows."""
    rows = ranked_rows(df, label, group, **columns)
    entity = columns.get("entity", "entity_id")
    c = {k: F.col(f"c_{k}") for k in ("l0", "l1", "flip", "missing")}
    t = {k: F.col(f"t_{k}") for k in ("l0", "l1", "flip")}
    return rows.select(
        *group,
        entity,
        "row_number",
        "num_units_so_far",
        (F.col("row_number") / F.col("t_rows")).alias("k_proportion"),
        *[value.alias(name) for name, value in bounds(F.col("row_number"), c, t).items()],
    )


def within_capacity(
    df: DataFrame,
    k,
    group: Sequence[str] = GROUP,
    score: str = "score",
    units: str = "units",
    entity: str = "entity_id",
    bounded: bool = False,
) -> DataFrame:
    """Entities in score order whose units so far first reach k; all of them when the units fall short."""
    limit = F.lit(k) if isinstance(k, (int, float)) else F.col(k)
    held = F.coalesce(F.col(units).cast("long"), F.lit(0).cast("long"))
    ranked = running_totals(df, group, by_score(score, units, entity), {"num_units_so_far": held}, bounded=bounded)
    return ranked.where(F.col("num_units_so_far") - held < limit)


def list_overlap(first: DataFrame, second: DataFrame, on: Sequence[str] = ("as_of_date", "entity_id")) -> DataFrame:
    """Jaccard overlap of two lists per remaining key: both / any, from one full outer join."""
    left = first.select(*on, F.lit(1).alias("_a"))
    right = second.select(*on, F.lit(1).alias("_b"))
    joined = left.join(right, list(on), "full")
    both = F.count(F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), 1))
    return joined.groupBy(*on[:-1]).agg(
        both.alias("in_both"), F.count(F.lit(1)).alias("in_any"), (both / F.count(F.lit(1))).alias("jaccard")
    )
