"""Running totals over groups of any size.

A window per group puts a whole group into one task. Here rows are range-partitioned on
(group, order), so a large group lies across many partitions in order; the partition number is
stored with each row. Sums per (group, partition) give every partition its starting value, and a
window inside (group, partition) does the rest. No step holds more than one partition's rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions.sizing import broadcast_if_small
from panelwright.session import durable

PIECE = "_piece"


def running_totals(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    sums: Mapping[str, Column] | None = None,
    totals: Mapping[str, Column] | None = None,
    row_number: str | None = None,
    row_count: str | None = None,
    bounded: bool = False,
    pieces: Column | None = None,
) -> DataFrame:
    """Running sums and row numbers per group, and the group's totals beside every row.

    ``sums`` and ``totals`` are {new column: summed expression}; expressions are evaluated where they are
    summed and not stored. ``order`` must be unique within a group.
    bounded=True says that every group fits one task and uses plain windows; both give the same rows.

    ``pieces`` is a condition on what a range piece holds: its rows _n and sums _s_{name}, what lies before it, _b_rows and _b_{name}, and
    the totals. Only rows of such pieces are ordered and returned: a search along the order looks into sums first. Not used when bounded.
    """
    sums, totals, wanted = dict(sums or {}), dict(totals or {}), pieces
    one = F.lit(1).cast("long")
    if bounded:
        upto = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        whole = Window.partitionBy(*group)
        made = {} if row_number is None else {row_number: F.sum(one).over(upto)}
        made |= {name: F.sum(value).over(upto) for name, value in sums.items()}
        made |= {} if row_count is None else {row_count: F.sum(one).over(whole)}
        made |= {name: F.sum(value).over(whole) for name, value in totals.items()}
        return df.select("*", *[value.alias(name) for name, value in made.items()])

    # A struct key also matches null group values, and hashes the same way for the join and the window.
    ranged = df.repartitionByRange(*[F.col(g) for g in group], *order).select(
        "*", F.struct(*group, F.spark_partition_id().alias("part")).alias(PIECE)
    )
    # Stored, because the partition number must not change between the two uses below.
    ranged = durable(ranged)
    measured = {**sums, **totals}
    summed = ranged.groupBy(PIECE).agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(value).alias(f"_s_{name}") for name, value in measured.items()]
    )
    # One row per partition and group from here on: these windows are bounded by the partition count.
    in_group = Window.partitionBy(*[F.col(f"{PIECE}.{g}") for g in group])
    earlier = in_group.orderBy(F.col(f"{PIECE}.part")).rowsBetween(Window.unboundedPreceding, -1)
    carried = {} if row_number is None else {"_b_rows": F.coalesce(F.sum("_n").over(earlier), F.lit(0))}
    carried |= {f"_b_{name}": F.coalesce(F.sum(f"_s_{name}").over(earlier), F.lit(0)) for name in sums}
    carried |= {} if row_count is None else {row_count: F.sum("_n").over(in_group)}
    carried |= {name: F.sum(f"_s_{name}").over(in_group) for name in totals}
    if wanted is None:
        offsets = summed.select(PIECE, *[value.alias(name) for name, value in carried.items()])
    else:
        offsets = summed.select("*", *[value.alias(name) for name, value in carried.items()]).where(wanted)
        offsets = broadcast_if_small(durable(offsets.select(PIECE, *carried)))

    inside = Window.partitionBy(PIECE).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    made = {} if row_number is None else {row_number: F.sum(one).over(inside) + F.col("_b_rows")}
    for name, value in sums.items():
        made[name] = F.coalesce(F.sum(value).over(inside), F.lit(0)) + F.col(f"_b_{name}")
    kept = [*([row_count] if row_count else []), *totals]
    joined = ranged.join(offsets, PIECE)
    return joined.select(*df.columns, *[value.alias(name) for name, value in made.items()], *kept)
