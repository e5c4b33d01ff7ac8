"""A stored panel that grows by a month at a time, from the new month's events and a small state.

State, per rollup and key: its row of the last month, or, where it has none, the running totals alone. The panel of the last month and the new one is
built from state and new rows: the new month's features, and the last month once more, whose labels the new events make known. These
two partitions are overwritten; all others stay as they are, and no earlier event is read again.

A month counts as done once its marker is published, which is last. An extension that was killed is called again and writes the same rows over.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.operators.panel import ENTITY, MONTH, build_panel
from panelwright.session import durable
from panelwright.sources import once, tables

@dataclass(frozen=True)
class Rollup:
    """A monthly rollup: its key, its running columns ({column: "sum" or "max"}), and its rows from the events of months first to last."""

    rows: Callable[[str, str], DataFrame]
    key: str = ENTITY
    running: Mapping[str, str] | None = None


def _add_month(spark: SparkSession, month: str, n: int) -> str:
    return str(spark.range(1).select(F.add_months(F.lit(month).cast("date"), n).cast("string")).first()[0])


def months_done(spark: SparkSession, folder: str) -> list[str]:
    return once.names_in(spark, f"{folder}/months")


def _with_past(new: DataFrame, past: DataFrame | None, rollup: Rollup) -> DataFrame:
    """Rows of the new month, their running columns going on from the state."""
    if past is None or not rollup.running:
        return new
    before = past.select(rollup.key, *[F.col(c).alias(f"_past_{c}") for c in rollup.running])
    joined = new.join(before, rollup.key, "left")

    def going_on(c: str):
        if rollup.running[c] == "max":
            return F.greatest(c, F.coalesce(f"_past_{c}", c))
        return F.col(c) + F.coalesce(f"_past_{c}", F.lit(0))

    return joined.select(*[going_on(c).cast(new.schema[c].dataType).alias(c) if c in rollup.running else F.col(c) for c in new.columns])


def _next_state(rows: DataFrame, past: DataFrame | None, rollup: Rollup, month: str) -> DataFrame:
    """The month's rows, and the running columns of keys without one; both stand at the month."""
    day = F.lit(month).cast("date").alias(MONTH)
    if past is None or not rollup.running:
        return rows
    silent = past.join(rows.select(rollup.key), rollup.key, "left_anti")
    kept = {rollup.key, *rollup.running}
    carried = [day if c == MONTH else F.col(c) if c in kept else F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns]
    return rows.unionByName(silent.select(*carried))


def start(folder: str, rollups: Mapping[str, Rollup], first: str, month: str, entities: DataFrame, **statics) -> None:
    """Build the panel from first to month (the labels of that last month stay open) and the state behind it, from all events so far."""
    spark = entities.sparkSession
    whole = {n: r.rows(first, month) for n, r in rollups.items()}
    for name, rollup in rollups.items():
        rows = whole[name]
        if rollup.running:
            last = rows.groupBy(rollup.key).agg(F.max_by(F.struct(*rows.columns), MONTH).alias("r")).select("r.*")
            own = F.col(MONTH) == F.lit(month).cast("date")
            kept = {rollup.key, MONTH, *rollup.running}
            state = last.select(*[F.lit(month).cast("date").alias(c) if c == MONTH else F.col(c) if c in kept else F.when(own, F.col(c)).alias(c) for c in rows.columns])
        else:
            state = rows.where(F.col(MONTH) == F.lit(month).cast("date"))
        tables.write_table(state, f"{folder}/state/{name}/month={month}")
    panel = build_panel(entities, first, _add_month(spark, month, 1), **whole, **statics)
    tables.replace_splits(panel, f"{folder}/panel", MONTH)
    once.put_if_absent(spark, f"{folder}/months/{month}", "")


def extend(folder: str, rollups: Mapping[str, Rollup], entities: DataFrame, **statics) -> str:
    """Add the month behind the last one that is done, and overwrite that one, whose labels are known now; the month added."""
    spark = entities.sparkSession
    last = months_done(spark, folder)[-1]
    month = _add_month(spark, last, 1)
    history = {}
    for name, rollup in rollups.items():
        past = spark.read.parquet(f"{folder}/state/{name}/month={last}")
        rows = durable(_with_past(rollup.rows(month, month), past, rollup))
        tables.write_table(_next_state(rows, past, rollup, month), f"{folder}/state/{name}/month={month}")
        history[name] = past.select(*rows.columns).unionByName(rows)
    panel = build_panel(entities, last, _add_month(spark, month, 1), **history, **statics)
    tables.replace_splits(panel, f"{folder}/panel", MONTH)
    once.put_if_absent(spark, f"{folder}/months/{month}", "")
    return month


def stored_panel(spark: SparkSession, folder: str, columns: Sequence[str] = ("*",)) -> DataFrame:
    """The panel of the months that are done."""
    return spark.read.parquet(f"{folder}/panel").select(*columns)
