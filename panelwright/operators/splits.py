"""Train/test cuts by date. The panel is built once; a split is a date filter on it."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.operators.panel import MONTH

# The published list of monthly splits.
FIRST_SPLIT = date(2016, 4, 1)
LAST_SPLIT = date(2018, 2, 1)


def split_dates(first: date = FIRST_SPLIT, last: date = LAST_SPLIT) -> list[date]:
    """Month starts from first to last."""
    months = range(first.year * 12 + first.month - 1, last.year * 12 + last.month)
    return [date(m // 12, m % 12 + 1, 1) for m in months]


def _day(value) -> Column:
    return F.lit(str(value)).cast("date")


def train_rows(panel: DataFrame, split, label: str | None = None, start=None, through_split: bool = False) -> DataFrame:
    """Months from start up to the split, with the label known if one is named.

    through_split=True also takes the split month itself (the boundary of the newer cut).
    """
    month = F.col(MONTH)
    rows = panel.where(month <= _day(split) if through_split else month < _day(split))
    if start is not None:
        rows = rows.where(month >= _day(start))
    return rows if label is None else rows.where(F.col(label).isNotNull())


def test_rows(
    panel: DataFrame, split, months: int = 1, target: str | None = "internal_peu_target_zip", after_split: bool = False
) -> DataFrame:
    """The n months from the split on (after_split=False) or the n months behind it, in target areas."""
    month, first = F.col(MONTH), _day(split)
    last = F.add_months(first, months)
    rows = panel.where((month > first) & (month <= last) if after_split else (month >= first) & (month < last))
    return rows if target is None else rows.where(F.col(target) == 1)


test_rows.__test__ = False  # not a test, whatever the collector thinks of the name


def with_train_splits(
    panel: DataFrame, splits: Sequence, label: str | None = None, start=None, through_split: bool = False
) -> DataFrame:
    """Every row once per split it trains, tagged split_date: all splits in one job, without a join."""
    month = F.col(MONTH)
    rows = panel
    if start is not None:
        rows = rows.where(month >= _day(start))
    if label is not None:
        rows = rows.where(F.col(label).isNotNull())
    last = max(str(s) for s in splits)
    rows = rows.where(month <= _day(last) if through_split else month < _day(last))
    days = F.array(*[_day(s) for s in splits])
    mine = F.filter(days, lambda s: month <= s) if through_split else F.filter(days, lambda s: month < s)
    return rows.select("*", F.explode(mine).alias("split_date"))


def with_test_splits(
    panel: DataFrame,
    splits: Sequence,
    months: int = 1,
    target: str | None = "internal_peu_target_zip",
    after_split: bool = False,
) -> DataFrame:
    """Every row once per split it tests, tagged split_date."""
    month = F.col(MONTH)
    rows = panel if target is None else panel.where(F.col(target) == 1)
    first, last = min(str(s) for s in splits), max(str(s) for s in splits)
    rows = rows.where((month >= _day(first)) & (month <= F.add_months(_day(last), months)))
    days = F.array(*[_day(s) for s in splits])
    if after_split:
        mine = F.filter(days, lambda s: (month > s) & (month <= F.add_months(s, months)))
    else:
        mine = F.filter(days, lambda s: (month >= s) & (month < F.add_months(s, months)))
    return rows.select("*", F.explode(mine).alias("split_date"))


def train_profile(panel: DataFrame, splits: Sequence, label: str) -> DataFrame:
    """Rows, labelled rows and label sum of every train set, from month totals instead of copied rows."""
    month = panel.groupBy(MONTH).agg(
        F.count(F.lit(1)).alias("rows"), F.count(label).alias("labelled"), F.sum(label).alias("positives")
    )
    return with_train_splits(month, splits).groupBy("split_date").agg(
        F.sum("rows").alias("rows"),
        F.sum("labelled").alias("labelled"),
        F.sum("positives").alias("positives"),
        F.try_divide(F.sum("positives").cast("double"), F.sum("labelled").cast("double")).alias("label_mean"),
    )
