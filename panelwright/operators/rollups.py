"""Event tables to one row per entity and period, with running totals.

Each rollup groups on (entity, period), so Spark combines on the map side first and an entity
that owns a third of the events shuffles as a few rows per period. Running totals then see at
most one row per entity and period: the windows are bounded by the length of the calendar.
Date limits are put on the raw date column, where Parquet can skip row groups.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions.scalars import RESOLVED_OUTCOMES, as_col, case_date, flag, month_of, week_of


def period_rollup(
    events: DataFrame,
    keys: Sequence[str],
    sums: Mapping[str, Column],
    count: str | None = None,
    any_suffix: str | None = "_any",
    count_suffix: str = "_count",
) -> DataFrame:
    """Count rows and sum expressions per key; every total also gets a 0/1 flag.

    A total named ``x`` gives ``x_count`` and, unless any_suffix is None, ``x_any``.
    """
    totals = []
    if count is not None:
        totals.append((count, F.count(F.lit(1))))
    totals += [(name, F.sum(value)) for name, value in sums.items()]
    rolled = events.groupBy(*keys).agg(*[total.alias(name + count_suffix) for name, total in totals])
    if any_suffix is None:
        return rolled
    flags = [flag(F.col(name + count_suffix) > 0).alias(name + any_suffix) for name, _ in totals]
    return rolled.select("*", *flags)


def with_running(df: DataFrame, entity: str, order: Sequence[str], totals: Mapping[str, str]) -> DataFrame:
    """Running totals per entity: {new column: summed column}. ``order`` must be unique per entity."""
    w = Window.partitionBy(entity).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.select("*", *[F.sum(value).over(w).alias(name) for name, value in totals.items()])


def with_ever(df: DataFrame, entity: str, order: Sequence[str], flags: Mapping[str, str]) -> DataFrame:
    """1 from the first period a flag was set: {new column: flag column}, one shared window."""
    w = Window.partitionBy(entity).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.select("*", *[F.max(value).over(w).alias(name) for name, value in flags.items()])


def weekly_litigation(cases: DataFrame, date: Column | None = None, building: str = "bin") -> DataFrame:
    """Court cases per building, week and month. A week that spans two months gives two rows."""
    opened = cases.select(
        F.col(building).cast("string").alias("bin_clean"),
        (case_date("caseopendate") if date is None else date).alias("opened"),
        flag(F.col("casetype").startswith("Tenant Action")).alias("tenantaction"),
        flag(F.col("casetype").startswith("Heat")).alias("heatwater"),
    ).select(
        "bin_clean",
        week_of("opened").alias("week_start"),
        month_of("opened").alias("month_start"),
        "tenantaction",
        "heatwater",
    )
    rolled = opened.groupBy("bin_clean", "week_start", "month_start").agg(
        F.count(F.lit(1)).alias("housinglitig_count"),
        F.sum("tenantaction").alias("housinglitig_tenantaction_count"),
        F.sum("heatwater").alias("housinglitig_heatwater_count"),
    ).select(
        "*",
        F.lit(1).alias("housinglitig_any"),
        flag(F.col("housinglitig_tenantaction_count") > 0).alias("housinglitig_tenantaction_any"),
        flag(F.col("housinglitig_heatwater_count") > 0).alias("housinglitig_heatwater_any"),
    )
    return with_running(
        rolled, "bin_clean", ["week_start", "month_start"], {"housinglitig_ever_count": "housinglitig_count"}
    )


def monthly_litigation(weekly: DataFrame, before=None) -> DataFrame:
    """Weekly rows to months: summed cases, and the number of week rows kept apart."""
    rows = weekly if before is None else weekly.where(F.col("month_start") < F.lit(before).cast("date"))
    rolled = rows.groupBy("bin_clean", month_of("month_start").alias("month_start")).agg(
        F.sum("housinglitig_count").alias("housinglitig_count"),
        F.count(F.lit(1)).alias("weeks_with_litigation"),
        F.sum("housinglitig_tenantaction_count").alias("housinglitig_tenantaction_count"),
        F.sum("housinglitig_heatwater_count").alias("housinglitig_heatwater_count"),
    ).select(
        "*",
        flag(F.col("housinglitig_count") > 0).alias("housinglitig_any"),
        flag(F.col("housinglitig_tenantaction_count") > 0).alias("housinglitig_tenantaction_any"),
        flag(F.col("housinglitig_heatwater_count") > 0).alias("housinglitig_heatwater_any"),
    )
    return with_running(
        rolled,
        "bin_clean",
        ["month_start"],
        {"housinglitig_ever_count": "housinglitig_count", "weeks_with_litigation_ever": "weeks_with_litigation"},
    )


VIOLATION_CLASSES = ["classa", "classb", "classc", "classi"]


def monthly_violations(violations: DataFrame, before=None) -> DataFrame:
    """Violation rows per building and month: row count, four class totals, five flags, running count."""
    rows = violations if before is None else violations.where(F.col("month_start") < F.lit(before).cast("date"))
    totals = [F.count(F.lit(1)).alias("hpdviols_count")]
    totals += [F.sum(f"hpdviols_count_{c}").alias(f"hpdviols_count_{c}") for c in VIOLATION_CLASSES]
    rolled = rows.groupBy("bin_clean", month_of("month_start").alias("month_start")).agg(*totals).select(
        "*",
        flag(F.col("hpdviols_count") > 0).alias("hpdviols_any"),
        *[flag(F.col(f"hpdviols_count_{c}") > 0).alias(f"hpdviols_any_{c}") for c in VIOLATION_CLASSES],
    )
    return with_running(rolled, "bin_clean", ["month_start"], {"hpdviols_ever_count": "hpdviols_count"})


def monthly_visits(
    visits: DataFrame, entity: str, date: str, knock: Column, opened: Column, case: Column, before=None
) -> DataFrame:
    """Knocks, opened doors and cases per entity and month, as counts and 0/1 flags.

    ``before`` is exclusive and should lie one month past the panel's end, so that the last label exists.
    """
    rows = visits if before is None else visits.where(F.col(date) < F.lit(before).cast("date"))
    marked = rows.select(
        F.col(entity),
        month_of(date).alias("month_start"),
        flag(knock).alias("knocks"),
        flag(opened).alias("opens"),
        flag(case).alias("cases"),
    )
    return period_rollup(
        marked,
        [entity, "month_start"],
        {"internal_knocks": F.col("knocks"), "internal_opens": F.col("opens"), "internal_cases": F.col("cases")},
    )


ISSUE_TYPES = {
    # Issue types as they are written in the issue table.
    "legal": "Legal",
    "repair": "Repairs",
    "service_access": "Service/Access",
    "other": "Other",
}


def case_issues(
    issues: DataFrame,
    case: str,
    issue_type: Column,
    outcome: Column,
    types: Mapping[str, str] = ISSUE_TYPES,
    resolved: Sequence[str] = RESOLVED_OUTCOMES,
) -> DataFrame:
    """Issues per case: total, one count per type, resolved and unresolved."""
    return issues.groupBy(case).agg(
        F.count(F.lit(1)).alias("issues"),
        *[F.count_if(issue_type == value).alias(f"{name}_issues") for name, value in types.items()],
        F.count_if(outcome.isin(list(resolved))).alias("resolved_issues"),
        F.count_if(~outcome.isin(list(resolved))).alias("unresolved_issues"),
    )


def opened_cases(
    cases: DataFrame, issues: DataFrame, case: str, entity: str, date: str, types: Sequence[str], before=None
) -> DataFrame:
    """Opened cases per entity and month, with the cases that hold each issue type and a running count.

    ``cases`` must already be cut to the wanted origin and carry the entity; ``issues`` has one row per case.
    """
    rows = cases if before is None else cases.where(F.col(date) < F.lit(before).cast("date"))
    joined = rows.join(issues, case, "left").select(
        F.col(entity),
        month_of(date).alias("month_start"),
        F.col(case).alias("case_id"),
        *[flag(F.col(f"{t}_issues") > 0).alias(t) for t in types],
    )
    rolled = joined.groupBy(entity, "month_start").agg(
        F.count("case_id").alias("internal_cases_opened_thismonth_count"),
        *[F.sum(t).alias(f"internalissue_cases_opened_count_{t}") for t in types],
    ).select("*", flag(F.col("internal_cases_opened_thismonth_count") > 0).alias("internal_cases_opened_thismonth_any"))
    return with_running(
        rolled, entity, ["month_start"], {"internal_cases_opened_ever_count": "internal_cases_opened_thismonth_count"}
    )


def closed_cases(cases: DataFrame, case: str, entity: str, date: str, no_answer: Column, before=None) -> DataFrame:
    """Closed cases and no-answer counts per entity and month, with running totals of both."""
    rows = cases if before is None else cases.where(F.col(date) < F.lit(before).cast("date"))
    rolled = rows.groupBy(entity, month_of(date).alias("month_start")).agg(
        F.count(case).alias("internal_cases_closed_thismonth_count"),
        F.sum(no_answer).alias("internal_nya_cases_closed_thismonth_count"),
    ).select("*", flag(F.col("internal_cases_closed_thismonth_count") > 0).alias("internal_cases_closed_thismonth_any"))
    return with_running(
        rolled,
        entity,
        ["month_start"],
        {
            "internal_cases_closed_ever_count": "internal_cases_closed_thismonth_count",
            "internal_nya_cases_closed_ever_count": "internal_nya_cases_closed_thismonth_count",
        },
    )


def monthly_followups(followups: DataFrame, case: str, entity: str, date: str, before=None) -> DataFrame:
    """Follow-ups per entity and month; rows whose chain to an entity is broken group under null."""
    rows = followups if before is None else followups.where(F.col(date) < F.lit(before).cast("date"))
    return rows.groupBy(entity, month_of(date).alias("month_start")).agg(
        F.count(case).alias("internalfollow_all_followups_count")
    ).select("*", flag(F.col("internalfollow_all_followups_count") > 0).alias("internalfollow_all_followups_any"))


def with_location(rows: DataFrame, link: str, contacts: DataFrame, contact: str, location: str) -> DataFrame:
    """Left-join the contact that holds the entity; contacts have one row per id."""
    side = contacts.select(F.col(contact).alias(link), F.col(location))
    return rows.join(side, link, "left")


def worker_months(cases: DataFrame, entity: str, date: str, worker: str, before=None) -> DataFrame:
    """Long form: one row per entity, month and worker that handled a case."""
    rows = cases if before is None else cases.where(F.col(date) < F.lit(before).cast("date"))
    return rows.groupBy(entity, month_of(date).alias("month_start"), F.col(worker).alias("worker")).agg(
        F.count(F.lit(1)).alias("cases")
    )


def worker_flags(cases: DataFrame, entity: str, date: str, worker: str, workers: Sequence, before=None) -> DataFrame:
    """Wide form for a fixed worker list: this-month and ever flags, two columns per worker.

    The list decides the width, so the flags are plain maxima in one aggregate; rows of workers outside
    the list still give their (entity, month) row, as all zeros.
    """
    rows = cases if before is None else cases.where(F.col(date) < F.lit(before).cast("date"))
    this_month = rows.groupBy(entity, month_of(date).alias("month_start")).agg(
        *[F.max(flag(as_col(worker) == w)).alias(f"sp_{w}_thismonth") for w in workers]
    )
    return with_ever(
        this_month, entity, ["month_start"], {f"sp_{w}_ever": f"sp_{w}_thismonth" for w in workers}
    )
