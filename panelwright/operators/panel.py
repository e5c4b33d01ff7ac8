"""The dense entity x month panel: calendar, joins, carry-forward and next-month labels.

The calendar is exploded from each entity row, never cross joined, and only after the entity rows
were hashed by entity. Rollups are hashed by entity too, so the dense rows stay where they are for
all entity joins and for the windows. A window holds one entity: as many rows as there are months.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions.scalars import (
    cases_this_month,
    heating_season,
    month_end,
    observed_cases,
    observed_ratio,
    target_flag,
    zero,
)
from panelwright.functions.skew import PIECE, ROWS_PER_PIECE, heavy_keys, with_copies, with_piece
from panelwright.operators.rollups import VIOLATION_CLASSES

ENTITY = "address_id"
MONTH = "month_start"
MIN_UNITS = 6


def hashed(df: DataFrame, *keys: str) -> DataFrame:
    """Hash rows on the keys into the session's shuffle partitions.

    The number is stated, so that adaptive execution does not merge the small entity rows into few
    tasks just before the calendar multiplies them.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def year_rows(entities: DataFrame, start, end, year: str = "panel_year") -> DataFrame:
    """A row per entity and year of the calendar: the grain for facts by year, one twelfth of the dense rows."""
    ends = [F.year(F.lit(day).cast("date")) for day in (start, end)]
    return entities.select("*", F.explode(F.sequence(*ends)).alias(year))


def month_spine(start, end) -> Column:
    """Array of month starts from start to end, both included."""
    return F.expr(f"sequence(date'{start}', date'{end}', interval 1 month)")


def dense_panel(
    entities: DataFrame,
    start,
    end,
    entity: str = ENTITY,
    units: str | None = None,
    min_units: int = MIN_UNITS,
) -> DataFrame:
    """One row per kept entity and month, with month parts, hashed by entity."""
    kept = entities if units is None else entities.where(F.col(units).cast("int") >= min_units)
    months = hashed(kept, entity).select("*", F.explode(month_spine(start, end)).alias(MONTH))
    return months.select(
        "*",
        month_end(MONTH).alias("month_end"),
        F.month(MONTH).alias("month"),
        F.year(MONTH).alias("year"),
        heating_season(F.month(MONTH)).alias("nyc_heating_season"),
    )


def attach(panel: DataFrame, rollup: DataFrame, entity: str = ENTITY, month: str = MONTH) -> DataFrame:
    """Left-join a rollup that has one row per (entity, month), keeping the panel's hashing by entity."""
    return panel.join(hashed(rollup, entity), [entity, month], "left")


def attach_packed(
    panel: DataFrame, rollup: DataFrame, name: str, entity: str = ENTITY, month: str = MONTH
) -> DataFrame:
    """Attach a rollup as one struct column, null where the month has no row.

    Wide panels stay narrow through the joins, and one window expression moves all columns of a rollup.
    """
    rest = [c for c in rollup.columns if c not in (entity, month)]
    return attach(panel, rollup.select(entity, month, F.struct(*rest).alias(name)), entity, month)


def entity_window(entity: str = ENTITY, month: str = MONTH):
    return Window.partitionBy(entity).orderBy(month)


def carry_forward(
    df: DataFrame, columns: Mapping[str, str], entity: str = ENTITY, month: str = MONTH, fill=None
) -> DataFrame:
    """Last known value up to each month: {new column: source column}; ``fill`` before the first one."""
    w = entity_window(entity, month).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = {name: F.last(source, ignorenulls=True).over(w) for name, source in columns.items()}
    return df.select(
        "*", *[(c if fill is None else F.coalesce(c, F.lit(fill))).alias(name) for name, c in last.items()]
    )


def next_month(df: DataFrame, labels: Mapping[str, Column], entity: str = ENTITY, month: str = MONTH) -> DataFrame:
    """Each expression as it stands one month later: {label: expression}, one shared window."""
    w = entity_window(entity, month)
    return df.select("*", *[F.lead(value, 1).over(w).alias(name) for name, value in labels.items()])


def label_expressions(visits: str, opened: str, units: str = "internal_units_static") -> dict[str, Column]:
    """The labels of a month from its packed visits and opened cases; apply to next month's structs."""
    v = {n: F.col(f"{visits}.internal_{n}") for n in ("knocks_count", "knocks_any", "opens_count", "opens_any")}
    count, some = (F.col(f"{opened}.internal_cases_opened_thismonth_{form}") for form in ("count", "any"))
    met = (v["knocks_any"], v["opens_any"])
    return {
        "internal_knocks_count_next_month": zero(v["knocks_count"]),
        "internal_knocks_any_next_month": zero(v["knocks_any"]),
        "internal_opens_count_next_month": v["opens_count"],
        "internal_opens_any_next_month": v["opens_any"],
        "internal_cases_opened_count_next_month": observed_cases(*met, count),
        "internal_cases_opened_any_next_month": observed_cases(*met, some),
        "internal_cases_opened_per_unit_next_month": observed_ratio(*met, count, F.col(units)),
        "internal_cases_opened_per_open_next_month": observed_ratio(*met, count, v["opens_count"]),
        "internal_cases_opened_per_knock_next_month": observed_ratio(*met, count, v["knocks_count"]),
    }


def building_panel(
    buildings: DataFrame,
    start,
    end,
    violations: DataFrame | None = None,
    litigation: DataFrame | None = None,
    building: str = "bin_clean",
) -> DataFrame:
    """Building x month features; running totals are carried at building grain, one row per month each.

    Doing it here keeps a building with very many entities out of any one window.
    """
    panel = hashed(buildings.select(building).distinct(), building)
    panel = panel.select("*", F.explode(month_spine(start, end)).alias(MONTH))
    ever: dict[str, str] = {}
    this_month: list[Column] = []
    if violations is not None:
        panel = attach(panel, violations, building)
        names = ["count"] + [f"count_{c}" for c in VIOLATION_CLASSES] + ["any"]
        names += [f"any_{c}" for c in VIOLATION_CLASSES]
        this_month += [zero(f"hpdviols_{n}").alias(f"hpdviols_{n}_this_month") for n in names]
        ever["hpdviols_count_ever"] = "hpdviols_ever_count"
    if litigation is not None:
        panel = attach(panel, litigation, building)
        for kind in ("", "_tenantaction", "_heatwater"):
            for form in ("count", "any"):
                name = f"housinglitig{kind}_{form}"
                this_month.append(zero(name).alias(f"{name}_this_month"))
        ever["housinglitig_count_ever"] = "housinglitig_ever_count"
    carried = carry_forward(panel, ever, building, fill=0)
    return carried.select(building, MONTH, *this_month, *ever)


def build_panel(
    entities: DataFrame,
    start,
    end,
    visits: DataFrame,
    opened: DataFrame,
    closed: DataFrame | None = None,
    followups: DataFrame | None = None,
    workers: DataFrame | None = None,
    violations: DataFrame | None = None,
    litigation: DataFrame | None = None,
    tracts: DataFrame | None = None,
    first_visited: DataFrame | None = None,
    issue_types: Sequence[str] = (),
    worker_ids: Sequence = (),
    rows_per_piece: int = ROWS_PER_PIECE,
) -> DataFrame:
    """The whole panel from start to end - 1 month, with labels; static entity columns ride along.

    ``end`` is the first month after the panel: the calendar reaches it so that the last label exists.
    ``entities`` holds address_id, internal_bin_static, internal_census_tract_static, internal_zip_static,
    internal_units_static and any other static column. ``tracts`` has one row per (tract, year),
    ``first_visited`` one per zip. Dummy buildings (…000000) are dropped.
    """
    kept = entities.where(
        (F.col("internal_units_static").cast("int") >= MIN_UNITS)
        & ~F.col("internal_bin_static").cast("string").endswith("000000")
    )
    by_building = violations is not None or litigation is not None
    if by_building:
        kept = kept.withColumn("bin_clean", F.col("internal_bin_static").cast("string"))
        heavy = heavy_keys(kept, "bin_clean", rows_per_piece)
        kept = with_piece(kept, heavy, "bin_clean", ENTITY)
        # Taken before the joins below, which the building side then does not repeat.
        bins = kept.select("bin_clean")
    if first_visited is not None:
        zips = first_visited.select(
            F.col("zip").cast("int").alias("internal_zip_static"), F.col("month_first_canvassed")
        )
        kept = kept.join(zips, "internal_zip_static", "left")
    else:
        kept = kept.withColumn("month_first_canvassed", F.lit(None).cast("date"))
    # Year grain first: tract and building joins meet one row per entity and year instead of twelve.
    spine = month_spine(start, end)
    if tracts is not None or by_building:
        kept = year_rows(kept, start, end)
        spine = F.filter(spine, lambda m: F.year(m) == F.col("panel_year"))
    if tracts is not None:
        facts = tracts.withColumnsRenamed(
            {"acs_tract_state_county_tract": "tract_key", "year_tomerge_rounded": "panel_year"}
        )
        kept = kept.withColumn("tract_key", F.col("internal_census_tract_static").cast("bigint"))
        kept = kept.join(facts, ["tract_key", "panel_year"], "left").drop("tract_key")
    static = [c for c in kept.columns if c not in ("month_first_canvassed", "panel_year", "bin_clean", PIECE)]
    carried = [*static, "month_first_canvassed"]
    from_building: list[str] = []
    if by_building:
        # A building's months of a year ride to its entities as one map of at most twelve structs and are spread by the calendar, so
        # dense rows are made once and stay where they are. Even a building with a third of all entities meets many tasks.
        building = building_panel(bins, start, end, violations, litigation)
        from_building = [c for c in building.columns if c not in ("bin_clean", MONTH)]
        entry = F.struct(F.col(MONTH), F.struct(*from_building))
        by_year = building.groupBy("bin_clean", F.year(MONTH).alias("panel_year")).agg(F.map_from_entries(F.collect_list(entry)).alias("_months"))
        kept = kept.join(with_copies(by_year, heavy, "bin_clean"), ["bin_clean", "panel_year", PIECE], "left")
        spine = F.transform(spine, lambda m: F.struct(m.alias(MONTH), F.try_element_at("_months", m).alias("building")))
        panel = hashed(kept, ENTITY).select(*carried, F.explode(spine).alias("_at")).select(*carried, f"_at.{MONTH}", "_at.building")
    else:
        panel = hashed(kept, ENTITY).select(*carried, F.explode(spine).alias(MONTH))
    rollups = {"visits": visits, "opened": opened, "closed": closed, "followups": followups, "workers": workers}
    for name, rollup in rollups.items():
        if rollup is not None:
            panel = attach_packed(panel, rollup, name)
    ahead, back = entity_window(), entity_window().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kept_back = [n for n in ("opened", "closed", "workers") if rollups[n] is not None]
    panel = panel.select(
        "*",
        *[F.lead(n, 1).over(ahead).alias(f"{n}_next") for n in ("visits", "opened")],
        *[F.last(n, ignorenulls=True).over(back).alias(f"{n}_last") for n in kept_back],
    )

    met = (F.col("visits.internal_knocks_any"), F.col("visits.internal_opens_any"))
    features = [
        month_end(MONTH).alias("month_end"),
        F.month(MONTH).alias("month"),
        F.year(MONTH).alias("year"),
        heating_season(F.month(MONTH)).alias("nyc_heating_season"),
        target_flag(MONTH, "month_first_canvassed").alias("internal_peu_target_zip"),
        zero("visits.internal_knocks_count").alias("internal_knocks_count_this_month"),
        zero("visits.internal_knocks_any").alias("internal_knocks_any_this_month"),
        F.col("visits.internal_opens_count").alias("internal_opens_count_this_month"),
        F.col("visits.internal_opens_any").alias("internal_opens_any_this_month"),
        F.col("opened_last.internal_cases_opened_ever_count").alias("internal_cases_opened_count_ever"),
    ]
    shown = {f"internal_cases_opened_{form}": f"internal_cases_opened_thismonth_{form}" for form in ("count", "any")}
    shown |= {f"internal_issue_{t}_cases_opened_count": f"internalissue_cases_opened_count_{t}" for t in issue_types}
    features += [
        cases_this_month(*met, F.col(f"opened.{source}")).alias(f"{name}_this_month") for name, source in shown.items()
    ]
    if closed is not None:
        for kind, form in (("", "count"), ("", "any"), ("nya_", "count")):
            source = F.col(f"closed.internal_{kind}cases_closed_thismonth_{form}")
            features.append(source.alias(f"internal_{kind}cases_closed_{form}_this_month"))
        features += [
            F.col(f"closed_last.internal_{kind}cases_closed_ever_count").alias(f"internal_{kind}cases_closed_count_ever")
            for kind in ("", "nya_")
        ]
    if followups is not None:
        features += [F.col(f"followups.internalfollow_all_followups_{form}") for form in ("count", "any")]
    if workers is not None:
        for w in worker_ids:
            features.append(F.col(f"workers.sp_{w}_thismonth").alias(f"internal_sp_{w}_any_this_month"))
            features.append(F.col(f"workers_last.sp_{w}_ever").alias(f"internal_sp_{w}_any_ever"))

    labels = [value.alias(name) for name, value in label_expressions("visits_next", "opened_next").items()]
    features += [F.col(f"building.{c}").alias(c) for c in from_building]
    return panel.where(F.col(MONTH) < F.lit(end).cast("date")).select(*static, MONTH, *features, *labels)
