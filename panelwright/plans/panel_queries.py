"""Rollups, the dense panel, labels and splits on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwright.functions import scalars as s
from panelwright.operators import panel as p
from panelwright.operators import rollups, splits
from panelwright.plans import standins as st
from panelwright.plans.catalog import query

FLAGSHIP_SPLIT = "2001-06-01"
SPLITS = ["1999-01-01", "2000-01-01", "2001-01-01", "2001-06-01"]


def _six(c):
    return F.round(c, 6)


# --- dense panel ----------------------------------------------------------------------------------


def visit_panel(t, end=st.END):
    """Entities with at least six units by month, visits attached, totals carried, labels one month on."""
    people = st.entities(t).select("address_id", "internal_units_static")
    dense = p.dense_panel(people, st.START, end, units="internal_units_static")
    running = rollups.with_running(
        st.visits(t, before=end), "address_id", ["month_start"], {"knocks_ever": "internal_knocks_count"}
    )
    joined = p.attach(dense, running)
    carried = p.carry_forward(joined, {"knocks_carried": "knocks_ever"}, fill=0)
    return p.next_month(carried, {"opens_next": F.col("internal_opens_any")})


VISIT_PANEL = f"""
with {st.ENTITIES}, {st.VISITS},
dense as (select address_id, month_start from entities, months where internal_units_static >= 6),
running as (
  select *, cast(sum(knocks) over (partition by address_id order by month_start rows unbounded preceding) as bigint)
              as knocks_ever from visits),
panel as (
  select d.address_id, d.month_start, r.knocks, r.opens, r.knocks_ever,
         coalesce(last_value(r.knocks_ever ignore nulls) over w, 0) as knocks_carried,
         lead(cast(case when r.opens is null then null when r.opens > 0 then 1 else 0 end as integer)) over
           (partition by d.address_id order by d.month_start) as opens_next
  from dense d left join running r using (address_id, month_start)
  window w as (partition by d.address_id order by d.month_start rows unbounded preceding))
"""


@query(
    "panel_monthly",
    VISIT_PANEL
    + f"""
select month_start, count(*) as entities, cast(sum(coalesce(knocks, 0)) as bigint) as knocks,
       cast(sum(knocks_carried) as bigint) as knocks_carried, count(opens_next) as labelled,
       round(avg(opens_next), 6) as label_mean
from panel where month_start < date '{FLAGSHIP_SPLIT}' group by month_start
""",
)
def panel_monthly(t):
    rows = splits.train_rows(visit_panel(t), FLAGSHIP_SPLIT)
    return rows.groupBy("month_start").agg(
        F.count(F.lit(1)).alias("entities"),
        F.sum(s.zero("internal_knocks_count")).alias("knocks"),
        F.sum("knocks_carried").alias("knocks_carried"),
        F.count("opens_next").alias("labelled"),
        _six(F.avg("opens_next")).alias("label_mean"),
    )


@query(
    "panel_dense_count",
    f"""
with {st.ENTITIES}
select month_start, cast(last_day(month_start) as date) as month_end, cast(month(month_start) as integer) as month,
       cast(year(month_start) as integer) as year,
       cast(case when month(month_start) in (6, 7, 8, 9) then 0 else 1 end as integer) as nyc_heating_season,
       count(*) as entities, cast(sum(internal_units_static) as bigint) as units
from entities, months where internal_units_static >= 6 group by all
""",
)
def panel_dense_count(t):
    people = st.entities(t).select("address_id", "internal_units_static")
    dense = p.dense_panel(people, st.START, st.END, units="internal_units_static")
    return dense.groupBy("month_start", "month_end", "month", "year", "nyc_heating_season").agg(
        F.count(F.lit(1)).alias("entities"), F.sum("internal_units_static").alias("units")
    )


@query(
    "carry_forward",
    VISIT_PANEL + "select address_id, month_start, knocks, knocks_ever, knocks_carried, opens_next from panel",
)
def carry_forward(t):
    return visit_panel(t).select(
        "address_id",
        "month_start",
        F.col("internal_knocks_count").alias("knocks"),
        "knocks_ever",
        "knocks_carried",
        "opens_next",
    )


# --- rollups --------------------------------------------------------------------------------------


@query(
    "weekly_rollup",
    """
with flat as (
  select cast(user_id as varchar) as bin_clean, cast(date_trunc('week', ts) as date) as week_start,
         cast(date_trunc('month', ts) as date) as month_start, event_type from events),
weeks as (
  select bin_clean, week_start, month_start, count(*) as n, count(*) filter (where event_type = 'view') as tenant,
         count(*) filter (where event_type = 'error') as heat
  from flat group by 1, 2, 3)
select bin_clean, week_start, month_start, n as housinglitig_count, tenant as housinglitig_tenantaction_count,
       heat as housinglitig_heatwater_count, 1 as housinglitig_any,
       cast(tenant > 0 as integer) as housinglitig_tenantaction_any,
       cast(heat > 0 as integer) as housinglitig_heatwater_any,
       cast(sum(n) over (partition by bin_clean order by week_start, month_start rows unbounded preceding) as bigint)
         as housinglitig_ever_count
from weeks
""",
)
def weekly_rollup(t):
    kind = F.when(F.col("event_type") == "error", "Heat and Hot Water").when(
        F.col("event_type") == "view", "Tenant Action/Harrassment"
    )
    raw = t.events.select(
        F.col("user_id").alias("bin"),
        kind.otherwise("Access Warrant").alias("casetype"),
        F.date_format("ts", s.CASE_DATE_FORMAT).alias("caseopendate"),
    )
    return rollups.weekly_litigation(raw)


@query(
    "month_from_week",
    f"""
with {st.WEEKLY_COURT},
monthly as (
  select bin_clean, month_start, cast(sum(n) as bigint) as n, count(*) as weeks, cast(sum(tenant) as bigint) as tenant,
         cast(sum(heat) as bigint) as heat
  from weekly group by 1, 2)
select bin_clean, month_start, n as housinglitig_count, weeks as weeks_with_litigation,
       tenant as housinglitig_tenantaction_count, heat as housinglitig_heatwater_count,
       cast(n > 0 as integer) as housinglitig_any, cast(tenant > 0 as integer) as housinglitig_tenantaction_any,
       cast(heat > 0 as integer) as housinglitig_heatwater_any,
       cast(sum(n) over w as bigint) as housinglitig_ever_count,
       cast(sum(weeks) over w as bigint) as weeks_with_litigation_ever
from monthly window w as (partition by bin_clean order by month_start rows unbounded preceding)
""",
)
def month_from_week(t):
    return rollups.monthly_litigation(rollups.weekly_litigation(st.court_cases(t)))


@query(
    "violations_monthly",
    f"""
with {st.VIOLATIONS}
select bin_clean, month_start, n as hpdviols_count, cast(a as bigint) as hpdviols_count_classa,
       cast(b as bigint) as hpdviols_count_classb, cast(c as bigint) as hpdviols_count_classc,
       cast(i as bigint) as hpdviols_count_classi, 1 as hpdviols_any, cast(a > 0 as integer) as hpdviols_any_classa,
       cast(b > 0 as integer) as hpdviols_any_classb, cast(c > 0 as integer) as hpdviols_any_classc,
       cast(i > 0 as integer) as hpdviols_any_classi, n_ever as hpdviols_ever_count
from violations
""",
)
def violations_monthly(t):
    return rollups.monthly_violations(st.violations(t))


@query(
    "visits_monthly",
    f"""
with {st.VISITS}
select address_id, month_start, knocks as internal_knocks_count, cast(knocks > 0 as integer) as internal_knocks_any,
       opens as internal_opens_count, cast(opens > 0 as integer) as internal_opens_any,
       cases as internal_cases_count, cast(cases > 0 as integer) as internal_cases_any
from visits
""",
)
def visits_monthly(t):
    return st.visits(t)


@query(
    "case_issue_rollup",
    f"""
with {st.ISSUES}, {st.OPENED}
select address_id, month_start, n as internal_cases_opened_thismonth_count,
       legal as internalissue_cases_opened_count_legal, repair as internalissue_cases_opened_count_repair,
       service_access as internalissue_cases_opened_count_service_access,
       other as internalissue_cases_opened_count_other,
       cast(n > 0 as integer) as internal_cases_opened_thismonth_any, n_ever as internal_cases_opened_ever_count
from opened
""",
)
def case_issue_rollup(t):
    return st.opened_cases(t)


@query("issues_per_case", f"with {st.ISSUES} select * from issues")
def issues_per_case(t):
    return st.issues(t)


@query(
    "closed_running",
    f"""
with {st.CLOSED}
select address_id, month_start, n as internal_cases_closed_thismonth_count,
       nya as internal_nya_cases_closed_thismonth_count, cast(n > 0 as integer) as internal_cases_closed_thismonth_any,
       n_ever as internal_cases_closed_ever_count, nya_ever as internal_nya_cases_closed_ever_count
from closed
""",
)
def closed_running(t):
    return st.closed_cases(t)


@query(
    "followup_chain",
    f"""
with {st.FOLLOWUPS}
select address_id, month_start, n as internalfollow_all_followups_count,
       cast(n > 0 as integer) as internalfollow_all_followups_any
from followups
""",
)
def followup_chain(t):
    return st.followups(t)


_FLAG_SQL = ",\n".join(f"max(cast(l_suppkey = {w} as integer)) as sp_{w}_thismonth" for w in st.WORKERS)
_EVER_SQL = ",\n".join(
    f"max(sp_{w}_thismonth) over (partition by address_id order by month_start rows unbounded preceding) as sp_{w}_ever"
    for w in st.WORKERS
)
WORKER_SQL = f"""
workers as (
  select *, {_EVER_SQL}
  from (select o_custkey as address_id, cast(date_trunc('month', o_orderdate) as date) as month_start, {_FLAG_SQL}
        from orders join lineitem on o_orderkey = l_orderkey group by 1, 2))
"""


def workers(t):
    return rollups.worker_flags(st.handled_cases(t), "address_id", "o_orderdate", "l_suppkey", st.WORKERS)


@query("worker_flags", f"with {WORKER_SQL} select * from workers")
def worker_flags(t):
    return workers(t)


@query(
    "worker_months",
    """
select o_custkey as address_id, cast(date_trunc('month', o_orderdate) as date) as month_start,
       l_suppkey as worker, count(*) as cases
from orders join lineitem on o_orderkey = l_orderkey group by 1, 2, 3
""",
)
def worker_months(t):
    return rollups.worker_months(st.handled_cases(t), "address_id", "o_orderdate", "l_suppkey")


# --- the full panel ---------------------------------------------------------------------------------


def full_panel(t, end=st.END):
    """Every join and feature family of the panel at once."""
    month_past = F.lit(end).cast("date")
    return p.build_panel(
        st.entities(t),
        st.START,
        end,
        visits=st.visits(t, before=F.add_months(month_past, 1)),
        opened=st.opened_cases(t, before=F.add_months(month_past, 1)),
        closed=st.closed_cases(t, before=month_past),
        followups=st.followups(t, before=month_past),
        workers=workers(t),
        violations=rollups.monthly_violations(st.violations(t), before=month_past),
        litigation=rollups.monthly_litigation(rollups.weekly_litigation(st.court_cases(t)), before=month_past),
        tracts=st.tracts(t),
        first_visited=st.first_visited(t),
        issue_types=st.TYPES,
        worker_ids=st.WORKERS,
    )


_MET = "knocks_any = 1 and opens_any = 1"
_UNSEEN = "opens_any is null or opens_any = 0"


def _case_value(column: str) -> str:
    return f"case when {_MET} and {column} is null then 0 else {column} end"


_VIOL = {"count": "v.n", "count_classa": "v.a", "count_classb": "v.b", "count_classc": "v.c", "count_classi": "v.i"}
_VIOL_SQL = ",\n".join(
    [f"cast(coalesce({c}, 0) as bigint) as hpdviols_{n}_this_month" for n, c in _VIOL.items()]
    + [
        f"cast(coalesce({c}, 0) > 0 as integer) as hpdviols_{n.replace('count', 'any')}_this_month"
        for n, c in _VIOL.items()
    ]
)
_COURT = {"housinglitig": "h.n", "housinglitig_tenantaction": "h.tenant", "housinglitig_heatwater": "h.heat"}
_COURT_SQL = ",\n".join(
    [f"cast(coalesce({c}, 0) as bigint) as {n}_count_this_month" for n, c in _COURT.items()]
    + [f"cast(coalesce({c}, 0) > 0 as integer) as {n}_any_this_month" for n, c in _COURT.items()]
)
_CARRIED = "last_value({} ignore nulls) over (partition by address_id order by month_start rows unbounded preceding)"
_WORKER_OUT = ",\n".join(
    f"sp_{w}_thismonth as internal_sp_{w}_any_this_month, {_CARRIED.format(f'sp_{w}_ever')} as internal_sp_{w}_any_ever"
    for w in st.WORKERS
)
_AHEAD = "lead({}) over (partition by address_id order by month_start)"


def _label(value: str) -> str:
    return _AHEAD.format(f"case when {_UNSEEN} then null else ({value}) end")


FULL_PANEL = f"""
with {st.ENTITIES}, {st.VISITS}, {st.ISSUES}, {st.OPENED}, {st.CLOSED}, {st.FOLLOWUPS}, {WORKER_SQL},
{st.VIOLATIONS}, {st.WEEKLY_COURT}, {st.TRACTS}, {st.FIRST_VISITED},
court as (
  select bin_clean, month_start, cast(sum(n) as bigint) as n, cast(sum(tenant) as bigint) as tenant,
         cast(sum(heat) as bigint) as heat from weekly group by 1, 2),
joined as (
  select e.*, m.month_start, f.month_first_canvassed, a.acs_tract_median_rent,
         cast(c.knocks as bigint) as knocks_count, cast(c.knocks > 0 as integer) as knocks_any,
         c.opens as opens_count, cast(c.opens > 0 as integer) as opens_any,
         o.n as opened_count, cast(o.n > 0 as integer) as opened_any, o.n_ever as opened_ever,
         o.legal, o.repair, o.service_access, o.other,
         cl.n as closed_n, cast(cl.n > 0 as integer) as closed_any, cl.nya as closed_nya, cl.n_ever as closed_ever,
         cl.nya_ever as closed_nya_ever,
         fo.n as followups_n, cast(fo.n > 0 as integer) as followups_any,
         {", ".join(f"w.sp_{w}_thismonth, w.sp_{w}_ever" for w in st.WORKERS)}
  from entities e cross join months m
  left join first_visited f on e.internal_zip_static = f.zip
  left join tracts a on cast(e.internal_census_tract_static as bigint) = a.acs_tract_state_county_tract
                    and year(m.month_start) = a.year_tomerge_rounded
  left join visits c on e.address_id = c.address_id and m.month_start = c.month_start
  left join opened o on e.address_id = o.address_id and m.month_start = o.month_start
  left join closed cl on e.address_id = cl.address_id and m.month_start = cl.month_start
  left join followups fo on e.address_id = fo.address_id and m.month_start = fo.month_start
                        and fo.month_start < date '{st.END}'
  left join workers w on e.address_id = w.address_id and m.month_start = w.month_start
  where e.internal_units_static >= 6 and e.internal_bin_static not like '%000000'),
featured as (
  select address_id, internal_bin_static, internal_census_tract_static, internal_zip_static, internal_units_static,
         internal_borough_factor_static, balance_static, acs_tract_median_rent, month_start,
         cast(last_day(month_start) as date) as month_end, cast(month(month_start) as integer) as month,
         cast(year(month_start) as integer) as year,
         cast(case when month(month_start) in (6, 7, 8, 9) then 0 else 1 end as integer) as nyc_heating_season,
         cast(coalesce(month_start >= month_first_canvassed, false) as integer) as internal_peu_target_zip,
         coalesce(knocks_count, 0) as internal_knocks_count_this_month,
         coalesce(knocks_any, 0) as internal_knocks_any_this_month,
         opens_count as internal_opens_count_this_month, opens_any as internal_opens_any_this_month,
         {_case_value("opened_count")} as internal_cases_opened_count_this_month,
         {_case_value("opened_any")} as internal_cases_opened_any_this_month,
         {", ".join(f"{_case_value(x)} as internal_issue_{x}_cases_opened_count_this_month" for x in st.TYPES)},
         closed_n as internal_cases_closed_count_this_month, closed_any as internal_cases_closed_any_this_month,
         closed_nya as internal_nya_cases_closed_count_this_month,
         followups_n as internalfollow_all_followups_count, followups_any as internalfollow_all_followups_any,
         {_CARRIED.format("opened_ever")} as internal_cases_opened_count_ever,
         {_CARRIED.format("closed_ever")} as internal_cases_closed_count_ever,
         {_CARRIED.format("closed_nya_ever")} as internal_nya_cases_closed_count_ever,
         {_WORKER_OUT},
         coalesce({_AHEAD.format("knocks_count")}, 0) as internal_knocks_count_next_month,
         coalesce({_AHEAD.format("knocks_any")}, 0) as internal_knocks_any_next_month,
         {_AHEAD.format("opens_count")} as internal_opens_count_next_month,
         {_AHEAD.format("opens_any")} as internal_opens_any_next_month,
         {_label(_case_value("opened_count"))} as internal_cases_opened_count_next_month,
         {_label(_case_value("opened_any"))} as internal_cases_opened_any_next_month,
         {_label("coalesce(opened_count, 0) / internal_units_static")} as internal_cases_opened_per_unit_next_month,
         {_label("coalesce(opened_count, 0) / opens_count")} as internal_cases_opened_per_open_next_month,
         {_label("coalesce(opened_count, 0) / knocks_count")} as internal_cases_opened_per_knock_next_month
  from joined),
buildings as (
  select d.bin_clean, d.month_start, {_VIOL_SQL}, {_COURT_SQL},
         coalesce(last_value(v.n_ever ignore nulls) over w, 0) as hpdviols_count_ever,
         coalesce(last_value(h.n_ever ignore nulls) over w, 0) as housinglitig_count_ever
  from (select distinct internal_bin_static as bin_clean, month_start from entities cross join months) d
  left join violations v using (bin_clean, month_start)
  left join (select *, cast(sum(n) over (partition by bin_clean order by month_start rows unbounded preceding) as bigint)
                         as n_ever from court) h using (bin_clean, month_start)
  window w as (partition by d.bin_clean order by d.month_start rows unbounded preceding)),
panel as (
  select f.*, b.* exclude (bin_clean, month_start)
  from featured f left join buildings b on f.internal_bin_static = b.bin_clean and f.month_start = b.month_start
  where f.month_start < date '{st.END}')
"""


@query("full_panel", FULL_PANEL + "select * from panel")
def full_panel_query(t):
    return full_panel(t)


_RATIOS = [f"internal_cases_opened_per_{x}_next_month" for x in ("unit", "open", "knock")]


def label_panel(t):
    """The panel with only the visit and case families: labels, target flag, entity columns."""
    return p.build_panel(
        st.entities(t),
        st.START,
        st.END,
        visits=st.visits(t),
        opened=st.opened_cases(t),
        first_visited=st.first_visited(t),
    )


@query(
    "ratio_labels",
    FULL_PANEL
    + f"""
select address_id, month_start, internal_cases_opened_count_next_month, internal_cases_opened_any_next_month,
       {", ".join(f"round({x}, 6) as {x}" for x in _RATIOS)}
from panel where internal_opens_any_next_month is not null
""",
)
def ratio_labels(t):
    labelled = label_panel(t).where(F.col("internal_opens_any_next_month").isNotNull())
    return labelled.select(
        "address_id",
        "month_start",
        "internal_cases_opened_count_next_month",
        "internal_cases_opened_any_next_month",
        *[_six(F.col(x)).alias(x) for x in _RATIOS],
    )


@query(
    "target_flag",
    FULL_PANEL
    + """
select month_start, internal_peu_target_zip, count(*) as entities, cast(sum(internal_units_static) as bigint) as units
from panel group by 1, 2
""",
)
def target_flag(t):
    return label_panel(t).groupBy("month_start", "internal_peu_target_zip").agg(
        F.count(F.lit(1)).alias("entities"), F.sum("internal_units_static").alias("units")
    )


@query(
    "tract_year_join",
    f"""
with {st.ENTITIES}, {st.TRACTS}
select address_id, month_start, internal_zip_static, acs_tract_median_rent
from entities cross join months
left join tracts on cast(internal_census_tract_static as bigint) = acs_tract_state_county_tract
                and year(month_start) = year_tomerge_rounded
where internal_units_static >= 6
""",
)
def tract_year_join(t):
    """Entity-years meet tract facts and take the static columns back by entity; only then the calendar is spread."""
    people = st.entities(t)
    years = p.year_rows(people.where(F.col("internal_units_static").cast("int") >= p.MIN_UNITS), st.START, st.END)
    facts = st.tracts(t)
    joined = years.select("address_id", "internal_census_tract_static", "panel_year").join(
        facts,
        (F.col("internal_census_tract_static").cast("bigint") == F.col("acs_tract_state_county_tract"))
        & (F.col("panel_year") == F.col("year_tomerge_rounded")),
        "left",
    )
    static = people.select("address_id", "internal_zip_static")
    months = F.filter(p.month_spine(st.START, st.END), lambda m: F.year(m) == F.col("panel_year"))
    return p.hashed(joined, "address_id").join(p.hashed(static, "address_id"), "address_id", "left").select(
        "address_id", F.explode(months).alias("month_start"), "internal_zip_static", "acs_tract_median_rent"
    )


@query(
    "building_features",
    FULL_PANEL + "select * from buildings where month_start < date '2001-10-01'",
)
def building_features(t):
    bins = st.entities(t).select(F.col("internal_bin_static").alias("bin_clean"))
    return p.building_panel(
        bins,
        st.START,
        st.END,
        rollups.monthly_violations(st.violations(t)),
        rollups.monthly_litigation(rollups.weekly_litigation(st.court_cases(t))),
    )


# --- scalars ----------------------------------------------------------------------------------------


@query(
    "pad_codes",
    """
select c_custkey, case when length(c) between 1 and 2 then lpad(c, 3, '0') else c end as county,
       case when length(t) between 1 and 5 then lpad(t, 6, '0') else t end as tract,
       '00' || cast(c_custkey % 7 as varchar) || ' Market ' || upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) as shown,
       'resource-' || c as json_id
from (select *, case when c_custkey % 11 = 0 then '' else cast(c_custkey % 1500 as varchar) end as c,
             cast(c_custkey * 37 as varchar) as t from customer)
""",
)
def pad_codes(t):
    county = F.when(F.col("c_custkey") % 11 == 0, "").otherwise((F.col("c_custkey") % 1500).cast("string"))
    rows = t.customer.select(
        "c_custkey",
        county.alias("c"),
        (F.col("c_custkey") * 37).cast("string").alias("tract_text"),
        F.concat_ws("_", F.concat(F.lit("00"), (F.col("c_custkey") % 7).cast("string")), F.lit("market"), F.lower("c_mktsegment")).alias("raw"),
        F.concat(F.lit("https://data/resource/resource-"), county, F.lit(".json?a=1")).alias("link"),
    )
    return rows.select(
        "c_custkey",
        s.county_code("c").alias("county"),
        s.tract_code("tract_text").alias("tract"),
        s.display_name("raw").alias("shown"),
        s.resource_id("link").alias("json_id"),
    )


# --- splits -----------------------------------------------------------------------------------------

_LABEL = "internal_opens_any_next_month"
_SPLIT_LIST = ", ".join(f"date '{d}'" for d in SPLITS)


@query(
    "split_train",
    FULL_PANEL
    + f"""
select address_id, month_start, split_date, {_LABEL} as label, internal_units_static
from panel, (select unnest([{_SPLIT_LIST}]) as split_date)
where {_LABEL} is not null and month_start < split_date
""",
)
def split_train(t):
    return splits.with_train_splits(label_panel(t), SPLITS, _LABEL).select(
        "address_id", "month_start", "split_date", F.col(_LABEL).alias("label"), "internal_units_static"
    )


@query(
    "split_test",
    FULL_PANEL
    + f"""
select address_id, month_start, split_date, {_LABEL} as label, internal_units_static
from panel, (select unnest([{_SPLIT_LIST}]) as split_date)
where internal_peu_target_zip = 1 and month_start >= split_date and month_start < split_date + interval 2 month
""",
)
def split_test(t):
    return splits.with_test_splits(label_panel(t), SPLITS, months=2).select(
        "address_id", "month_start", "split_date", F.col(_LABEL).alias("label"), "internal_units_static"
    )


@query(
    "split_cut_newer",
    FULL_PANEL
    + f"""
select 'train' as part, address_id, month_start, {_LABEL} as label
from panel where {_LABEL} is not null and month_start <= date '{SPLITS[1]}'
union all
select 'test', address_id, month_start, {_LABEL}
from panel where internal_peu_target_zip = 1 and month_start > date '{SPLITS[1]}'
  and month_start <= date '{SPLITS[1]}' + interval 1 month
""",
)
def split_cut_newer(t):
    """The newer boundary: train through the split month, test the month behind it."""
    rows = label_panel(t)
    columns = ["address_id", "month_start", F.col(_LABEL).alias("label")]
    train = splits.train_rows(rows, SPLITS[1], _LABEL, through_split=True)
    test = splits.test_rows(rows, SPLITS[1], after_split=True)
    return train.select(F.lit("train").alias("part"), *columns).unionByName(
        test.select(F.lit("test").alias("part"), *columns)
    )


@query(
    "split_profile",
    FULL_PANEL
    + f"""
select split_date, count(*) as rows, count({_LABEL}) as labelled, cast(sum({_LABEL}) as bigint) as positives,
       round(sum({_LABEL}) / count({_LABEL}), 6) as label_mean
from panel, (select unnest([{_SPLIT_LIST}]) as split_date)
where month_start < split_date group by split_date
""",
)
def split_profile(t):
    profile = splits.train_profile(label_panel(t), SPLITS, _LABEL)
    return profile.withColumn("label_mean", _six(F.col("label_mean")))


@query(
    "split_list",
    """
select cast(m as date) as split_date, count(*) as train_months
from (select unnest(generate_series(min(date_trunc('month', o_orderdate)), max(date_trunc('month', o_orderdate)), interval 1 month)) as m from orders) s
join (select distinct date_trunc('month', o_orderdate) as d from orders) on d <= m group by 1
""",
)
def split_list(t):
    """A split for every month from the first order to the last, with the months up to it that hold orders."""
    first, last = t.orders.agg(F.min("o_orderdate").cast("date"), F.max("o_orderdate").cast("date")).first()
    days = splits.split_dates(first.replace(day=1), last.replace(day=1))
    months = t.orders.select(F.trunc("o_orderdate", "month").alias("month_start")).distinct()
    return splits.with_train_splits(months, days, through_split=True).groupBy("split_date").agg(
        F.count(F.lit(1)).alias("train_months")
    )
