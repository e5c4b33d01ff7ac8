"""The driver tables in the roles the operators expect, with the same roles as SQL.

customer is the entity table, ten customers share a building; orders are visits and cases; lineitem
holds issues and follow-ups of a case; suppliers are workers; nations are census tracts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.functions.scalars import flag, month_of
from panelwright.operators import rollups

START, LAST, END = "1995-01-01", "2001-08-01", "2001-09-01"
WORKERS = list(range(10))
CASE_PRIORITIES = ["1-URGENT", "2-HIGH"]


def opened() -> Column:
    return F.col("o_orderstatus").isin("F", "P")


def is_case() -> Column:
    return F.col("o_orderpriority").isin(CASE_PRIORITIES)


def entities(t) -> DataFrame:
    number = F.expr("c_custkey div 10")
    return t.customer.select(
        F.col("c_custkey").alias("address_id"),
        F.concat(number.cast("string"), F.when(number % 97 == 0, "000000").otherwise("")).alias("internal_bin_static"),
        (F.lit(1000) + F.col("c_nationkey")).cast("string").alias("internal_census_tract_static"),
        (F.lit(10000) + F.col("c_custkey") % 200).cast("int").alias("internal_zip_static"),
        (F.lit(1) + F.col("c_custkey") % 50).cast("int").alias("internal_units_static"),
        (F.col("c_nationkey") % 5).alias("internal_borough_factor_static"),
        F.col("c_acctbal").alias("balance_static"),
    )


ENTITIES = """
entities as (
  select c_custkey as address_id,
         cast(c_custkey // 10 as varchar) || case when (c_custkey // 10) % 97 = 0 then '000000' else '' end
           as internal_bin_static,
         cast(1000 + c_nationkey as varchar) as internal_census_tract_static,
         cast(10000 + c_custkey % 200 as integer) as internal_zip_static,
         cast(1 + c_custkey % 50 as integer) as internal_units_static,
         c_nationkey % 5 as internal_borough_factor_static,
         c_acctbal as balance_static
  from customer),
months as (
  select cast(unnest(generate_series(date '1995-01-01', date '2001-09-01', interval 1 month)) as date) as month_start)
"""


def visits(t, before=None) -> DataFrame:
    rows = t.orders.withColumnRenamed("o_custkey", "address_id")
    return rollups.monthly_visits(rows, "address_id", "o_orderdate", F.lit(True), opened(), is_case(), before)


VISITS = """
visits as (
  select o_custkey as address_id, cast(date_trunc('month', o_orderdate) as date) as month_start,
         count(*) as knocks, count(*) filter (where o_orderstatus in ('F', 'P')) as opens,
         count(*) filter (where o_orderpriority in ('1-URGENT', '2-HIGH')) as cases
  from orders group by all)
"""


def contacts(t) -> DataFrame:
    return t.customer.select(F.col("c_custkey").alias("contact_id"), F.col("c_custkey").alias("address_id"))


def issues(t) -> DataFrame:
    kind = (
        F.when(F.col("l_returnflag") == "A", "Legal")
        .when(F.col("l_returnflag") == "R", "Repairs")
        .when(F.col("l_quantity") > 25, "Service/Access")
        .otherwise("Other")
    )
    outcome = F.when(F.col("l_linestatus") == "F", "Resolved").otherwise("Pending")
    return rollups.case_issues(t.lineitem.withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey", kind, outcome)


ISSUES = """
issues as (
  select l_orderkey as o_orderkey, count(*) as issues,
         count(*) filter (where kind = 'Legal') as legal_issues,
         count(*) filter (where kind = 'Repairs') as repair_issues,
         count(*) filter (where kind = 'Service/Access') as service_access_issues,
         count(*) filter (where kind = 'Other') as other_issues,
         count(*) filter (where l_linestatus = 'F') as resolved_issues,
         count(*) filter (where l_linestatus <> 'F') as unresolved_issues
  from (select *, case when l_returnflag = 'A' then 'Legal' when l_returnflag = 'R' then 'Repairs'
                       when l_quantity > 25 then 'Service/Access' else 'Other' end as kind from lineitem)
  group by l_orderkey)
"""

TYPES = list(rollups.ISSUE_TYPES)


def opened_cases(t, before=None) -> DataFrame:
    cases = t.orders.where(is_case()).select("o_orderkey", F.col("o_custkey").alias("contact_ref"), "o_orderdate")
    located = rollups.with_location(cases, "contact_ref", contacts(t), "contact_id", "address_id")
    return rollups.opened_cases(located, issues(t), "o_orderkey", "address_id", "o_orderdate", TYPES, before)


OPENED = """
opened as (
  select *, cast(sum(n) over (partition by address_id order by month_start rows unbounded preceding) as bigint) as n_ever
  from (
    select c_custkey as address_id, cast(date_trunc('month', o_orderdate) as date) as month_start, count(*) as n,
           count(*) filter (where legal_issues > 0) as legal,
           count(*) filter (where repair_issues > 0) as repair,
           count(*) filter (where service_access_issues > 0) as service_access,
           count(*) filter (where other_issues > 0) as other
    from orders left join customer on o_custkey = c_custkey left join issues using (o_orderkey)
    where o_orderpriority in ('1-URGENT', '2-HIGH') group by 1, 2))
"""


def no_answer() -> Column:
    return flag(F.col("o_orderpriority") == "3-MEDIUM")


def closed_cases(t, before=None) -> DataFrame:
    cases = t.orders.where(F.col("o_orderstatus") == "F").withColumnRenamed("o_custkey", "contact_ref")
    located = rollups.with_location(cases, "contact_ref", contacts(t), "contact_id", "address_id")
    return rollups.closed_cases(located, "o_orderkey", "address_id", "o_orderdate", no_answer(), before)


CLOSED = """
closed as (
  select *, cast(sum(n) over w as bigint) as n_ever, cast(sum(nya) over w as bigint) as nya_ever
  from (
    select c_custkey as address_id, cast(date_trunc('month', o_orderdate) as date) as month_start,
           count(*) as n, count(*) filter (where o_orderpriority = '3-MEDIUM') as nya
    from orders left join customer on o_custkey = c_custkey where o_orderstatus = 'F' group by 1, 2)
  window w as (partition by address_id order by month_start rows unbounded preceding))
"""


def followups(t, before=None) -> DataFrame:
    """Follow-up -> case -> contact; the case side is cut to two columns before the join."""
    rows = t.lineitem.select(F.col("l_orderkey").alias("case_ref"), "l_shipdate")
    cases = t.orders.select(F.col("o_orderkey").alias("case_ref"), F.col("o_custkey").alias("contact_ref"))
    located = rollups.with_location(
        rows.join(cases, "case_ref", "left"), "contact_ref", contacts(t), "contact_id", "address_id"
    )
    return rollups.monthly_followups(located, "case_ref", "address_id", "l_shipdate", before)


FOLLOWUPS = """
followups as (
  select c_custkey as address_id, cast(date_trunc('month', l_shipdate) as date) as month_start, count(l_orderkey) as n
  from lineitem left join orders on l_orderkey = o_orderkey left join customer on o_custkey = c_custkey group by 1, 2)
"""


def handled_cases(t) -> DataFrame:
    lines = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey")
    return t.orders.select("o_orderkey", F.col("o_custkey").alias("address_id"), "o_orderdate").join(lines, "o_orderkey")


def violations(t) -> DataFrame:
    return t.orders.select(
        F.expr("cast(o_custkey div 10 as string)").alias("bin_clean"),
        month_of("o_orderdate").alias("month_start"),
        flag(F.col("o_orderstatus") == "F").alias("hpdviols_count_classa"),
        flag(F.col("o_orderstatus") == "O").alias("hpdviols_count_classb"),
        flag(F.col("o_orderpriority") == "1-URGENT").alias("hpdviols_count_classc"),
        flag(F.col("o_orderpriority") == "5-LOW").alias("hpdviols_count_classi"),
    )


VIOLATIONS = """
violations as (
  select *, cast(sum(n) over (partition by bin_clean order by month_start rows unbounded preceding) as bigint) as n_ever
  from (
    select cast(o_custkey // 10 as varchar) as bin_clean, cast(date_trunc('month', o_orderdate) as date) as month_start,
           count(*) as n, count(*) filter (where o_orderstatus = 'F') as a, count(*) filter (where o_orderstatus = 'O') as b,
           count(*) filter (where o_orderpriority = '1-URGENT') as c, count(*) filter (where o_orderpriority = '5-LOW') as i
    from orders group by 1, 2))
"""


def court_cases(t) -> DataFrame:
    """Litigation by building, with the date as text in the raw format."""
    return t.orders.where(F.col("o_orderstatus") != "O").select(
        F.expr("o_custkey div 10").alias("bin"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "Heat and Hot Water")
        .when(F.col("o_orderpriority") == "2-HIGH", "Tenant Action/Harrassment")
        .otherwise("Access Warrant")
        .alias("casetype"),
        F.date_format("o_orderdate", "MM--dd-yyyy").alias("caseopendate"),
    )


WEEKLY_COURT = """
weekly as (
  select *, cast(sum(n) over (partition by bin_clean order by week_start, month_start rows unbounded preceding) as bigint)
              as n_ever
  from (
    select cast(o_custkey // 10 as varchar) as bin_clean, cast(date_trunc('week', o_orderdate) as date) as week_start,
           cast(date_trunc('month', o_orderdate) as date) as month_start, count(*) as n,
           count(*) filter (where o_orderpriority = '2-HIGH') as tenant,
           count(*) filter (where o_orderpriority = '1-URGENT') as heat
    from orders where o_orderstatus <> 'O' group by 1, 2, 3))
"""


def tracts(t) -> DataFrame:
    years = F.explode(F.sequence(F.lit(1995), F.lit(2000)))
    return t.nation.select((F.lit(1000) + F.col("n_nationkey")).cast("bigint").alias("acs_tract_state_county_tract"),
                           "n_nationkey", years.alias("year_tomerge_rounded")).select(
        "acs_tract_state_county_tract",
        "year_tomerge_rounded",
        (F.col("n_nationkey") * 10.0 + F.col("year_tomerge_rounded") - 1995).alias("acs_tract_median_rent"),
    )


TRACTS = """
tracts as (
  select cast(1000 + n_nationkey as bigint) as acs_tract_state_county_tract,
         cast(y as integer) as year_tomerge_rounded,
         cast(n_nationkey * 10 + y - 1995 as double) as acs_tract_median_rent
  from nation, range(1995, 2001) r(y))
"""


def first_visited(t) -> DataFrame:
    """First month with a large order per zip; zips without one stay out."""
    big = t.orders.where(F.col("o_totalprice") > 495000)
    return big.groupBy((F.lit(10000) + F.col("o_custkey") % 200).cast("string").alias("zip")).agg(
        F.min(month_of("o_orderdate")).alias("month_first_canvassed")
    )


FIRST_VISITED = """
first_visited as (
  select cast(10000 + o_custkey % 200 as integer) as zip,
         min(cast(date_trunc('month', o_orderdate) as date)) as month_first_canvassed
  from orders where o_totalprice > 495000 group by 1)
"""
