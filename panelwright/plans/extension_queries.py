"""The panel extended month by month, against the panel built at once."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.operators import rollups
from panelwright.plans import month_extension as ext
from panelwright.plans import standins as st
from panelwright.plans.catalog import query
from panelwright.plans.panel_queries import FULL_PANEL
from panelwright.session import shared_dir

BEFORE, MONTHS = "2001-04-01", 3
SHOWN = [
    "internal_knocks_count_this_month", "internal_cases_opened_count_this_month", "internal_cases_opened_count_ever", "internal_cases_closed_count_ever",
    "hpdviols_count_this_month", "hpdviols_count_ever", "internal_knocks_count_next_month", "internal_opens_any_next_month", "internal_cases_opened_count_next_month",
]


class Between:
    """The driver tables with the orders of some months only; the dates reach the scan."""

    def __init__(self, t, first: str, last: str):
        self._t, self._first, self._last = t, first, last

    def __getattr__(self, name: str) -> DataFrame:
        rows = getattr(self._t, name)
        if name != "orders":
            return rows
        day = F.col("o_orderdate")
        return rows.where((day >= F.lit(self._first).cast("date")) & (day < F.add_months(F.lit(self._last).cast("date"), 1)))


def panel_rollups(t) -> dict[str, ext.Rollup]:
    ever = {"internal_cases_opened_ever_count": "sum"}
    closed = {"internal_cases_closed_ever_count": "sum", "internal_nya_cases_closed_ever_count": "sum"}
    return {
        "visits": ext.Rollup(lambda a, b: st.visits(Between(t, a, b))),
        "opened": ext.Rollup(lambda a, b: st.opened_cases(Between(t, a, b)), running=ever),
        "closed": ext.Rollup(lambda a, b: st.closed_cases(Between(t, a, b)), running=closed),
        "violations": ext.Rollup(lambda a, b: rollups.monthly_violations(st.violations(Between(t, a, b))), "bin_clean", {"hpdviols_ever_count": "sum"}),
    }


@query(
    "panel_extended",
    FULL_PANEL
    + f"""
select address_id, month_start, {", ".join(SHOWN)} from panel
where month_start >= date '{BEFORE}' - interval 2 month and month_start < date '{BEFORE}' + interval {MONTHS} month
""",
)
def panel_extended(t):
    """A panel up to one month, extended by three: the months before, those extended, and their labels as in the panel built at once."""
    folder = f"{shared_dir(t.spark)}/panel_{uuid4().hex}"
    parts = panel_rollups(t)
    ext.start(folder, parts, st.START, BEFORE, st.entities(t))
    for _ in range(MONTHS):
        ext.extend(folder, parts, st.entities(t))
    first, last = (F.add_months(F.lit(BEFORE).cast("date"), n) for n in (-2, MONTHS))
    rows = ext.stored_panel(t.spark, folder)
    return rows.where((F.col("month_start") >= first) & (F.col("month_start") < last)).select("address_id", "month_start", *SHOWN)
