"""Column expressions: codes, dates, flags, labels and guarded ratios."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# They must equal the published conventions for right results.
CASE_DATE_FORMAT = "MM--dd-yyyy"
HEATING_MONTHS = [10, 11, 12, 1, 2, 3, 4, 5]
RESOLVED_OUTCOMES = ["Resolved", "Resolved by Legal", "Enrolled"]
RESOURCE_LINK = r"(resource/)(.*)(\.json)"
COUNTY_WIDTH = 3
TRACT_WIDTH = 6


def as_col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


# --- codes and text ---------------------------------------------------------------------------

def pad_short(code, width: int) -> Column:
    """Left-pad with zeros; empty and longer codes stay as they are (a bare lpad would cut them)."""
    c = as_col(code)
    return F.when(F.length(c).between(1, width - 1), F.lpad(c, width, "0")).otherwise(c)


def county_code(code) -> Column:
    return pad_short(code, COUNTY_WIDTH)


def tract_code(code) -> Column:
    return pad_short(code, TRACT_WIDTH)


def resource_id(link) -> Column:
    """Dataset id between 'resource/' and the last '.json'; empty when the link has another form."""
    return F.regexp_extract(as_col(link), RESOURCE_LINK, 2)


def display_name(name) -> Column:
    """Underscores to spaces, each run of letters capitalised (also after digits)."""
    runs = F.regexp_extract_all(F.replace(as_col(name), F.lit("_"), F.lit(" ")), F.lit(r"(\p{L}+|\P{L}+)"))
    cased = F.transform(runs, lambda run: F.concat(F.upper(F.left(run, F.lit(1))), F.lower(F.substr(run, F.lit(2)))))
    return F.array_join(cased, "")


def model_key(algorithm, hyperparameters, separator: str = "_") -> Column:
    return F.concat_ws(separator, as_col(algorithm), as_col(hyperparameters))


# --- dates ------------------------------------------------------------------------------------

def case_date(text, fmt: str = CASE_DATE_FORMAT) -> Column:
    """Parse a text date; null when it does not match the format."""
    return F.try_to_date(as_col(text), fmt)


def month_of(day) -> Column:
    return F.trunc(as_col(day), "month")


def week_of(day) -> Column:
    """Monday of the week."""
    return F.trunc(as_col(day), "week")


def month_end(day) -> Column:
    return F.last_day(as_col(day))


# --- flags and null handling --------------------------------------------------------------------

def flag(condition: Column) -> Column:
    """0/1 integer; a null condition is 0."""
    return F.when(condition, 1).otherwise(0)


def zero(value) -> Column:
    return F.coalesce(as_col(value), F.lit(0))


def heating_season(month_number) -> Column:
    return flag(as_col(month_number).isin(HEATING_MONTHS))


def target_flag(month, first_month) -> Column:
    """1 from the area's first visited month on; 0 before it and where the area was never visited."""
    first = as_col(first_month)
    return F.when(first.isNull() | (as_col(month) < first), 0).otherwise(1)


# --- labels -------------------------------------------------------------------------------------

def observed(opens_any, value: Column) -> Column:
    """value where a door was opened that month, else null."""
    opened = as_col(opens_any)
    return F.when(opened.isNull() | (opened == 0), None).otherwise(value)


def observed_cases(knocks_any, opens_any, cases) -> Column:
    """Cases where a door opened: null when none opened, 0 when one opened and no case followed."""
    met = (as_col(knocks_any) == 1) & (as_col(opens_any) == 1)
    count = as_col(cases)
    return observed(opens_any, F.when(met & count.isNull(), 0).otherwise(count))


def observed_ratio(knocks_any, opens_any, cases, per) -> Column:
    """Cases per unit, per open or per knock, on the same condition; x/0 gives null."""
    met = (as_col(knocks_any) == 1) & (as_col(opens_any) == 1)
    count = as_col(cases)
    share = F.try_divide(count.cast("double"), as_col(per).cast("double"))
    return observed(opens_any, F.when(met & count.isNull(), F.lit(0.0)).otherwise(share))


def cases_this_month(knocks_any, opens_any, cases) -> Column:
    """0 where a door opened and no case followed; otherwise the count, also without a visit."""
    met = (as_col(knocks_any) == 1) & (as_col(opens_any) == 1)
    count = as_col(cases)
    return F.when(met & count.isNull(), 0).otherwise(count)


# --- ratios -------------------------------------------------------------------------------------

def ratio(numerator, denominator) -> Column:
    return F.try_divide(as_col(numerator), as_col(denominator))


def guarded_ratio(numerator, denominator) -> Column:
    """100 where only the denominator is 0, 0 where both are 0, else the ratio."""
    n, d = as_col(numerator), as_col(denominator)
    return (
        F.when((d == 0) & (n != 0), F.lit(100.0))
        .when((d == 0) & (n == 0), F.lit(0.0))
        .otherwise(F.try_divide(n, d))
    )
