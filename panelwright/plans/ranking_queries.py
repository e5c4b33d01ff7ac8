"""Ranks, curves, capacity metrics and capacity lists on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwright.operators import evaluate, order_stats, ranking
from panelwright.plans import standins as st
from panelwright.plans.catalog import query
from panelwright.plans.panel_queries import FULL_PANEL, label_panel

GROUP = ["model_id", "as_of_date"]
KS = [50, 200, 1000, 5645]


def _six(c):
    return F.round(c, 6)


# --- documents scored by a fixed expression: language stands for the model, source for the month ------


def scored_documents(t):
    """Partly labelled scores; scores tie often, labels are missing for about 60 in 100."""
    known = t.labels.select("doc_id", "quality")
    return t.documents.select("doc_id", "lang", "source", "n_chars").join(known, "doc_id", "left").select(
        F.col("lang").alias("model_id"),
        F.col("source").alias("as_of_date"),
        F.col("doc_id").alias("entity_id"),
        (((F.col("doc_id") * 7919 + F.col("n_chars")) % 100) / 100.0).alias("score"),
        (F.lit(1) + F.col("n_chars") % 40).alias("units"),
        F.col("quality").alias("label"),
    )


SCORED_DOCUMENTS = """
scored as (
  select lang as model_id, source as as_of_date, doc_id as entity_id,
         ((doc_id * 7919 + n_chars) % 100) / 100.0::double as score, 1 + n_chars % 40 as units, quality as label
  from documents left join labels using (doc_id))
"""

CURVES = """
filled as (
  select *, coalesce(label, 0) as l0, coalesce(label, 1) as l1, 1 - coalesce(label, 1) as flip,
         (label is null)::int as missing from scored),
ranked as (
  select *, row_number() over w as row_number, sum(units) over w as num_units_so_far,
         sum(l0) over w as c_l0, sum(l1) over w as c_l1, sum(flip) over w as c_flip, sum(missing) over w as c_missing,
         count(*) over g as t_rows, sum(l0) over g as t_l0, sum(l1) over g as t_l1, sum(flip) over g as t_flip
  from filled
  window w as (partition by model_id, as_of_date order by score desc, units desc, entity_id rows unbounded preceding),
         g as (partition by model_id, as_of_date)),
known as (
  select *, row_number() over w as row_number, sum(units) over w as num_units_so_far, sum(l0) over w as c_l0,
         count(*) over g as t_rows, sum(l0) over g as t_l0
  from filled where label is not null
  window w as (partition by model_id, as_of_date order by score desc, units desc, entity_id rows unbounded preceding),
         g as (partition by model_id, as_of_date)),
curve as (
  select model_id, as_of_date, entity_id, row_number, cast(num_units_so_far as bigint) as num_units_so_far,
         row_number / t_rows as k_proportion,
         coalesce(c_l0 / nullif(row_number - c_missing, 0), 0) as precision_all,
         coalesce(c_l0 / row_number, 0) as precision_all_all,
         c_l1 / row_number as precision_upper_bound, c_l0 / row_number as precision_lower_bound,
         c_l0 / nullif(t_l0, 0) as recall_all, c_flip / nullif(t_flip, 0) as recall_of_0_all,
         c_l1 / nullif(t_l1, 0) as recall_imputed_1,
         c_l1 / nullif(c_l1 + t_l0 - c_l0, 0) as recall_upper_bound,
         c_l0 / nullif(c_l0 + t_l1 - c_l1, 0) as recall_lower_bound,
         l0, l1, label, missing
  from ranked)
"""

SCORED = f"{SCORED_DOCUMENTS.strip()}, {CURVES.strip()}"

_CURVE = ["precision_all", "precision_all_all", *evaluate.CURVE_METRICS[1:]]


def rounded(df, names):
    return df.select(*[_six(F.col(c)).alias(c) if c in names else c for c in df.columns])


@query(
    "rank_scores",
    """
with scored as (
  select o_orderpriority as model_id, cast(date_trunc('month', o_orderdate) as date) as as_of_date,
         o_orderkey as entity_id, (o_orderkey * 31 % 50) / 50.0::double as score from orders)
select *, cast(floor(rank() over w + (count(*) over (partition by model_id, as_of_date, score) - 1) / 2) as integer) as rank_abs,
       round(cast(floor(rank() over w + (count(*) over (partition by model_id, as_of_date, score) - 1) / 2) as integer)
             / count(*) over (partition by model_id, as_of_date), 6) as rank_pct
from scored window w as (partition by model_id, as_of_date order by score desc)
""",
)
def rank_scores(t):
    scored = t.orders.select(
        F.col("o_orderpriority").alias("model_id"),
        F.trunc("o_orderdate", "month").alias("as_of_date"),
        F.col("o_orderkey").alias("entity_id"),
        ((F.col("o_orderkey") * 31 % 50) / 50.0).alias("score"),
    )
    return rounded(ranking.with_ranks(scored, GROUP), ["rank_pct"])


@query(
    "curve_observed",
    f"""
with {SCORED}
select model_id, as_of_date, entity_id, row_number, cast(num_units_so_far as bigint) as num_units_so_far,
       round(row_number / t_rows, 6) as k_proportion, round(c_l0 / row_number, 6) as precision_not_imputed,
       round(c_l0 / nullif(t_l0, 0), 6) as recall_not_imputed
from known
""",
)
def curve_observed(t):
    curve = ranking.observed_curve(scored_documents(t), "label", GROUP)
    return rounded(curve, ["k_proportion", "precision_not_imputed", "recall_not_imputed"])


@query(
    "curve_bounds",
    f"""
with {SCORED}
select model_id, as_of_date, entity_id, row_number, num_units_so_far, round(k_proportion, 6) as k_proportion,
       {", ".join(f"round({m}, 6) as {m}" for m in _CURVE)}
from curve
""",
)
def curve_bounds(t):
    return rounded(ranking.bounds_curve(scored_documents(t), "label", GROUP), ["k_proportion", *_CURVE])


_K_LIST = ", ".join(map(str, KS))


def _cells(fill: str, truth: str, last: str, op: str) -> str:
    chosen = f"row_number {op} {last}"
    conditions = {
        "true_negative": f"not ({chosen}) and {truth} = 0",
        "false_positive": f"{chosen} and {truth} = 0",
        "false_negative": f"not ({chosen}) and {truth} = 1",
        "true_positive": f"{chosen} and {truth} = 1",
    }
    return ", ".join(f"count(*) filter (where {c}) as confusion_{n}{fill}" for n, c in conditions.items())


def metrics_sql(op: str, scored: str = SCORED_DOCUMENTS, ks: str = f"ks as (select cast(unnest([{_K_LIST}]) as bigint) as top_k)",
                pairs: str = ", ks") -> str:
    """Metrics of a table ``scored`` at each k; ``pairs`` says which k a group has."""
    upper = "(case when row_number <= last_row then l1 else l0 end)"
    lower = "(case when row_number <= last_row then l0 else l1 end)"
    return f"""
with {scored}, {CURVES}, {ks},
last_all as (
  select model_id, as_of_date, top_k,
         coalesce(min(row_number) filter (where num_units_so_far >= top_k), max(row_number)) as last_row
  from curve{pairs} group by all),
last_known as (
  select model_id, as_of_date, top_k,
         coalesce(min(row_number) filter (where num_units_so_far >= top_k), max(row_number)) as last_row
  from known{pairs} group by all),
at_all as (
  select model_id, as_of_date, top_k,
         {", ".join(f"max({m}) filter (where row_number = last_row) as {m}" for m in evaluate.CURVE_METRICS)},
         {_cells("_imputed_1", "l1", "last_row", op)}, {_cells("_imputed_0", "l0", "last_row", op)},
         {_cells("_upper_bound", upper, "last_row", op)}, {_cells("_lower_bound", lower, "last_row", op)}
  from curve join last_all using (model_id, as_of_date) group by all),
at_known as (
  select model_id, as_of_date, top_k, sum(label) / count(*) as precision_baseline,
         max(c_l0 / row_number) filter (where row_number = last_row) as precision_no_imputed,
         max(c_l0 / nullif(t_l0, 0)) filter (where row_number = last_row) as recall_not_imputed,
         {_cells("_no_impute", "label", "last_row", op)}
  from known join last_known using (model_id, as_of_date) group by all),
metrics as (select * from at_all left join at_known using (model_id, as_of_date, top_k))
"""


PLAIN = ["precision_baseline", "precision_no_imputed", "recall_not_imputed", *evaluate.CURVE_METRICS]
_COUNTS = [f"confusion_{cell}{fill}" for fill in evaluate.FILLS for cell in evaluate.CELLS]
_KEYS = [*GROUP, "top_k"]


@query(
    "metrics_at_k",
    metrics_sql("<") + f"select {', '.join(_KEYS)}, {', '.join(f'round({m}, 6) as {m}' for m in PLAIN)} from metrics",
)
def metrics_at_k(t):
    return rounded(evaluate.metrics_at_k(scored_documents(t), "label", KS, GROUP).select(*_KEYS, *PLAIN), PLAIN)


@query("confusion_at_k", metrics_sql("<") + f"select {', '.join(_KEYS + _COUNTS)} from metrics")
def confusion_at_k(t):
    return evaluate.metrics_at_k(scored_documents(t), "label", KS, GROUP).select(*_KEYS, *_COUNTS)


@query("confusion_at_k_inclusive", metrics_sql("<=") + f"select {', '.join(_KEYS + _COUNTS)} from metrics")
def confusion_at_k_inclusive(t):
    return evaluate.metrics_at_k(scored_documents(t), "label", KS, GROUP, inclusive=True).select(*_KEYS, *_COUNTS)


LONG_METRICS = f"""
, typed as (
  select model_id, as_of_date, cast(top_k as varchar) as top_k,
         {", ".join(f"cast({m} as double) as {m}" for m in PLAIN + _COUNTS)} from metrics),
evaluations as (
  select model_id, as_of_date, metric, 'NotApplicable' as parameters, round(value, 6) as value,
         'test_split' as test_matrix_name, top_k
  from typed unpivot include nulls (value for metric in ({", ".join(PLAIN + _COUNTS)})))
"""
METRIC_ROWS_SQL = metrics_sql("<") + LONG_METRICS


def evaluation_rows(t):
    wide = evaluate.metrics_at_k(scored_documents(t), "label", KS, GROUP)
    return evaluate.metric_rows(wide, GROUP, "test_split")


@query("metrics_long", METRIC_ROWS_SQL + "select * from evaluations")
def metrics_long(t):
    return rounded(evaluation_rows(t), ["value"])


_LABEL = "internal_cases_opened_any_next_month"


@query(
    "capacity_list",
    FULL_PANEL
    + f"""
, observed as (
  select month_start, sum(internal_units_static) as units from panel
  where {_LABEL} is not null and internal_borough_factor_static in (0, 1, 2) group by month_start)
select cast(s as double) as share, cast(round_even(s * (select avg(units) from observed), 0) as bigint) as top_k
from (select unnest([{", ".join(map(str, evaluate.CAPACITY_SHARES))}]::double[]) as s)
""",
)
def capacity_list(t):
    test = label_panel(t).where(F.col("internal_borough_factor_static").isin(0, 1, 2))
    return evaluate.capacity_list(test, _LABEL, "internal_units_static")


@query(
    "capacity_per_month",
    f"""
with {st.VISITS}, {st.ENTITIES}
select month_start, cast(sum(internal_units_static) as bigint) as units_canvassed,
       cast(sum(internal_units_static) // 2 as bigint) as top_k
from visits join entities using (address_id) group by month_start
""",
)
def capacity_per_month(t):
    people = st.entities(t).select("address_id", "internal_units_static")
    visited = st.visits(t).join(people, "address_id").groupBy("month_start").agg(
        F.sum("internal_units_static").alias("units_canvassed")
    )
    return evaluate.half_of_visited(visited)


@query(
    "labelled_months",
    FULL_PANEL
    + f"""
select month_start, count({_LABEL}) as labelled, cast(count({_LABEL}) = 0 as integer) as skip
from panel group by 1
""",
)
def labelled_months(t):
    months = evaluate.labelled_per_month(label_panel(t), _LABEL)
    return months.select("*", (F.col("labelled") == 0).cast("int").alias("skip"))


@query(
    "skip_unlabelled_months",
    FULL_PANEL
    + f"""
select month_start, count(*) as rows from panel
where month_start in (select month_start from panel group by 1 having count({_LABEL}) > 0) group by 1
""",
)
def skip_unlabelled_months(t):
    kept = evaluate.drop_unlabelled_months(label_panel(t), _LABEL)
    return kept.groupBy("month_start").agg(F.count(F.lit(1)).alias("rows"))


# --- orders scored per month: two models, units from the customer ----------------------------------


def scored_customers(t, factor: int):
    """Customers visited in a month, scored by a fixed expression of their orders."""
    people = st.entities(t).select(F.col("address_id").alias("entity_id"), F.col("internal_units_static").alias("units"))
    visits = t.orders.groupBy(F.trunc("o_orderdate", "month").alias("as_of_date"), F.col("o_custkey").alias("entity_id")).agg(
        F.count(F.lit(1)).alias("n")
    )
    score = ((F.col("entity_id") * factor + F.col("n")) % 97) / 97.0
    return visits.join(people, "entity_id").select("as_of_date", "entity_id", "units", score.alias("score"))


def _customer_sql(name: str, factor: int) -> str:
    return f"""
{name} as (
  select as_of_date, entity_id, units, score, sum(units) over (partition by as_of_date
           order by score desc, units desc, entity_id rows unbounded preceding) as so_far
  from (select cast(date_trunc('month', o_orderdate) as date) as as_of_date, o_custkey as entity_id,
               any_value(internal_units_static) as units, ((o_custkey * {factor} + count(*)) % 97) / 97.0::double as score
        from orders join entities on o_custkey = address_id group by 1, 2))
"""


CAPACITY = 400


@query(
    "topk_entities",
    f"""
with {st.ENTITIES}, {_customer_sql("scored", 13)}
select as_of_date, entity_id, units, score, cast(so_far as bigint) as num_units_so_far
from scored where so_far - units < {CAPACITY}
""",
)
def topk_entities(t):
    return ranking.within_capacity(scored_customers(t, 13), CAPACITY, ["as_of_date"])


@query(
    "topk_places",
    f"""
with {st.ENTITIES}, {_customer_sql("scored", 13)}
select as_of_date, entity_id, score, internal_zip_static, balance_static
from scored join entities on entity_id = address_id where so_far - units < {CAPACITY}
""",
)
def topk_places(t):
    """The top-k list with the places of its entities: attached to the few listed rows, not to the ranked ones."""
    listed = ranking.within_capacity(scored_customers(t, 13), CAPACITY, ["as_of_date"])
    places = st.entities(t).select(F.col("address_id").alias("entity_id"), "internal_zip_static", "balance_static")
    return listed.join(places, "entity_id").select("as_of_date", "entity_id", "score", "internal_zip_static", "balance_static")


@query(
    "topk_overlap",
    f"""
with {st.ENTITIES}, {_customer_sql("a", 13)}, {_customer_sql("b", 29)},
x as (select as_of_date, entity_id, 1 as a from a where so_far - units < {CAPACITY}),
y as (select as_of_date, entity_id, 1 as b from b where so_far - units < {CAPACITY})
select as_of_date, count(*) filter (where a = 1 and b = 1) as in_both, count(*) as in_any,
       round(count(*) filter (where a = 1 and b = 1) / count(*), 6) as jaccard
from x full join y using (as_of_date, entity_id) group by 1
""",
)
def topk_overlap(t):
    first = ranking.within_capacity(scored_customers(t, 13), CAPACITY, ["as_of_date"])
    second = ranking.within_capacity(scored_customers(t, 29), CAPACITY, ["as_of_date"])
    return rounded(ranking.list_overlap(first, second), ["jaccard"])


@query(
    "score_histogram",
    """
select o_orderpriority as model_id, cast(least(floor(score * 20) + 1, 20) as bigint) as bin, count(*) as n
from (select o_orderpriority, (o_orderkey * 31 % 64) / 64.0::double as score from orders) group by 1, 2
""",
)
def score_histogram(t):
    scored = t.orders.select(
        F.col("o_orderpriority").alias("model_id"), ((F.col("o_orderkey") * 31 % 64) / 64.0).alias("score")
    )
    return evaluate.score_histogram(scored, 20, ["model_id"])


@query(
    "confusion_counts",
    """
select lang, count(*) filter (where quality = 0 and p = 0) as true_negative,
       count(*) filter (where quality = 0 and p = 1) as false_positive,
       count(*) filter (where quality = 1 and p = 0) as false_negative,
       count(*) filter (where quality = 1 and p = 1) as true_positive
from (select lang, quality, (n_chars > 500)::int as p from documents left join labels using (doc_id)) group by lang
""",
)
def confusion_counts(t):
    joined = t.documents.select("doc_id", "lang", (F.col("n_chars") > 500).cast("int").alias("p")).join(
        t.labels.select("doc_id", "quality"), "doc_id", "left"
    )
    return evaluate.confusion(joined, "quality", "p", ["lang"])


@query(
    "baseline_precision",
    f"with {SCORED} select model_id, as_of_date, round(avg(label), 6) as precision_baseline from scored group by 1, 2",
)
def baseline_precision(t):
    return rounded(evaluate.baseline_precision(scored_documents(t), "label", GROUP), ["precision_baseline"])


@query(
    "units_for_test_rows",
    f"""
with {st.ENTITIES}, {st.VISITS}
select v.address_id, v.month_start, e.internal_units_static as units
from visits v left join (select * from entities where internal_units_static >= 6 and internal_zip_static % 2 = 0) e
  using (address_id)
""",
)
def units_for_test_rows(t):
    people = st.entities(t).withColumn("internal_peu_target_zip_static", (F.col("internal_zip_static") % 2 == 0).cast("int"))
    test = st.visits(t).select("address_id", "month_start")
    return evaluate.with_units(test, people, target="internal_peu_target_zip_static")


@query(
    "quantile_label",
    """
with per as (select o_custkey as address_id, count(*) as n, count(*) / (1 + o_custkey % 50) as label from orders group by 1)
select address_id, round(label, 6) as label,
       cast(label > (select quantile_cont(label, 0.9) from per) as integer) as label_higher,
       cast(label > (select quantile_cont(label, 0.75) from per) as integer) as label_lower
from per
""",
)
def quantile_label(t):
    per = t.orders.groupBy(F.col("o_custkey").alias("address_id")).agg(F.count(F.lit(1)).alias("n"))
    labelled = per.select("address_id", (F.col("n") / (F.lit(1) + F.col("address_id") % 50)).alias("label"))
    both = labelled
    for q, name in ((0.9, "label_higher"), (0.75, "label_lower")):
        both = order_stats.label_over_quantile(both, "label", order_stats.label_quantile(labelled, "label", q), name)
    return rounded(both, ["label"])
