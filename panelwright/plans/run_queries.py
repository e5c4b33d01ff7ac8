"""The whole model run into a new results store, on the driver tables."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from panelwright.operators import encode, models, registry
from panelwright.operators.impute import BOROUGH, ZEROS
from panelwright.plans import model_run
from panelwright.plans import ranking_queries as rq
from panelwright.plans.catalog import query
from panelwright.session import durable, shared_dir

LABEL = "internal_opens_any_next_month"
FEATURE = "internal_finished_any_this_month"
DAYS = ["1999-01-01", "2000-06-01", "2001-07-01"]

_VISITS = f"""
visits as (
  select o_custkey as address_id, cast(date_trunc('month', o_orderdate) as date) as month_start,
         max(cast(o_orderstatus = 'F' as integer)) as finished,
         case when (o_custkey + month(date_trunc('month', o_orderdate))) % 4 <> 0 and date_trunc('month', o_orderdate) < date '{DAYS[-1]}'
              then max(cast(o_orderstatus = 'F' or o_orderpriority = '1-URGENT' as integer)) end as label,
         cast(1 + o_custkey % 50 as integer) as units
  from orders group by 1, 2, date_trunc('month', o_orderdate)),
limits as (select month_start, sum(units) // 2 as top_k from visits group by 1)
"""


def _visits(t):
    """Customers in the months they ordered: one 0/1 feature, a 0/1 label that a quarter of the rows and the last months lack."""
    month = F.trunc("o_orderdate", "month").alias("month_start")
    known = ((F.col("address_id") + F.month("month_start")) % 4 != 0) & (F.col("month_start") < F.lit(DAYS[-1]).cast("date"))
    rows = t.orders.groupBy(F.col("o_custkey").alias("address_id"), month).agg(
        F.max((F.col("o_orderstatus") == "F").cast("int")).alias(FEATURE),
        F.max(((F.col("o_orderstatus") == "F") | (F.col("o_orderpriority") == "1-URGENT")).cast("int")).alias("status"),
    )
    return durable(
        rows.select(
            "address_id", "month_start", FEATURE, F.when(known, F.col("status")).alias(LABEL),
            (F.lit(1) + F.col("address_id") % 50).cast("int").alias("internal_units_static"),
            (F.col("address_id") % 3).cast("string").alias(BOROUGH), F.lit(1).alias("internal_peu_target_zip"),
        )
    )


def _run(t):
    """A store after four calls: two label methods, each called twice. The second call of each adds nothing."""
    panel, folder = _visits(t), f"{shared_dir(t.spark)}/results_{uuid4().hex}"
    visited = panel.groupBy("month_start").agg(F.sum("internal_units_static").alias("units_canvassed"))
    added = []
    for method in ("none", "none", ZEROS, ZEROS):
        settings = model_run.Settings(LABEL, [FEATURE], feature_list_name="finished", label_method=method)
        tree = [{"algorithm": "DecisionTreeClassifier", "parameters": {"maxDepth": 1}}]
        added.append(model_run.run(panel, DAYS, tree, visited, folder, settings, f"run_{method}"))
    if added != [2, 0, 2, 0]:
        raise ValueError(f"models added by the calls: {added}")
    return folder


# Models 1 and 2 are fitted on known labels, 3 and 4 on unknown ones as 0; the last split has no label yet.
_SCORED = f"""
{_VISITS.strip()},
fits as (
  select * from (values (1, date '{DAYS[0]}', false), (2, date '{DAYS[1]}', false), (3, date '{DAYS[0]}', true), (4, date '{DAYS[1]}', true)) f(model_id, day, filled)),
weights as (
  select f.model_id, v.finished, avg(case when f.filled then coalesce(v.label, 0) else v.label end) as score
  from fits f join visits v on v.month_start < f.day where f.filled or v.label is not null group by 1, 2),
scored as (
  select cast(f.model_id as bigint) as model_id, v.month_start as as_of_date, v.address_id as entity_id, w.score, v.units, v.label
  from fits f join visits v on v.month_start = f.day join weights w on w.model_id = f.model_id and w.finished = v.finished)
"""
_KS = "ks as (select distinct model_id, as_of_date, cast(top_k as bigint) as top_k from scored join limits on month_start = as_of_date)"


@query(
    "model_run",
    rq.metrics_sql("<", _SCORED, _KS, " join ks using (model_id, as_of_date)")
    + rq.LONG_METRICS
    + "select * replace ('test_split_' || as_of_date || '_features_finished' as test_matrix_name) from evaluations",
)
def model_run_evaluations(t):
    """Evaluation rows of a run over models and splits, called again: a tree on one 0/1 feature scores by the mean label of its value."""
    return rq.rounded(model_run.results(t.spark, _run(t), "evaluations"), ["value"])


@query(
    "model_run_predictions",
    f"""
with {_SCORED},
ranked as (
  select *, rank() over w + (count(*) over (partition by model_id, as_of_date, score) - 1) / 2 as place, count(*) over (partition by model_id, as_of_date) as n
  from scored window w as (partition by model_id, as_of_date order by score desc))
select model_id, as_of_date, 'all' as borough_predicted_for, entity_id, 'train_split_' || as_of_date || '_features_finished' as training_table_name,
       round(score, 6) as score, cast(top_k as bigint) as top_k, cast(label is not null as integer) as label_observed,
       cast(floor(place) as integer) as rank_abs, round(floor(place) / n, 6) as rank_pct
from ranked join limits on month_start = as_of_date
""",
)
def model_run_predictions(t):
    return rq.rounded(model_run.results(t.spark, _run(t), "predictions"), ["score", "rank_pct"])


@query(
    "run_configs",
    """
select o_orderpriority as run_key, unnest(['first', 'orders']) as name,
       unnest(['"' || strftime(min(o_orderdate), '%Y-%m-%d') || '"', cast(count(*) as varchar)]) as value
from orders group by 1
""",
)
def run_configs(t):
    """Parameters of one run per priority, appended twice: the second time changes nothing."""
    folder = f"{shared_dir(t.spark)}/configs_{uuid4().hex}"
    found = t.orders.groupBy("o_orderpriority").agg(F.min("o_orderdate").alias("first"), F.count(F.lit(1)).alias("orders"))
    for r in found.collect():
        for extra in (0, 1):
            registry.append_config(t.spark, folder, r["o_orderpriority"], {"first": r["first"].strftime("%Y-%m-%d"), "orders": r["orders"] + extra})
    return registry.read_configs(t.spark, folder)


# --- sparse features --------------------------------------------------------------------------

_SEGMENTS = """
rows as (
  select c_custkey as entity_id, c_mktsegment as segment, c_nationkey, cast(c_acctbal > 4000 + 200 * (c_custkey % 7) as integer) as label from customer),
kept as (select segment from rows group by 1 having count(*) >= (select count(*) // 6 from rows))
"""


def _segments(t):
    label = (F.col("c_acctbal") > 4000 + 200 * (F.col("c_custkey") % 7)).cast("int")
    rows = t.customer.select(F.col("c_custkey").alias("address_id"), F.col("c_mktsegment").alias("segment"), label.alias("label"))
    return durable(rows)


def _sparse_fit(t):
    rows = _segments(t)
    places = encode.level_places(encode.number_levels(encode.fit_levels(rows, ["segment"], rows.count() // 6)))
    vectors = encode.level_vector(rows, places, ["segment"])
    return vectors, models.fit(vectors, ["levels"], "label", "LogisticRegression", {"maxIter": 200, "tol": 1e-12}), places


@query(
    "sparse_fit_scores",
    f"""
with {_SEGMENTS}
select entity_id as address_id, label, round(avg(label) over (partition by case when segment in (select segment from kept) then segment end), 3) as score
from rows
""",
)
def sparse_fit_scores(t):
    """Logistic regression without penalty on a sparse vector of levels: the mean label of a kept level, and of all pooled ones together."""
    vectors, model, _ = _sparse_fit(t)
    return models.score(model, vectors, ["address_id", "label"]).withColumn("score", F.round("score", 3))


@query(
    "sparse_importances",
    f"""
with {_SEGMENTS}
select 'segment_' || segment as feature from kept
""",
)
def sparse_importances(t):
    """Names of the importances: the levels, in the order of their places."""
    _, model, places = _sparse_fit(t)
    return models.importances(t.spark, model, [f"{f}_{v}" for f, v in places]).select("feature")
