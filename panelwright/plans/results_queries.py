"""Results store and model comparison on evaluations derived from the orders table.

A model is one priority (algorithm), status (hyperparameters) and month; its metrics are fixed
expressions of the order count, so that both engines see the same numbers.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwright.operators import registry, summary
from panelwright.operators.evaluate import CAPACITY_SHARES
from panelwright.operators.prefix import running_totals
from panelwright.plans.catalog import query

METRICS = list(dict.fromkeys([*summary.OLDER_METRICS, *summary.NEWER_METRICS]))
KS = [10, 20, 30, 40, 50, 60, 70, 80]
MONTHS = [f"{y}-{m:02d}-01" for y in (1998, 1999) for m in range(1, 13)]


def _pairs(values, alias):
    """Array of (position, value) structs of a short fixed list."""
    return F.posexplode(F.array(*[F.lit(v) for v in values])).alias(f"{alias}_at", alias)


def evaluations(t):
    """The evaluation view: one row per model, k and metric; some models were fitted twice."""
    status = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2).otherwise(3)
    models = t.orders.groupBy(
        F.left("o_orderpriority", F.lit(1)).cast("long").alias("family"),
        status.cast("long").alias("variant"),
        F.trunc("o_orderdate", "month").alias("split"),
    ).agg(F.count(F.lit(1)).alias("n"))
    again = F.when(F.col("variant") == 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    fits = models.select("*", F.explode(again).alias("again"))
    number = (F.year("split") - 1990) * 12 + F.month("split")
    wide = fits.select("*", (F.col("again") * 500000 + F.col("family") * 10000 + F.col("variant") * 1000 + number).alias("model_id"))
    wide = wide.select("*", _pairs(KS, "k")).select("*", _pairs(METRICS, "metric"))
    score = (F.col("n") * (F.col("k_at") + 3) * (F.col("metric_at") + 2) + F.col("again") * 7 + F.col("variant")) % 11
    return wide.select(
        (F.col("family") * 10 + F.col("variant")).alias("model_group_id"),
        "model_id",
        F.concat(F.lit("Forest"), F.col("family").cast("string")).alias("algorithm_type"),
        F.concat(F.lit('{"depth": '), F.col("variant").cast("string"), F.lit("}")).alias("hyperparameters"),
        F.when(F.col("variant") == 3, "internal_opens_any_next_month").otherwise(summary.DEFAULT_LABEL).alias("label"),
        F.repeat(F.lit("feature_a,"), F.col("family").cast("int")).alias("feature_list"),
        F.lit(summary.DEFAULT_BOROUGHS).alias("borough_fit_on"),
        F.lit("Bronx").alias("borough_predicted_for"),
        F.col("split").cast("string").alias("training_end_date"),
        F.add_months("split", 1).cast("string").alias("test_set_month"),
        "metric",
        (score / 10.0).alias("value"),
        F.col("k").cast("string").alias("top_k"),
    )


_METRIC_ROWS = ", ".join(f"({i}, '{m}')" for i, m in enumerate(METRICS))
_K_ROWS = ", ".join(f"({i}, {k})" for i, k in enumerate(KS))
EVALUATIONS = f"""
fits as (
  select m.*, a as again, a * 500000 + family * 10000 + variant * 1000 + (year(split) - 1990) * 12 + month(split) as model_id
  from (select cast(o_orderpriority[1] as bigint) as family,
               cast(case o_orderstatus when 'F' then 1 when 'O' then 2 else 3 end as bigint) as variant,
               cast(date_trunc('month', o_orderdate) as date) as split, count(*) as n from orders group by 1, 2, 3) m
  join (values (0), (1)) x(a) on a = 0 or variant = 1),
evals as (
  select family * 10 + variant as model_group_id, model_id, 'Forest' || family as algorithm_type,
         '{{"depth": ' || variant || '}}' as hyperparameters,
         case when variant = 3 then 'internal_opens_any_next_month' else '{summary.DEFAULT_LABEL}' end as label,
         repeat('feature_a,', family) as feature_list, '{summary.DEFAULT_BOROUGHS}' as borough_fit_on,
         'Bronx' as borough_predicted_for, cast(split as varchar) as training_end_date,
         cast(cast(split + interval 1 month as date) as varchar) as test_set_month, metric,
         ((n * (k_at + 3) * (metric_at + 2) + again * 7 + variant) % 11) / 10.0::double as value,
         cast(k as varchar) as top_k
  from fits, (values {_K_ROWS}) ks(k_at, k), (values {_METRIC_ROWS}) ms(metric_at, metric))
"""


def _newest(keys: list[str]) -> str:
    return f"select * from evals qualify row_number() over (partition by {', '.join(keys)} order by model_id desc) = 1"


@query(
    "evaluation_pick",
    f"""
with {EVALUATIONS}
select model_id, metric, top_k, value from evals
where model_id between 20000 and 49999 and label = '{summary.DEFAULT_LABEL}' and borough_fit_on = '{summary.DEFAULT_BOROUGHS}'
""",
)
def evaluation_pick(t):
    picked = summary.pick_evaluations(evaluations(t), low=20000, high=49999)
    return picked.select("model_id", "metric", "top_k", "value")


_FEW = [10001, 11005, 20013, 530001]


@query(
    "evaluation_pick_list",
    f"""
with {EVALUATIONS}
select 'listed' as pick, model_id, metric, top_k, value from evals
where model_id in ({", ".join(map(str, _FEW))}) and label = '{summary.DEFAULT_LABEL}' and borough_fit_on = '{summary.DEFAULT_BOROUGHS}'
union all
select 'every' as pick, model_id * 10000 as model_id, metric, top_k, value from evals
where label = '{summary.DEFAULT_LABEL}' and borough_fit_on = '{summary.DEFAULT_BOROUGHS}'
""",
)
def evaluation_pick_list(t):
    """By a list of ids, and without bounds: ids beyond 900,000,000 stay."""
    every = evaluations(t)
    large = every.withColumn("model_id", F.col("model_id") * 10000)
    columns = ["model_id", "metric", "top_k", "value"]
    listed = summary.pick_evaluations(every, ids=_FEW).select(F.lit("listed").alias("pick"), *columns)
    return listed.unionByName(summary.pick_evaluations(large).select(F.lit("every").alias("pick"), *columns))


_OLDER = list(summary.OLDER_METRICS)
_MIN_LENGTH = 15
_CLEAN_OLDER = f"""
cleaned as (
  select algorithm_type, hyperparameters, algorithm_type || hyperparameters as model_and_hyp, metric, value, top_k,
         training_end_date, model_id, test_set_month, borough_predicted_for, borough_fit_on
  from ({_newest(summary.OLDER_KEYS)})
  where length(feature_list) > {_MIN_LENGTH} and metric in ({", ".join(f"'{m}'" for m in _OLDER)}))
"""


@query("clean_results", f"with {EVALUATIONS}, {_CLEAN_OLDER} select * from cleaned")
def clean_results(t):
    return summary.clean_results_older(evaluations(t), _MIN_LENGTH, _OLDER)


_WIDE_OLDER = f"""
wide as (
  select algorithm_type, hyperparameters, model_and_hyp, borough_fit_on, borough_predicted_for,
         training_end_date as split_date, top_k, model_id,
         {", ".join(f"avg(value) filter (where metric = '{m}') as {n}" for m, n in summary.OLDER_METRICS.items())}
  from cleaned group by all),
rated as (
  select *, cast(cast(split_date as date) + interval 1 month as date) as test_set_month,
         ([{", ".join(map(str, CAPACITY_SHARES))}]::double[])[rank() over (partition by model_and_hyp, split_date, model_id,
            borough_predicted_for, borough_fit_on order by cast(top_k as integer))] as top_k_rank,
         precision_no_imputed / nullif(precision_baseline, 0) as precision_ratio,
         case when recall_of_0 = 0 and recall_of_1 <> 0 then 100 when recall_of_0 = 0 and recall_of_1 = 0 then 0
              else recall_of_1 / nullif(recall_of_0, 0) end as recall_ratio
  from wide)
"""
_RATES = ["precision_baseline", "precision_no_imputed", "recall_of_0", "recall_of_1", "precision_ratio", "recall_ratio"]
_RATED_KEYS = ["model_and_hyp", "split_date", "test_set_month", "top_k", "model_id", "top_k_rank"]


def _rounded(df, names):
    return df.select(*[F.round(c, 6).alias(c) if c in names else c for c in df.columns])


def rated(t):
    return summary.wide_metrics_older(summary.clean_results_older(evaluations(t), _MIN_LENGTH, _OLDER))


@query(
    "wide_metrics",
    f"""
with {EVALUATIONS}, {_CLEAN_OLDER}, {_WIDE_OLDER}
select {", ".join(_RATED_KEYS)}, {", ".join(f"round({r}, 6) as {r}" for r in _RATES)} from rated
""",
)
def wide_metrics(t):
    return _rounded(rated(t).select(*_RATED_KEYS, *_RATES), _RATES)


_NEWER_OUT = list(summary.NEWER_METRICS.values())
_CUTOFF = "1999-01-01"


@query(
    "wide_metrics_newer",
    f"""
with {EVALUATIONS}, wide as (
  select algorithm_type, hyperparameters, algorithm_type || '_' || hyperparameters as model_and_hyp, top_k, model_id,
         model_group_id, test_set_month,
         {", ".join(f"avg(value) filter (where metric = '{m}') as {n}" for m, n in summary.NEWER_METRICS.items())}
  from ({_newest(summary.NEWER_KEYS)}) where label = '{summary.DEFAULT_LABEL}' group by all)
select model_and_hyp, top_k, model_id, model_group_id, test_set_month, {", ".join(f"round({n}, 6) as {n}" for n in _NEWER_OUT)},
       round(precision_at_k / nullif(precision_baseline, 0), 6) as precision_ratio,
       case when test_set_month < '{_CUTOFF}' then 'validation' else 'test' end as part
from wide
""",
)
def wide_metrics_newer(t):
    wide = summary.wide_metrics_newer(summary.clean_results_newer(evaluations(t)))
    validation, test = summary.cut_by_month(wide, _CUTOFF)
    both = validation.withColumn("part", F.lit("validation")).unionByName(test.withColumn("part", F.lit("test")))
    return _rounded(both.drop("algorithm_type", "hyperparameters"), [*_NEWER_OUT, "precision_ratio"])


_SHARES = [0.1, 0.2]


def _best_sql(metric: str, seen: str, months=MONTHS) -> str:
    return f"""
with {EVALUATIONS}, {_CLEAN_OLDER}, {_WIDE_OLDER},
picked as (select * from rated where top_k_rank in ({", ".join(map(str, _SHARES))})
             and test_set_month in ({", ".join(f"date '{m}'" for m in months)})),
stats as (
  select model_and_hyp, avg({metric}) as mean, min({metric}) as low, max({metric}) as high,
         string_agg(distinct cast(test_set_month as varchar), '; ' order by cast(test_set_month as varchar)) as months,
         string_agg(distinct cast(model_id as varchar), '; ' order by cast(model_id as varchar)) as ids
  from picked group by 1 having {seen} >= {len(months)})
select distinct s.model_and_hyp, round(mean, 6) as {metric}_mean, round(low, 6) as {metric}_min, round(high, 6) as {metric}_max,
       months as test_set_months_all, ids as model_id_all, cast(x.test_set_month as varchar) as testmonth_ofmax,
       x.model_id as modelid_ofmax, cast(y.test_set_month as varchar) as testmonth_ofmin, y.model_id as modelid_ofmin
from stats s join picked x on x.model_and_hyp = s.model_and_hyp and x.{metric} = s.high
             join picked y on y.model_and_hyp = s.model_and_hyp and y.{metric} = s.low
"""


def _best(t, metric, months, distinct_months=False):
    found = summary.best_models(rated(t), _SHARES, months, metric, distinct_months)
    return _rounded(found, [f"{metric}_{x}" for x in ("mean", "min", "max")])


@query("best_models", _best_sql("precision_ratio", "count(*)"))
def best_models(t):
    return _best(t, "precision_ratio", MONTHS)


@query("best_models_recall", _best_sql("recall_ratio", "count(distinct test_set_month)", MONTHS[:6]))
def best_models_recall(t):
    return _best(t, "recall_ratio", MONTHS[:6], distinct_months=True)


@query(
    "models_by_mean",
    f"with best as ({_best_sql('precision_ratio', 'count(*)')}) select cast(row_number() over (order by precision_ratio_mean desc, model_and_hyp) as integer) as place, model_and_hyp from (select distinct model_and_hyp, precision_ratio_mean from best)",
)
def models_by_mean(t):
    """Place of each model and parameter set, best mean first."""
    ordered = summary.ordered_by_mean(_best(t, "precision_ratio", MONTHS).select("model_and_hyp", "precision_ratio_mean").distinct())
    numbered = running_totals(ordered, [], [F.desc("precision_ratio_mean"), F.col("model_and_hyp")], row_number="place")
    return numbered.select(F.col("place").cast("int").alias("place"), "model_and_hyp")


# --- registry ---------------------------------------------------------------------------------------


def groups(parts):
    """Model groups from parts: parameters, features and boroughs are written in varying order."""
    swap = F.col("p_partkey") % 2 == 0
    return parts.select(
        F.col("p_partkey").alias("model_group_id"),
        F.col("p_type").alias("algorithm_type"),
        F.col("p_brand").alias("label"),
        F.when(swap, F.concat(F.lit('{"a": '), F.col("p_size") % 3, F.lit(', "b": "x"}')))
        .otherwise(F.concat(F.lit('{"b": "x", "a": '), F.col("p_size") % 3, F.lit("}")))
        .alias("hyperparameters"),
        F.when(swap, "f1,f2,f3").otherwise("f3,f1,f2").alias("feature_list"),
        F.when(swap, "Bronx_Queens").otherwise("Queens_Bronx").alias("borough_fit_on"),
    )


@query(
    "group_match",
    """
with g as (select p_partkey as id, p_type, p_brand, p_size % 3 as a from part where p_size <= 40)
select c.p_partkey as candidate_id, max(g.id) as model_group_id
from part c left join g on g.p_type = c.p_type and g.p_brand = c.p_brand and g.a = c.p_size % 3
where c.p_size > 40 group by 1
""",
)
def group_match(t):
    """Each candidate's newest equal group; text order of parameters, features and boroughs does not matter."""
    known = groups(t.part.where(F.col("p_size") <= 40))
    wanted = groups(t.part.where(F.col("p_size") > 40)).withColumnRenamed("model_group_id", "candidate_id")
    return registry.match_model_groups(wanted, known)


@query(
    "group_match_recent",
    """
with g as (select p_partkey as id, p_type, p_size % 3 as a from part order by p_partkey desc limit 5)
select c.p_partkey as candidate_id, max(case when c.p_partkey % 3 <> 0 then g.id end) as model_group_id
from part c left join g on g.p_type = c.p_type and g.a = c.p_size % 3 group by 1
""",
)
def group_match_recent(t):
    """Among the five newest groups, with more than 80 in 100 of the candidate's features."""
    known = groups(t.part).withColumn("label", F.lit("any"))
    few = F.when(F.col("candidate_id") % 3 == 0, "f1,f2,f3,f4").otherwise(F.col("feature_list"))
    wanted = known.withColumnRenamed("model_group_id", "candidate_id").withColumn("feature_list", few)
    return registry.match_recent_groups(wanted, known)


@query(
    "model_exists",
    """
select o_orderkey as candidate_id from orders
where not (o_orderstatus = 'F' and o_orderkey in (select l_orderkey from lineitem where l_returnflag = 'A'))
""",
)
def model_exists(t):
    """Candidates that were not fitted yet: fitted means a finished order with an 'A' line."""
    models = t.orders.where(F.col("o_orderstatus") == "F").select(
        F.col("o_orderkey").alias("model_id"),
        F.col("o_orderkey").alias("model_group_id"),
        F.lit("train").alias("training_table_name"),
        F.lit("none").alias("label_imputation_method"),
    )
    tests = t.lineitem.select(F.col("l_orderkey").alias("model_id"), F.col("l_returnflag").alias("test_matrix_name"))
    wanted = t.orders.select(
        F.col("o_orderkey").alias("candidate_id"),
        F.col("o_orderkey").alias("model_group_id"),
        F.lit("train").alias("training_table_name"),
        F.lit("A").alias("test_matrix_name"),
        F.lit("none").alias("label_imputation_method"),
    )
    return registry.still_to_fit(wanted, models, tests).select("candidate_id")


_FINGERPRINT_COLUMNS = ["o_orderkey", "o_orderdate"]


@query(
    "matrix_fingerprint",
    """
select o_orderstatus, min(o_orderdate) as start_date, max(o_orderdate) as end_date, count(*) as n_rows,
       md5('o_orderkey, o_orderdate_' || strftime(min(o_orderdate), '%Y-%m-%d %H:%M:%S') || '_' ||
           strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S') || '_' || count(*) || '_Bronx_Queens') as uuid
from orders group by 1
""",
)
def matrix_fingerprint(t):
    return registry.fingerprint(
        t.orders, "o_orderdate", _FINGERPRINT_COLUMNS, boroughs=["Bronx", "Queens"], by=["o_orderstatus"]
    )


@query(
    "register_new",
    "select distinct o_custkey as uuid from orders where o_orderstatus = 'P' and o_custkey not in (select o_custkey from orders where o_orderstatus = 'F')",
)
def register_new(t):
    fresh = t.orders.where(F.col("o_orderstatus") == "P").select(F.col("o_custkey").alias("uuid")).distinct()
    stored = t.orders.where(F.col("o_orderstatus") == "F").select(F.col("o_custkey").alias("uuid"))
    return registry.only_new(fresh, stored)


@query(
    "serial_ids",
    """
select cast((select max(s_suppkey) from supplier) + row_number() over (order by c_name) as bigint) as model_id, c_name
from customer
""",
)
def serial_ids(t):
    rows = t.customer.select("c_name")
    return registry.with_serial_ids(rows, t.supplier.select(F.col("s_suppkey").alias("model_id")), "model_id", ["c_name"])


@query("newest_rows", "select c_custkey, c_name from customer order by c_custkey desc limit 5")
def newest_rows(t):
    """The five newest rows of a results table."""
    return registry.newest(t.customer.select("c_custkey", "c_name"), "c_custkey", registry.RECENT)


@query(
    "newest_model",
    """
select * from (select o_orderkey as model_id, o_custkey % 10 as model_group_id, o_orderstatus as training_table_name
               from orders where o_custkey % 10 = 1 order by 1 desc limit 5)
where training_table_name = 'F' order by 1 desc limit 1
""",
)
def newest_model(t):
    models = t.orders.select(
        F.col("o_orderkey").alias("model_id"),
        (F.col("o_custkey") % 10).alias("model_group_id"),
        F.col("o_orderstatus").alias("training_table_name"),
    )
    return registry.newest_model_of_group(models, 1, "F")


@query(
    "update_rows",
    """
select c_custkey, case when c_custkey % 10 = 3 and n is not null then 'updated ' || n else c_name end as c_name, c_mktsegment
from customer left join (select o_custkey, count(*) as n from orders group by 1) on c_custkey = o_custkey
""",
)
def update_rows(t):
    """New names for some keys; all other rows stay."""
    changes = t.orders.where(F.col("o_custkey") % 10 == 3).groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.concat(F.lit("updated "), F.count(F.lit(1)).cast("string")).alias("c_name")
    )
    return registry.updated_rows(t.customer.select("c_custkey", "c_name", "c_mktsegment"), changes, "c_custkey")


# --- lookups ----------------------------------------------------------------------------------------


def predictions(t):
    """One prediction per order: the status stands for the model."""
    model = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2).otherwise(3)
    return t.orders.select(
        model.alias("model_id"),
        F.trunc("o_orderdate", "month").alias("as_of_date"),
        F.col("o_custkey").alias("entity_id"),
        ((F.col("o_orderkey") * 31 % 50) / 50.0).alias("score"),
    )


@query(
    "map_attributes",
    """
select 1 as model_id, cast(date_trunc('month', o_orderdate) as date) as as_of_date, o_custkey as entity_id,
       (o_orderkey * 31 % 50) / 50.0::double as score, c_nationkey as place, c_acctbal as balance
from orders left join customer on o_custkey = c_custkey where o_orderstatus = 'F'
""",
)
def map_attributes(t):
    people = t.customer.select(
        F.col("c_custkey").alias("address_id"), F.col("c_nationkey").alias("place"), F.col("c_acctbal").alias("balance")
    )
    return summary.predictions_with_place(predictions(t), people, 1, ["place", "balance"])


@query(
    "two_models_units",
    """
select case o_orderstatus when 'F' then 1 else 2 end as model_id, cast(date_trunc('month', o_orderdate) as date) as as_of_date,
       o_custkey as entity_id, (o_orderkey * 31 % 50) / 50.0::double as score, 1 + o_custkey % 50 as units
from orders where o_orderstatus in ('F', 'O')
""",
)
def two_models_units(t):
    panel = t.orders.select(F.col("o_custkey").alias("address_id"), (F.lit(1) + F.col("o_custkey") % 50).alias("units"))
    return summary.predictions_of_models(predictions(t), panel, [1, 2], "units")
