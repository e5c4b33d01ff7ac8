"""Fits, kernels and paged sources on the driver tables."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from panelwright.operators import kernel, models, scale, summary
from panelwright.plans import monthly_run
from panelwright.plans.catalog import query
from panelwright.plans.panel_queries import label_panel
from panelwright.session import durable, shared_dir
from panelwright.sources import paged

SPLIT = "2000-01-01"
LABEL = "internal_opens_any_next_month"
FEATURES = [
    "internal_units_static",
    "balance_static",
    "internal_knocks_count_this_month",
    "internal_opens_count_this_month",
    "internal_cases_opened_count_ever",
    "nyc_heating_season",
]


def _panel(t, months):
    """The rows the split reads, stored once: fitting reads them many times."""
    return durable(monthly_run.split_rows(label_panel(t), SPLIT, FEATURES, LABEL, months))


def _run(t, algorithm, parameters):
    return monthly_run.run_split(
        _panel(t, 3), SPLIT, FEATURES, LABEL, 1, algorithm, parameters, top_k=500, boroughs=["all"], months=3
    )


@query("forest_scores")
def forest_scores(t):
    """Random forest scores of the test months, ranked within model and month."""
    return _run(t, "RandomForestClassifier", {"numTrees": 10, "maxDepth": 4}).predictions


@query("importance_topn")
def importance_topn(t):
    """Importances with rank and percent rank, cut to the ranks above the threshold."""
    rows = _run(t, "GradientBoostingClassifier", {"maxIter": 5, "maxDepth": 3}).importances
    return summary.top_features(rows, 1, 5)


@query("logistic_metrics")
def logistic_metrics(t):
    """Evaluation rows of an L1 logistic regression at a capacity of 500 units."""
    return _run(t, "Lasso", {"regParam": 0.01, "maxIter": 20}).evaluations


@query(
    "rbf_pairs",
    """
with cells as (select label % 16 as label, unnest(embedding) as x, generate_subscripts(embedding, 1) as pos from embeddings),
means as (select label, pos, avg(cast(x as double)) as m from cells group by 1, 2),
rows as (select vec_id, unnest(embedding) as x, generate_subscripts(embedding, 1) as pos from embeddings)
select vec_id, label as landmark, round(exp(-sum((cast(x as double) - m) ** 2) / (2 * 0.5 ** 2)), 6) as k
from rows join means using (pos) group by 1, 2
""",
)
def rbf_pairs(t):
    """Exact kernel values of every vector against 16 landmarks at most: mean vectors of the labels, folded to 16 groups."""
    rows = t.embeddings
    folded = rows.withColumn("landmark", F.col("label") % 16)
    marks = kernel.centroids(folded, "landmark", "embedding")
    cells = kernel.rbf_against(rows, marks, "vec_id", "landmark", "embedding", sigma=0.5, count=16)
    return cells.withColumn("k", F.round("k", 6))


FOURIER = 256


@query(
    "fourier_kernel",
    """
with cells as (select label % 16 as label, unnest(embedding) as x, generate_subscripts(embedding, 1) as pos from embeddings),
means as (select label, pos, avg(cast(x as double)) as m from cells group by 1, 2),
rows as (select vec_id, unnest(embedding) as x, generate_subscripts(embedding, 1) as pos from embeddings)
select vec_id, label as landmark, round(exp(-sum((cast(x as double) - m) ** 2) / 2), 5) as k, true as within
from rows join means using (pos) group by 1, 2
""",
)
def fourier_kernel(t):
    """Kernel values from random Fourier features lie within the bound of the exact ones, for all vectors against 16 landmarks."""
    rows = t.embeddings
    marks = kernel.centroids(rows.withColumn("landmark", F.col("label") % 16), "landmark", "embedding")
    names, points = kernel.landmark_rows(marks, "landmark", "embedding", 16)
    dims = points.shape[1]
    sets = F.array(*[F.struct(F.lit(n).alias("landmark"), F.lit(p.tolist()).alias("point")) for n, p in zip(names, points)])
    # Stored, so that a row's features are made once and not for each landmark.
    mapped = durable(rows.select("vec_id", "embedding", kernel.fourier_row("embedding", dims, FOURIER, 1.0).alias("z"))).select("*", F.explode(sets).alias("mark"))
    marked = t.spark.createDataFrame([(n, p.tolist()) for n, p in zip(names, points)], f"landmark {rows.schema['label'].dataType.simpleString()}, point array<double>")
    marked = durable(marked.select("landmark", kernel.fourier_row("point", dims, FOURIER, 1.0).alias("mark_z")))
    square = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, v: s + v)
    exact = F.exp(-square(F.col("embedding"), F.col("mark.point")) / 2)
    both = mapped.join(F.broadcast(marked), F.col("mark.landmark") == F.col("landmark"))
    bound = kernel.fourier_bound(FOURIER, rows.count() * len(names))
    within = F.abs(kernel.dot_product("z", "mark_z") - exact) <= bound
    return both.select("vec_id", "landmark", F.round(exact, 5).alias("k"), within.alias("within"))


@query("kernel_scores")
def kernel_scores(t):
    """Scores of the kernel classifier: customers with many finished orders, from scaled features."""
    spend = t.orders.groupBy(F.col("o_custkey").alias("entity_id")).agg(
        F.avg("o_totalprice").alias("mean_price"),
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("o_orderstatus") == "F").alias("finished"),
    )
    rows = durable(spend.select("*", (F.col("finished") * 3 > F.col("n")).cast("int").alias("label")))
    names = ["mean_price", "n"]
    scaled = scale.minmax_scale(rows, scale.fit_minmax(rows, names))
    fitted = kernel.fit_kernel_classifier(scaled, names, "label", landmarks=10, sigma=0.3)
    return fitted.score(scaled, ["entity_id", "label"])


@query("decision_tree_scores")
def decision_tree_scores(t):
    """Decision tree scores per test month."""
    return _run(t, "DecisionTreeClassifier", {"maxDepth": 4}).predictions


_URGENT = """
people as (
  select o_custkey as entity_id, date '2000-01-01' as month_start, max(cast(o_orderpriority = '1-URGENT' as integer)) as urgent,
         cast(2 * count(*) filter (where o_orderstatus = 'F') > count(*) as integer) as half,
         cast(3 * count(*) filter (where o_orderstatus = 'F') > count(*) as integer) as label
  from orders group by 1),
scored as (select *, avg(label) over (partition by urgent) as score from people)
"""


def _urgent(t):
    """Customers with 0/1 features and one 0/1 label; a fit on one such feature has a closed form."""
    rows = t.orders.groupBy(F.col("o_custkey").alias("entity_id")).agg(
        F.max((F.col("o_orderpriority") == "1-URGENT").cast("int")).alias("urgent"),
        (F.count_if(F.col("o_orderstatus") == "F") * 2 > F.count(F.lit(1))).cast("int").alias("half"),
        (F.count_if(F.col("o_orderstatus") == "F") * 3 > F.count(F.lit(1))).cast("int").alias("label"),
    )
    return durable(rows.withColumn("month_start", F.lit("2000-01-01").cast("date")))


@query(
    "tree_known_scores",
    f"""
with {_URGENT},
meant as (select * exclude (score), avg(label) over (partition by half) as score from scored),
ranked as (select *, rank() over (order by score desc) + (count(*) over (partition by score) - 1) / 2 as place, count(*) over () as n from meant)
select cast(7 as bigint) as model_id, month_start as as_of_date, 'all' as borough_predicted_for, entity_id, 'train' as training_table_name,
       round(score, 6) as score, cast(100 as bigint) as top_k, 1 as label_observed, cast(floor(place) as integer) as rank_abs,
       round(floor(place) / n, 6) as rank_pct
from ranked
""",
)
def tree_known_scores(t):
    """A decision tree on one 0/1 feature: the score is the mean label of the feature's value; ranked prediction rows on top."""
    rows = _urgent(t)
    fitted = models.fit(rows, ["half"], "label", "DecisionTreeClassifier", {"maxDepth": 1})
    scored = models.score(fitted, rows, ["entity_id", "month_start", "label"])
    out = models.prediction_rows(scored, 7, "label", "train", 100, ["all"], entity="entity_id")
    return out.withColumns({"score": F.round("score", 6), "rank_pct": F.round("rank_pct", 6)})


@query("logistic_known_scores", f"with {_URGENT} select entity_id, label, round(score, 3) as score from scored")
def logistic_known_scores(t):
    """Logistic regression without penalty on one 0/1 feature meets the mean label of the feature's value."""
    rows = _urgent(t)
    fitted = models.fit(rows, ["urgent"], "label", "LogisticRegression", {"maxIter": 200, "tol": 1e-12})
    return models.score(fitted, rows, ["entity_id", "label"]).withColumn("score", F.round("score", 3))


@query(
    "importance_known",
    """
with weights as (select p_brand as feature, cast(count(*) filter (where p_size > 25) as double) / count(*) as w from part group by 1),
ranked as (select *, rank() over (order by w desc) + (count(*) over (partition by w) - 1) / 2 as place, count(*) over () as n from weights)
select cast(3 as bigint) as model_id, feature, round(w, 6) as feature_importance, cast(floor(place) as integer) as rank_abs,
       round(floor(place) / n, 6) as rank_pct
from ranked
""",
)
def importance_known(t):
    """Importance rows, ranked, over weights that the parts give each brand."""
    weights = t.part.groupBy(F.col("p_brand").alias("feature")).agg(
        (F.count_if(F.col("p_size") > 25).cast("double") / F.count(F.lit(1))).alias("feature_importance")
    )
    ranked = models.importance_rows(weights, 3)
    return ranked.withColumns({"feature_importance": F.round("feature_importance", 6), "rank_pct": F.round("rank_pct", 6)})


# --- paged sources --------------------------------------------------------------------------------


@query("paged_ingest", "select event_id, user_id, ts, event_type, value, props from events")
def paged_ingest(t):
    """All columns of events written as JSON pages of 10,000 rows and read back with a stated schema."""
    folder = f"{shared_dir(t.spark)}/event_pages_{uuid4().hex}"
    rows = t.events.select("event_id", "user_id", "ts", "event_type", "value", "props")
    paged.write_pages(rows, folder)
    return paged.read_pages(t.spark, folder, rows.schema)


@query(
    "paged_source",
    "select event_id, user_id, ts, event_type, value from events where user_id >= 3 and event_type in ('click', 'view', 'purchase') and value > 1",
)
def paged_source(t):
    """Pages read through the paged source, which applies the comparisons of whole numbers and texts itself and leaves those of fractions to Spark."""
    folder = f"{shared_dir(t.spark)}/event_pages_{uuid4().hex}"
    rows = t.events.select("event_id", "user_id", "ts", "event_type", "value")
    paged.write_pages(rows, folder, 1_000)
    pages = paged.read_paged_json(t.spark, folder, rows.schema)
    return pages.where((F.col("user_id") >= 3) & F.col("event_type").isin("click", "view", "purchase") & (F.col("value") > 1))


@query(
    "page_offsets",
    "select cast(unnest(range(0, (select count(*) + 10000 from events), 10000)) as bigint) as offset",
)
def page_offsets(t):
    """Offsets that cover a table whose size is only bounded."""
    return paged.page_offsets(t.spark, t.events.count() + paged.BOUND_SLACK)


def _metadata():
    """Metadata text per part: update frequency and three column cardinalities."""
    update = F.create_map(F.lit("Update Frequency"), F.col("p_type"))
    cardinality = lambda c: F.create_map(F.lit("cachedContents"), F.create_map(F.lit("cardinality"), c.cast("string")))
    body = F.struct(
        F.struct(F.struct(update.alias("Update")).alias("custom_fields")).alias("metadata"),
        F.array(cardinality(F.col("p_size")), cardinality(F.col("p_partkey")), cardinality(F.col("p_size") * 100)).alias("columns"),
    )
    return F.to_json(body)


@query(
    "metadata_fields",
    """
select p_partkey, p_type as frequency, cast(greatest(p_size, p_partkey, p_size * 100) + 10000 as bigint) as row_bound,
       cast(case when p_partkey % 2 = 1 then greatest(p_size, p_partkey, p_size * 100) else p_size * 7 end + 10000 as bigint)
         as page_bound
from part
""",
)
def metadata_fields(t):
    parsed = t.part.select("p_partkey", "p_size", paged.parsed_metadata(_metadata()).alias("m"))
    return parsed.select(
        "p_partkey",
        paged.update_frequency(F.col("m")).alias("frequency"),
        paged.cardinality_bound(F.col("m")).alias("row_bound"),
        paged.page_bound(F.col("m"), F.col("p_partkey") % 2, (F.col("p_size") * 7).cast("long")).alias("page_bound"),
    )


@query(
    "source_list",
    """
select p_name as dataname, 'id' || p_partkey || '.json' as json_id from part
where p_partkey % 5 <> 0 and p_brand <> 'Brand#1'
""",
)
def source_list(t):
    """Usable sources of a list made from parts, with the id cut out of each link."""
    link = F.concat(F.lit("https://x/resource/id"), F.col("p_partkey").cast("string"), F.lit(".json.json"))
    sources = t.part.select(
        F.col("p_name").alias("dataname"),
        F.when(F.col("p_partkey") % 5 == 0, "no").otherwise(link).alias("apilink"),
        F.when(F.col("p_brand") == "Brand#1", "No").otherwise("Yes").alias("include"),
    )
    return paged.usable_sources(sources).select("dataname", "json_id")
