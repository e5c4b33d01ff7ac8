"""Tables written and read back, and store lookups, on the driver tables.

Everything is written below the shared checkpoint folder, one new folder per run.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from panelwright.operators import columns, registry, splits
from panelwright.plans.catalog import query
from panelwright.plans.panel_queries import FULL_PANEL, SPLITS, label_panel
from panelwright.session import shared_dir
from panelwright.sources import tables as store


def _folder(t, name: str) -> str:
    return f"{shared_dir(t.spark)}/{name}_{uuid4().hex}"


@query(
    "typed_table",
    """
select cast(o_orderkey as varchar) as o_orderkey, cast(o_custkey as varchar) as o_custkey,
       nullif(o_orderstatus, 'P') as o_orderstatus, strftime(o_orderdate, '%Y-%m-%d') as o_orderdate, o_orderpriority,
       strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') as o_ordertime from orders
""",
)
def typed_table(t):
    """A bulk write with every column as text, empty text as null."""
    name = _folder(t, "typed")
    status = F.when(F.col("o_orderstatus") == "P", "").otherwise(F.col("o_orderstatus"))
    day, time = F.to_date("o_orderdate").alias("o_orderdate"), F.col("o_orderdate").alias("o_ordertime")
    store.write_typed(t.orders.select("o_orderkey", "o_custkey", status.alias("o_orderstatus"), day, "o_orderpriority", time), name)
    return store.read_table(t.spark, name)


@query(
    "typed_columns",
    """
select o_orderkey * 3000000000 as o_orderkey, cast(o_totalprice / 1000000000000 as double) as o_totalprice,
       cast(o_orderdate as date) as day, o_orderdate, nullif(o_orderstatus, 'P') as o_orderstatus, cast(o_custkey % 100 as integer) as small
from orders
""",
)
def typed_columns(t):
    """A bulk write by column types: long numbers, small doubles, dates and times come back as they went in."""
    name = _folder(t, "columns")
    status = F.when(F.col("o_orderstatus") == "P", "").otherwise(F.col("o_orderstatus"))
    rows = t.orders.select(
        (F.col("o_orderkey") * F.lit(3_000_000_000)).alias("o_orderkey"),
        (F.col("o_totalprice") / F.lit(1e12)).alias("o_totalprice"),
        F.to_date("o_orderdate").alias("day"),
        "o_orderdate",
        status.alias("o_orderstatus"),
        (F.col("o_custkey") % 100).cast("smallint").alias("small"),
    )
    store.write_typed(rows, name, default_to_text=False)
    return store.read_table(t.spark, name)


@query(
    "append_results",
    """
select cast(date_trunc('month', o_orderdate) as date) as as_of_date, o_orderstatus as model, count(*) as rows
from orders group by 1, 2
""",
)
def append_results(t):
    """Result rows of three models appended one after the other, partitioned by date."""
    name = _folder(t, "results")
    rows = t.orders.select(
        F.trunc("o_orderdate", "month").alias("as_of_date"), F.col("o_orderstatus").alias("model"), "o_orderkey"
    )
    for model in ("F", "O", "P"):
        store.append_rows(rows.where(F.col("model") == model), name)
    return store.read_table(t.spark, name).groupBy("as_of_date", "model").agg(F.count(F.lit(1)).alias("rows"))


@query("build_if_absent", "select c_mktsegment, count(*) as customers from customer group by 1")
def build_if_absent(t):
    """Built once; the second call leaves the table as it is."""
    name = _folder(t, "built")
    counts = t.customer.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("customers"))
    store.build_table(t.spark, name, lambda: counts)
    return store.build_table(t.spark, name, lambda: counts.where(F.lit(False)))


@query("sorted_write", "select o_orderkey, o_custkey, o_totalprice, cast(o_orderdate as date) as day from orders")
def sorted_write(t):
    """Rows written in the order of the customer within each file, and read back."""
    name = _folder(t, "sorted")
    rows = t.orders.select("o_orderkey", "o_custkey", "o_totalprice", F.to_date("o_orderdate").alias("day"))
    store.write_table(rows, name, sort_by=["o_custkey", "day"])
    return store.read_table(t.spark, name)


@query("csv_restore", "select * from orders")
def csv_restore(t):
    """A CSV backup of a whole table, with its times, read back with a stated schema."""
    name = _folder(t, "backup")
    rows = t.orders
    store.backup(rows, name, "csv")
    return store.restore_csv(t.spark, name, rows.schema)


_LABEL = "internal_opens_any_next_month"
_SPLIT_LIST = ", ".join(f"date '{d}'" for d in SPLITS)


@query(
    "available_splits",
    FULL_PANEL
    + f"""
select split_date, count(*) as rows from panel, (select unnest([{_SPLIT_LIST}]) as split_date)
where {_LABEL} is not null and month_start < split_date group by 1
""",
)
def available_splits(t):
    """Train rows of all splits stored under their split date, one split rebuilt, then listed."""
    name = _folder(t, "splits")
    rows = splits.with_train_splits(label_panel(t), SPLITS, _LABEL).select("address_id", "month_start", "split_date")
    store.replace_splits(rows, name)
    store.replace_splits(rows.where(F.col("split_date") == F.lit(SPLITS[0]).cast("date")), name)
    stored = store.read_table(t.spark, name)
    counts = stored.groupBy("split_date").agg(F.count(F.lit(1)).alias("rows"))
    return store.available_splits(stored).join(counts, "split_date")


@query(
    "versioned_update",
    """
select s_suppkey, case when n is null then s_name else 'parts ' || n end as s_name
from supplier left join (select l_suppkey, count(*) as n from lineitem where l_returnflag = 'A' and l_suppkey % 2 = 0
                         group by 1) on s_suppkey = l_suppkey
""",
)
def versioned_update(t):
    """A metadata table updated by key: the new version is written beside the one it was read from."""
    folder = _folder(t, "versions")
    store.write_version(t.supplier.select("s_suppkey", "s_name"), folder, 1)
    current, version = store.read_latest(t.spark, folder)
    lines = t.lineitem.where((F.col("l_returnflag") == "A") & (F.col("l_suppkey") % 2 == 0))
    change = lines.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(
        F.concat(F.lit("parts "), F.count(F.lit(1)).cast("string")).alias("s_name")
    )
    store.write_version(registry.updated_rows(current, change, "s_suppkey"), folder, version + 1)
    return store.read_latest(t.spark, folder)[0]


@query("query_scan", "select o_custkey, count(*) as n from orders where o_orderstatus = 'F' group by 1")
def query_scan(t):
    """A SQL text with a named parameter."""
    t.orders.createOrReplaceTempView("orders_to_scan")
    text = "select o_custkey, count(*) as n from orders_to_scan where o_orderstatus = :status group by o_custkey"
    return store.read_query(t.spark, text, status="F")


@query("row_by_id", "select c_custkey, c_name from customer where c_custkey = 7")
def row_by_id(t):
    return registry.by_id(t.customer.select("c_custkey", "c_name"), "c_custkey", 7)


@query(
    "model_parameters",
    """
select o_custkey as model_group_id, '{' || string_agg('"' || o_orderpriority || '":' || n, ',' order by o_orderpriority) || '}'
         as model_parameters
from (select o_custkey, o_orderpriority, count(*) as n from orders group by 1, 2) group by 1
""",
)
def model_parameters(t):
    """Coefficients per model group as JSON text: the order counts by priority stand for coefficients."""
    weights = t.orders.groupBy(F.col("o_custkey").alias("model_group_id"), F.col("o_orderpriority").alias("feature")).agg(
        F.count(F.lit(1)).alias("coefficient")
    )
    groups = t.orders.select(F.col("o_custkey").alias("model_group_id"), F.lit("Lasso").alias("algorithm_type")).distinct()
    return registry.model_rows(groups, weights, "train", "none").select("model_group_id", "model_parameters")


_LAGGED = [
    "internal_knocks_count_this_month",
    "internal_knocks_any_this_month",
    "internal_opens_count_this_month",
    "internal_opens_any_this_month",
    "internal_cases_opened_count_this_month",
    "internal_cases_opened_any_this_month",
]


@query("feature_columns", FULL_PANEL + f"select address_id, month_start, {_LABEL}, {', '.join(_LAGGED)} from panel")
def feature_columns(t):
    """The panel cut to one label and one named feature list, found by pattern."""
    panel = label_panel(t)
    lists = columns.feature_lists(panel.columns)
    return columns.model_columns(panel, _LABEL, lists["internal_lagged_labels"])
