"""Imputation, recoding, encoding, scaling and name clean-up on the driver tables."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from panelwright.operators import columns, encode, impute, names, order_stats, scale, split_stats
from panelwright.plans.catalog import query
from panelwright.session import durable, shared_dir

CUT = "1999-01-01"


def _six(c):
    return F.round(c, 6)


def _spend(t, part: str):
    """Per customer: order count, mean price and days open before or from the cut; gaps where no order was made."""
    day = F.col("o_orderdate") < F.lit(CUT).cast("date") if part == "train" else F.col("o_orderdate") >= F.lit(CUT).cast("date")
    late = t.orders.where(day).groupBy(F.col("o_custkey").alias("address_id")).agg(
        F.count(F.lit(1)).alias("orders_n"),
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("spend"),
        F.max(F.when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(0)).alias("urgent_any"),
    )
    people = t.customer.select(
        F.col("c_custkey").alias("address_id"),
        F.col("c_mktsegment").alias(impute.BOROUGH),
    )
    return people.join(late, "address_id", "left")


def _spend_sql(name: str, op: str) -> str:
    return f"""
{name} as (
  select c_custkey as address_id, c_mktsegment as borough, orders_n, spend, urgent_any
  from customer left join (
    select o_custkey, count(*) as orders_n, cast(sum(cast(o_totalprice as decimal(18, 2))) as double) as spend,
           max(cast(o_orderpriority = '1-URGENT' as integer)) as urgent_any
    from orders where o_orderdate {op} date '{CUT}' group by 1) on c_custkey = o_custkey)
"""


METHODS = {"orders_n": impute.MEAN, "spend": impute.MEDIAN, "urgent_any": impute.ZEROS}
_MODE_SQL = """
modes as (
  select borough, orders_n as mode from (
    select borough, orders_n, row_number() over (partition by borough order by count(*) desc, orders_n) as place
    from train where orders_n is not null group by 1, 2) where place = 1)
"""


@query(
    "group_stats",
    f"""
with {_spend_sql("train", "<")}, {_MODE_SQL}
select borough as {impute.BOROUGH}, round(avg(orders_n), 6) as mean, round(median(spend), 4) as median,
       cast(any_value(mode) as double) as mode
from train join modes using (borough) group by 1
""",
)
def group_stats(t):
    """Mean, exact median and smallest mode by group."""
    train = _spend(t, "train")
    copies = train.select(impute.BOROUGH, F.col("orders_n").alias("mean"), F.col("spend").alias("median"), F.col("orders_n").alias("mode"))
    stats = impute.fit_group_stats(copies, {"mean": impute.MEAN, "median": impute.MEDIAN, "mode": impute.MODE})
    return stats.select(impute.BOROUGH, _six(F.col("mean")).alias("mean"), F.round("median", 4).alias("median"), "mode")


@query(
    "impute_group_stats",
    f"""
with {_spend_sql("train", "<")}, {_spend_sql("test", ">=")},
stats as (select borough, avg(orders_n) as orders_n, median(spend) as spend from train group by 1)
select x.address_id, x.borough as {impute.BOROUGH}, round(coalesce(x.orders_n, s.orders_n), 6) as orders_n,
       round(coalesce(x.spend, s.spend), 4) as spend, coalesce(x.urgent_any, 0) as urgent_any
from test x left join stats s using (borough)
""",
)
def impute_group_stats(t):
    """Test rows filled from statistics of the training rows."""
    stats = impute.fit_group_stats(_spend(t, "train"), METHODS)
    filled = impute.impute_features(_spend(t, "test"), stats, METHODS)
    return filled.withColumns({"orders_n": _six(F.col("orders_n")), "spend": F.round("spend", 4)})


@query(
    "columns_with_nulls",
    f"""
with {_spend_sql("train", "<")}
select cast(max(cast(orders_n is null as integer)) as integer) as orders_n, max(cast(spend is null as integer)) as spend,
       max(cast(address_id is null as integer)) as address_id from train
""",
)
def columns_with_nulls(t):
    return impute.columns_with_nulls(_spend(t, "train"), ["orders_n", "spend", "address_id"])


def _labelled(t):
    return t.documents.select("doc_id", "lang").join(t.labels.select("doc_id", "quality"), "doc_id", "left")


@query(
    "impute_labels",
    """
select doc_id, quality, coalesce(quality, 0) as zeros, coalesce(quality, 1) as ones,
       cast(quality is null as integer) as quality_imputed_flag
from documents left join labels using (doc_id)
""",
)
def impute_labels(t):
    rows = impute.impute_labels(_labelled(t), "quality", impute.ONES, ["doc_id"]).withColumnRenamed("quality_imputed", "ones")
    zeros = impute.impute_labels(rows.drop("quality_imputed_flag"), "quality", impute.ZEROS, ["doc_id"])
    return zeros.select("doc_id", "quality", F.col("quality_imputed").alias("zeros"), "ones", "quality_imputed_flag")


@query(
    "impute_labels_random",
    f"""
with labelled as (
  select lang, quality, ('0x' || left(md5(doc_id || '|{impute.SEED}'), 12))::bigint / {float(1 << 48)} as u
  from documents left join labels using (doc_id))
select lang, cast(quality is null as integer) as quality_imputed_flag, count(*) as rows,
       cast(sum(coalesce(quality, cast(u < 0.5 as integer))) as bigint) as coin_ones,
       cast(sum(coalesce(quality, cast(u < 0.2 as integer))) as bigint) as bernoulli_ones
from labelled group by 1, 2
""",
)
def impute_labels_random(t):
    """Coin flips and Bernoulli(0.2) for missing labels; the same rows on every run and partitioning."""
    coin = impute.impute_labels(_labelled(t), "quality", impute.RANDOM, ["doc_id"])
    coin = coin.withColumnRenamed("quality_imputed", "coin").drop("quality_imputed_flag")
    both = impute.impute_labels(coin, "quality", impute.WITH_PROBABILITY, ["doc_id"], p=0.2)
    return both.groupBy("lang", "quality_imputed_flag").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("coin").alias("coin_ones"),
        F.sum("quality_imputed").alias("bernoulli_ones"),
    )


RECODED = ["p_brand", "p_type", "p_container"]
THRESHOLD_SHARE = 26


def _parts(t, part: str):
    """Parts cut in two by size; brand is missing for some, so that missing becomes a level."""
    cut = F.col("p_size") <= 30 if part == "train" else F.col("p_size") > 30
    return t.part.where(cut).select(
        F.col("p_partkey").alias("address_id"),
        F.when(F.col("p_partkey") % 13 != 0, F.col("p_brand")).alias("p_brand"),
        "p_type",
        F.substring_index("p_name", " ", 1).alias("p_container"),
    )


_PARTS_SQL = """
parts as (
  select p_partkey as address_id, p_size <= 30 as train,
         coalesce(case when p_partkey % 13 <> 0 then p_brand end, 'missing') as p_brand, p_type,
         split_part(p_name, ' ', 1) as p_container from part),
long as (unpivot parts on p_brand, p_type, p_container into name feature value level),
kept as (
  select feature, level, count(*) as entities from long where train group by all
  having count(*) >= (select count(*) // 26 from parts where train))
"""


def _fitted(t):
    train = _parts(t, "train")
    threshold = train.count() // THRESHOLD_SHARE
    return encode.fit_levels(train, RECODED, threshold)


@query("level_counts", f"with {_PARTS_SQL} select feature, level, entities from kept")
def level_counts(t):
    return _fitted(t)


_POOLED = ", ".join(
    f"coalesce((select k.level from kept k where k.feature = '{f}' and k.level = p.{f}), 'OTHER') as {f}" for f in RECODED
)


@query("recode_levels", f"with {_PARTS_SQL} select address_id, {_POOLED} from parts p where not train")
def recode_levels(t):
    """Test rows recoded with the levels fitted on the training rows."""
    kept = encode.levels_by_feature(_fitted(t))
    return encode.recode(_parts(t, "test"), kept, RECODED)


@query("recode_by_join", f"with {_PARTS_SQL} select address_id, {_POOLED} from parts p where not train")
def recode_by_join(t):
    """The same through joins, for features with too many kept levels for columns."""
    levels = _fitted(t)
    rows = _parts(t, "test")
    for feature in RECODED:
        rows = encode.recode_by_join(rows, levels, feature)
    return rows


@query(
    "level_dummies",
    f"""
with {_PARTS_SQL}, pooled as (select address_id, {_POOLED} from parts p where not train)
select l.feature, l.level, count(*) as rows,
       count(*) filter (where l.level = case l.feature when 'p_brand' then p_brand when 'p_type' then p_type
                                                       else p_container end) as ones
from pooled, (select feature, level from kept union select distinct feature, 'OTHER' from kept) l group by 1, 2
""",
)
def level_dummies(t):
    """Sums of the dummy columns, back in long form."""
    kept = encode.levels_by_feature(_fitted(t))
    wide = encode.level_dummies(_parts(t, "test"), kept, RECODED)
    made = {(f, v): f"{f}_{v}" for f in RECODED for v in dict.fromkeys([*kept.get(f, []), encode.OTHER])}
    sums = wide.agg(F.count(F.lit(1)).alias("rows"), *[F.sum(F.col(f"`{n}`")).alias(n) for n in made.values()])
    cells = [
        F.struct(F.lit(f).alias("feature"), F.lit(v).alias("level"), F.col("rows"), F.col(f"`{n}`").alias("ones"))
        for (f, v), n in made.items()
    ]
    return sums.select(F.inline(F.array(*cells)))


@query(
    "encoded_long_rows",
    """
with segments as (select c_mktsegment as s from customer group by 1 having count(*) >= (select count(*) // 5 from customer))
select o_orderkey, o_custkey as address_id, case when c_mktsegment in (select s from segments) then c_mktsegment else 'OTHER' end as segment,
       cast(c_mktsegment not in (select s from segments) as integer) as segment_OTHER
from orders left join customer on o_custkey = c_custkey where o_orderpriority = '1-URGENT'
""",
)
def encoded_long_rows(t):
    """Levels pooled and encoded once per customer, and put beside the customer's orders."""
    people = t.customer.select(F.col("c_custkey").alias("address_id"), F.col("c_mktsegment").alias("segment"))
    kept = encode.levels_by_feature(encode.fit_levels(people, ["segment"], people.count() // 5))
    encoded = encode.recode(encode.level_dummies(people, kept, ["segment"]), kept, ["segment"])
    long = t.orders.where("o_orderpriority = '1-URGENT'").select("o_orderkey", F.col("o_custkey").alias("address_id"))
    return encode.attach_by_entity(long, encoded.select("address_id", "segment", "segment_OTHER"))


def _flags(t, before: bool):
    day = F.lit("1998-01-01").cast("date")
    rows = t.lineitem.where(F.col("l_shipdate") < day if before else F.col("l_shipdate") >= day)
    price = F.when(F.col("l_quantity") > 40, "bulk").when(F.col("l_quantity") > 5, "box")
    return rows.select("l_orderkey", "l_linenumber", "l_returnflag", price.alias("pack"))


@query(
    "onehot_common",
    """
select l_orderkey, l_linenumber, l_returnflag, case when l_quantity > 40 then 'bulk' when l_quantity > 5 then 'box' end as pack,
       cast(l_returnflag = 'A' as integer) as l_returnflag_A, cast(l_returnflag = 'N' as integer) as l_returnflag_N,
       cast(l_returnflag = 'R' as integer) as l_returnflag_R,
       cast(l_quantity > 40 as integer) as pack_bulk, cast(l_quantity > 5 and l_quantity <= 40 as integer) as pack_box
from lineitem where l_shipdate >= date '1998-01-01'
""",
)
def onehot_common(t):
    """Levels seen before and after the cut become columns; null gives zeros."""
    train, test = _flags(t, True), _flags(t, False)
    common = encode.levels_by_feature(encode.common_levels(train, test, ["l_returnflag", "pack"]))
    return encode.one_hot(test, common)


@query(
    "minmax_scale",
    """
with b as (select min(c_acctbal) as lo, max(c_acctbal) as hi from customer where c_custkey % 3 <> 0)
select c_custkey, c_mktsegment, round((c_acctbal - lo) / (hi - lo), 6) as c_acctbal, 0.0::double as constant
from customer, b
""",
)
def minmax_scale(t):
    """All rows scaled with bounds from the training rows; the constant column becomes 0."""
    rows = t.customer.select("c_custkey", "c_mktsegment", "c_acctbal", F.lit(5).alias("constant"))
    bounds = scale.fit_minmax(rows.where(F.col("c_custkey") % 3 != 0), ["c_acctbal", "constant"])
    scaled = scale.minmax_scale(rows, bounds)
    return scaled.withColumn("c_acctbal", _six(F.col("c_acctbal")))


def _spelled(t):
    """Part names with every seventh spelled in another way (a letter left out or upper case)."""
    name = F.col("p_name")
    odd = F.when(F.col("p_partkey") % 7 == 0, F.concat(F.left(name, F.lit(2)), F.substr(name, F.lit(4))))
    return t.part.select("p_partkey", odd.when(F.col("p_partkey") % 7 == 1, F.upper(name)).otherwise(name).alias("name"))


_SPELLED_SQL = """
spelled as (
  select p_partkey, case when p_partkey % 7 = 0 then left(p_name, 2) || substr(p_name, 4) when p_partkey % 7 = 1 then upper(p_name) else p_name end as name
  from part),
counts as (select name, lower(trim(name)) as flat, count(*) as n from spelled group by 1)
"""


def _canonical_sql(d: int) -> str:
    return f"""
with recursive {_SPELLED_SQL.strip()},
links as (select distinct a.flat as a, b.flat as b from counts a, counts b where levenshtein(a.flat, b.flat) <= {d}),
reached as (select a, b from links union select r.a, l.b from reached r join links l on l.a = r.b),
parts as (select a as flat, min(b) as part from reached group by 1),
heads as (select part, first(name order by n desc, name) as canonical from counts join parts using (flat) group by 1),
mapping as (select name, canonical from counts join parts using (flat) join heads using (part))
select canonical as name, count(*) as parts from spelled join mapping using (name) group by 1
"""


def _canonical(t, d: int):
    rows = _spelled(t)
    counts = durable(rows.groupBy("name").agg(F.count(F.lit(1)).alias("n")))
    mapping = names.canonical_names(names.similar_keys(counts, d), counts)
    return names.rename(rows, "name", mapping).groupBy("name").agg(F.count(F.lit(1)).alias("parts"))


@query("name_canonical", _canonical_sql(1))
def name_canonical(t):
    """Spellings one edit apart, through any chain, get their most frequent form."""
    return _canonical(t, 1)


@query("name_canonical_two", _canonical_sql(2))
def name_canonical_two(t):
    """The same within two edits."""
    return _canonical(t, 2)


@query(
    "column_classes",
    f"""
select column_name, data_type,
  case when data_type = 'double precision' then 'continuous'
       when data_type in ('character varying', 'text') then 'character'
       when data_type = 'date' then 'date'
       when data_type in ('integer', 'bigint', 'numeric') then
         case when regexp_matches(column_name, '^(?:{columns.LABEL_NAMES})') then 'label'
              when regexp_matches(column_name, '^(?:{columns.BINARY_NAMES})')
                   and not regexp_matches(column_name, '^(?:{columns.FACTOR_NAMES})')
                   and not regexp_matches(column_name, '^(?:{columns.CHARACTER_NAMES})') then 'binary'
              when regexp_matches(column_name, '^(?:{columns.CHARACTER_NAMES})') then 'character'
              else 'continuous' end end as var_type
from (select case p_partkey % 8 when 0 then 'internal_opens_any_' when 1 then 'internal_borough_' when 2 then 'census_tract'
                                when 3 then 'internal_knocks_count_' when 4 then 'borough_factor_' when 5 then 'sp_'
                                when 6 then 'internal_opens_any_next_month' else 'x_flag_' end || p_name as column_name,
             case p_partkey % 7 when 0 then 'integer' when 1 then 'bigint' when 2 then 'numeric' when 3 then 'text'
                                when 4 then 'double precision' when 5 then 'date' else 'timestamp' end as data_type
      from part)
""",
)
def column_classes(t):
    """Classes of column names that are made from part names and types."""
    heads = ["internal_opens_any_", "internal_borough_", "census_tract", "internal_knocks_count_", "borough_factor_", "sp_",
             "internal_opens_any_next_month", "x_flag_"]
    kinds = ["integer", "bigint", "numeric", "text", "double precision", "date", "timestamp"]
    pick = lambda values, n: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("p_partkey") % n + 1).cast("int"))
    table = t.part.select(F.concat(pick(heads, 8), F.col("p_name")).alias("column_name"), pick(kinds, 7).alias("data_type"))
    return columns.classify_columns(table)


@query(
    "value_quantiles",
    """
select o_orderpriority, round(quantile_cont(o_totalprice, 0.9), 2) as q90, round(median(o_totalprice), 2) as q50
from orders group by 1
""",
)
def value_quantiles(t):
    counts = order_stats.value_counts(t.orders, ["o_orderpriority"], ["o_totalprice"])
    found = order_stats.quantiles(counts, ["o_orderpriority"], {"q90": 0.9, "q50": 0.5})
    return found.select("o_orderpriority", F.round("q90", 2).alias("q90"), F.round("q50", 2).alias("q50"))


# --- statistics of all splits ---------------------------------------------------------------------

SPLIT_DAYS = [f"{y}-{m:02d}-01" for y in (1996, 1998, 2000) for m in (1, 5, 9)]

_MONTHLY_SQL = f"""
monthly as (
  select cast(date_trunc('month', o_orderdate) as date) as month_start, o_custkey as address_id, o_custkey % 3 as borough,
         count(*)::double as orders_n, sum(o_totalprice)::double as spend, max(o_orderpriority) as top
  from orders group by 1, 2),
days as (select unnest([{", ".join(f"date '{d}'" for d in SPLIT_DAYS)}]) as split_date)
"""


def _monthly(t):
    return t.orders.groupBy(F.col("o_custkey").alias("address_id"), F.trunc("o_orderdate", "month").alias("month_start")).agg(
        F.count(F.lit(1)).alias("orders_n"), F.sum("o_totalprice").alias("spend"), F.max("o_orderpriority").alias("top")
    ).withColumn(impute.BOROUGH, F.col("address_id") % 3)


@query(
    "split_statistics",
    f"""
with {_MONTHLY_SQL},
long as (
  select month_start, borough, 'orders_n' as feature, round(orders_n, 2) as value from monthly
  union all select month_start, borough, 'spend', round(spend, 2) from monthly),
modes as (
  select split_date, borough, feature, value as mode from (
    select split_date, borough, feature, value, row_number() over (partition by split_date, borough, feature order by count(*) desc, value) as place
    from long join days on month_start < split_date group by 1, 2, 3, 4) where place = 1)
select split_date, borough as {impute.BOROUGH}, feature, count(*) as n, round(avg(value), 4) as mean, min(value) as min, max(value) as max,
       any_value(mode) as mode, round(median(value), 4) as median, round(quantile_cont(value, 0.9), 4) as q90
from long join days on month_start < split_date join modes using (split_date, borough, feature) group by 1, 2, 3
""",
)
def split_statistics(t):
    """Mean, bounds, mode, median and a quantile of the training rows of nine splits, per group, from one reading of the rows."""
    rows = _monthly(t).withColumns({"orders_n": F.round(F.col("orders_n").cast("double"), 2), "spend": F.round("spend", 2)})
    sketch = split_stats.month_sketch(rows, impute.BOROUGH, ["orders_n", "spend"])
    found = split_stats.split_statistics(sketch, SPLIT_DAYS, impute.BOROUGH, {"median": 0.5, "q90": 0.9})
    return found.withColumns({c: F.round(c, 4) for c in ("mean", "median", "q90")})


@query(
    "split_statistics_extended",
    f"""
with {_MONTHLY_SQL}
select split_date, borough as {impute.BOROUGH}, 'orders_n' as feature, count(*) as n, round(avg(orders_n), 4) as mean, round(median(orders_n), 4) as median
from monthly join days on month_start <= split_date group by 1, 2
""",
)
def split_statistics_extended(t):
    """The same from stored sketches to which a last month is added; splits reach through their own month."""
    name = f"{shared_dir(t.spark)}/sketches_{uuid4().hex}"
    rows, last = _monthly(t), F.lit(SPLIT_DAYS[-1]).cast("date")
    for part in (rows.where(F.col("month_start") < last), rows.where(F.col("month_start") >= last)):
        split_stats.store_sketch(split_stats.month_sketch(part, impute.BOROUGH, ["orders_n"]), name)
    stored = t.spark.read.parquet(name)
    found = split_stats.split_statistics(stored, SPLIT_DAYS, impute.BOROUGH, through_split=True)
    return found.select("split_date", impute.BOROUGH, "feature", "n", *[F.round(c, 4).alias(c) for c in ("mean", "median")])


@query(
    "split_levels",
    f"""
with {_MONTHLY_SQL}
select split_date, 'top' as feature, top as level, count(distinct address_id) as entities
from monthly join days on month_start < split_date group by all
""",
)
def split_levels(t):
    """Entities per level in the training rows of nine splits."""
    return split_stats.split_levels(_monthly(t), SPLIT_DAYS, ["top"])


@query(
    "many_quantiles",
    """
select l_returnflag, round(quantile_cont(l_extendedprice, 0.0), 6) as q0, round(quantile_cont(l_extendedprice, 0.1), 6) as q10,
       round(quantile_cont(l_extendedprice, 0.25), 6) as q25, round(median(l_extendedprice), 6) as q50,
       round(quantile_cont(l_extendedprice, 0.95), 6) as q95, round(quantile_cont(l_extendedprice, 1.0), 6) as q100
from lineitem group by 1
""",
)
def many_quantiles(t):
    """Six quantiles from one set of running counts."""
    shares = {f"q{round(q * 100)}": q for q in (0.0, 0.1, 0.25, 0.5, 0.95, 1.0)}
    found = order_stats.quantiles(order_stats.value_counts(t.lineitem, ["l_returnflag"], ["l_extendedprice"]), ["l_returnflag"], shares)
    return found.select("l_returnflag", *[F.round(c, 6).alias(c) for c in shares])
