"""What the plans must look like at any size."""

import re

from pyspark.sql import functions as F

from panelwright.operators import prefix
from panelwright.plans import standins as st
from panelwright.plans.panel_queries import visit_panel

def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_dense_rows_keep_their_place(spark, tables):
    """Joins and windows after the calendar was exploded need no exchange of dense rows."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(visit_panel(tables))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    above = text[: text.index("Generate explode")]
    left = [line for line in above.splitlines() if re.match(r"^[ :]*\+- Exchange", line) and ":" not in line]
    assert left == []


def test_date_limit_and_columns_reach_the_scan(spark, tables):
    text = st.visits(tables, before="1996-01-01")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[.*LessThan\(o_orderdate", text)
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert "o_totalprice" not in schema


def test_running_totals_hold_no_group_in_one_task(spark, many_pieces):
    """A group with nearly all rows is spread over many pieces, and gives what a plain window gives."""
    df = spark.range(20_000).select(
        F.when(F.col("id") % 50 == 0, F.col("id") % 7).alias("g"), F.col("id"), (F.col("id") % 13).alias("x")
    )
    args = (["g"], [F.col("id").desc()], {"run": F.col("x")}, {"all": F.col("x")})
    names = {"row_number": "rn", "row_count": "n"}
    spread = prefix.running_totals(df, *args, **names)
    plain = prefix.running_totals(df, *args, **names, bounded=True)
    assert spread.exceptAll(plain).count() == 0 and plain.exceptAll(spread).count() == 0
    pieces = df.repartitionByRange("g", F.col("id").desc()).withColumn("p", F.spark_partition_id())
    assert pieces.where("g is null").select("p").distinct().count() > 4


def test_running_totals_without_group(spark, many_pieces):
    df = spark.range(1_000).select("id", F.lit(2).alias("x"))
    out = prefix.running_totals(df, [], [F.col("id")], {"run": F.col("x")}, row_number="rn")
    assert out.where((F.col("run") != 2 * F.col("rn")) | (F.col("rn") != F.col("id") + 1)).count() == 0


def test_newest_rows_are_cut_before_the_shuffle(spark, tables):
    from panelwright.operators import summary

    df = summary.drop_older(tables.orders, ["o_custkey"], "o_orderkey")
    assert "WindowGroupLimit" in plan(df)


def test_a_hot_building_is_cut_into_pieces(spark, tables):
    """A building with most entities: same features with and without pieces, and several pieces in use."""
    from panelwright.functions import skew
    from panelwright.operators import panel as p
    from panelwright.operators import rollups

    people = st.entities(tables).withColumn(
        "internal_bin_static", F.when(F.col("address_id") % 3 > 0, "hot").otherwise(F.col("internal_bin_static"))
    )
    seen = st.violations(tables).withColumn(
        "bin_clean", F.when(F.col("bin_clean").cast("int") % 2 == 0, "hot").otherwise(F.col("bin_clean"))
    )
    args = (people, "1995-01-01", "1996-01-01", st.visits(tables), st.opened_cases(tables))
    whole = p.build_panel(*args, violations=rollups.monthly_violations(seen))
    cut = p.build_panel(*args, violations=rollups.monthly_violations(seen), rows_per_piece=10)
    assert whole.exceptAll(cut).count() == 0 and cut.exceptAll(whole).count() == 0
    heavy = skew.heavy_keys(people, "internal_bin_static", 10)
    assert [r.internal_bin_static for r in heavy.collect()] == ["hot"]
    assert skew.with_piece(people, heavy, "internal_bin_static", "address_id").select(skew.PIECE).distinct().count() > 5


def test_wide_panel_moves_no_dense_rows(spark, tables):
    """No exchange of dense rows above the calendar; buildings meet entity-years by piece; first visits are aggregated once."""
    from panelwright.plans.panel_queries import full_panel

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(full_panel(tables))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    above = text[: text.index("Generate explode")]
    left = [line for line in above.splitlines() if re.match(r"^[ :]*\+- Exchange", line) and ":" not in line]
    assert left == []
    assert re.search(r"SortMergeJoin \[bin_clean#\d+, panel_year#\d+, _key_piece#\d+\]", text)
    assert len(re.findall(r"Aggregate\(keys=\[zip#", text)) <= 2 or "ReusedExchange" in text


def test_broadcast_is_bounded_by_bytes(spark):
    """Rows alone do not decide: a wide statistic of few rows is shuffled."""
    from panelwright.functions.sizing import broadcast_if_small

    narrow = spark.range(5_000)
    wide = narrow.select("id", *[F.lit(0.0).alias(f"f{i}") for i in range(1_000)])
    assert "ResolvedHint" in broadcast_if_small(narrow)._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" not in broadcast_if_small(wide)._jdf.queryExecution().analyzed().toString()
