"""Similar names against all pairs; capacity rows against plain sums; statistics of splits against their rows; plans of these."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from panelwright.operators import evaluate, impute, names, order_stats, split_stats
from panelwright.plans import ranking_queries as rq


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


# --- names ------------------------------------------------------------------------------------


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def linked_by_hand(every, d):
    flat = {n: n.strip(" ").lower() for n in every}
    root = {n: n for n in every}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a in every:
        for b in every:
            if distance(flat[a], flat[b]) <= d:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {n: find(n) for n in every}


@pytest.mark.parametrize("d, heavy", [(1, 200), (2, 200), (2, 2), (1, 0)])
def test_similar_names_against_all_pairs(spark, d, heavy):
    """Short and long names, repeated letters, and grams that nearly all share, which are linked without pairs."""
    draw = random.Random(d * 10 + heavy)
    base = ["".join(draw.choice("ab") for _ in range(draw.randint(0, 9))) for _ in range(25)]
    base += ["street " + "".join(draw.choice("abcdefgh") for _ in range(draw.randint(3, 12))) for _ in range(30)]
    for n in base[25:45]:
        at = draw.randrange(len(n))
        base += [n[:at] + n[at + 1 :], n[:at] + "x" + n[at:], n[:at] + "yz" + n[at + 2 :], n.upper(), f" {n}"]
    every = sorted(set(base))
    df = spark.createDataFrame([(n,) for n in every] + [(None,), (every[3],)], "name string")
    got = names.connected_names(names.similar_keys(df, d, heavy=heavy))
    assert dict(rows(got)) == {n: str(c) for n, c in linked_by_hand(every, d).items()}


def test_gram_that_most_names_share_makes_no_square(spark):
    df = spark.range(3_000).select(F.concat(F.lit("main road "), F.lpad((F.col("id") * 7919 % 10_000).cast("string"), 4, "0"), F.lit(" north")).alias("name"))
    keys = names.similar_keys(df, 1)
    assert keys.where("group_key like 'pair %'").count() < 200_000
    assert names.canonical_names(keys, df.withColumn("n", F.lit(1))).count() == 3_000


# --- capacity rows ----------------------------------------------------------------------------


def scored(spark, n=4_000):
    df = spark.range(n).select(
        (F.col("id") % 3).alias("model_id"), F.lit("m").alias("as_of_date"), F.col("id").alias("entity_id"), (F.col("id") * 31 % 97 / 97.0).alias("score"),
        F.when(F.col("id") % 11 != 0, F.col("id") % 5).alias("units"), F.when(F.col("id") % 4 != 0, (F.col("id") % 7 < 3).cast("int")).alias("label"),
    )
    none = spark.range(40).select(F.lit(9).alias("model_id"), F.lit(None).cast("string").alias("as_of_date"), "id", F.lit(0.5), F.lit(0), F.lit(None).cast("int"))
    return df.union(none)


KS = [0, 1, 2, 399, 400, 401, 2_000, 10**9]


@pytest.mark.parametrize("inclusive", [False, True])
def test_capacity_rows_in_pieces_as_in_one(spark, many_pieces, inclusive):
    df = scored(spark).repartition(13)
    spread = evaluate.metrics_at_k(df, "label", KS, inclusive=inclusive)
    assert rows(spread) == rows(evaluate.metrics_at_k(df, "label", KS, inclusive=inclusive, bounded=True))
    assert spread.count() == 4 * len(KS)


def test_capacity_rows_against_plain_sums(spark):
    data = sorted(scored(spark).where("model_id = 1").collect(), key=lambda r: (-r.score, -(r.units if r.units is not None else -1), r.entity_id))
    got = {r.top_k: r for r in evaluate.metrics_at_k(scored(spark), "label", KS).where("model_id = 1").collect()}
    for k in KS:
        for known, name in ((False, "precision_lower_bound"), (True, "precision_no_imputed")):
            own, units = [r for r in data if not known or r.label is not None], 0
            for last, r in enumerate(own, 1):
                units += r.units or 0
                if units >= k:
                    break
            assert got[k][name] == pytest.approx(sum(r.label or 0 for r in own[:last]) / last)


def test_one_k_per_group(spark, many_pieces):
    df = scored(spark).withColumn("limit", F.col("model_id") * 300)
    got = evaluate.metrics_at_k(df, "label", F.col("limit"))
    for m in (0, 1, 2, 9):
        one = evaluate.metrics_at_k(df.where(F.col("model_id") == m), "label", m * 300)
        assert rows(got.where(F.col("model_id") == m)) == rows(one)
    assert evaluate.metrics_at_k(df.withColumn("limit", F.lit(None).cast("int")), "label", F.col("limit")).where("top_k is null").count() == 4


def test_no_row_is_repeated_per_k(spark, tables):
    eight = evaluate.metrics_at_k(rq.scored_documents(tables), "label", KS, rq.GROUP)
    text = plan(eight)
    assert "Generate" not in text and 0 < text.index("Expand") < text.index("Filter")


def test_only_wanted_pieces_are_ordered(spark, many_pieces):
    from panelwright.operators import ranking

    df = scored(spark).where("model_id < 9").repartition(5)
    some = ranking.ranked_rows(df, "label", pieces=evaluate._pieces_with([F.lit(2)]))
    assert 0 < some.count() < 4_000
    every = ranking.ranked_rows(df, "label")
    assert some.exceptAll(every).count() == 0


# --- statistics of splits ---------------------------------------------------------------------

DAYS = ["2000-02-01", "2000-03-01", "2000-06-01", "2001-01-01"]


def monthly(spark):
    return spark.range(900).select(
        F.add_months(F.lit("2000-01-01").cast("date"), (F.col("id") % 7).cast("int")).alias("month_start"),
        F.when(F.col("id") % 10 > 0, F.col("id") % 3).alias("g"), (F.col("id") * 37 % 50 / 4.0).alias("x"),
        F.when(F.col("id") % 6 > 0, F.col("id") % 4).alias("y"), (F.col("id") % 60).alias("address_id"), F.when(F.col("id") % 3 > 0, F.lit("a")).alias("f"),
    )


def test_split_statistics_against_their_rows(spark, many_pieces):
    df = monthly(spark)
    stats = split_stats.split_statistics(split_stats.month_sketch(df, "g", ["x", "y"]), DAYS, "g", {"median": 0.5, "q10": 0.1, "q100": 1.0})
    got = {(str(r.split_date), r.g, r.feature): r for r in stats.collect()}
    data = df.toPandas()
    assert len(got) == len(DAYS) * 3 * 2
    for day in DAYS:
        for g in (0, 1, 2):
            for f in ("x", "y"):
                v = data[(data.month_start.astype(str) < day) & (data.g == g)][f].dropna().to_numpy(float)
                values, n = np.unique(v, return_counts=True)
                r = got[day, g, f]
                assert (r.n, r.min, r.max, r.mode) == (len(v), v.min(), v.max(), values[n.argmax()])
                assert [r["mean"], r.median, r.q10, r.q100] == pytest.approx([v.mean(), np.median(v), np.quantile(v, 0.1), v.max()])


def test_split_statistics_fill_features(spark):
    """A split's row of statistics is what a fit on its training rows gives."""
    df = monthly(spark)
    stats = split_stats.split_statistics(split_stats.month_sketch(df, "g", ["x", "y"]), DAYS, "g")
    methods = {"x": impute.MEAN, "y": impute.MEDIAN}
    for day in DAYS:
        want = impute.fit_group_stats(df.where(F.col("month_start") < F.lit(day).cast("date")), methods, "g")
        own = split_stats.group_stats_of(stats, day, {"x": "mean", "y": "median"}, "g")
        both = {r.g: (r.x, r.y) for r in want.collect()}, {r.g: (r.x, r.y) for r in own.collect()}
        assert both[0].keys() == both[1].keys() and all(both[0][k] == pytest.approx(both[1][k]) for k in both[0])


def test_one_reading_for_all_splits(spark, tables):
    sketch = split_stats.month_sketch(tables.orders.withColumn("m", F.trunc("o_orderdate", "month")), "o_orderstatus", ["o_totalprice"], month="m")
    stats = split_stats.split_statistics(sketch, DAYS, "o_orderstatus", month="m")
    assert plan(sketch).count("Scan parquet") == 1 and "Scan parquet" not in plan(stats)
    assert "Generate" not in plan(stats)


def test_split_levels_against_their_rows(spark):
    df, got = monthly(spark), split_stats.split_levels(monthly(spark), DAYS, ["f"])
    for day in DAYS:
        from panelwright.operators import encode

        want = encode.level_counts(df.where(F.col("month_start") < F.lit(day).cast("date")), ["f"])
        assert rows(got.where(F.col("split_date") == F.lit(day).cast("date")).drop("split_date")) == rows(want)


def test_months_without_rows(spark):
    df = monthly(spark)
    none = split_stats.split_statistics(split_stats.month_sketch(df, "g", ["x"]), ["1999-01-01"], "g")
    assert none.count() == 0


def test_quantiles_from_one_count(spark, many_pieces):
    df = spark.range(501).select((F.col("id") % 2).alias("g"), (F.col("id") * 13 % 101 / 3.0).alias("v"))
    shares = {f"q{i}": i / 7 for i in range(8)}
    got = order_stats.quantiles(order_stats.value_counts(df, ["g"], ["v"]), ["g"], shares)
    data = df.toPandas()
    for r in got.collect():
        assert [r[n] for n in shares] == pytest.approx([np.quantile(data[data.g == r.g].v, q) for q in shares.values()])
    # Every quantile is an aggregate of the same ordered counts.
    one, eight = (order_stats.quantiles(order_stats.value_counts(df, ["g"], ["v"]), ["g"], q) for q in (0.5, shares))
    assert plan(one).count("Exchange") == plan(eight).count("Exchange")
