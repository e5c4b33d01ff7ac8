"""Hand-worked rows for the decisions that are easy to get wrong."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from panelwright.functions import scalars as s
from panelwright.operators import encode, evaluate, impute, order_stats, panel, ranking, rollups, scale, splits


def column(df, name, order):
    return [r[name] for r in df.orderBy(order).collect()]


def test_carry_forward_takes_the_last_known_value(spark):
    df = spark.createDataFrame([("a", date(2016, m, 1), x) for m, x in enumerate([None, 3, None, 5, None], 1)],
                               "address_id string, month_start date, x int")
    out = panel.carry_forward(df, {"last": "x"})
    assert column(out, "last", "month_start") == [None, 3, 3, 5, 5]
    # Sorting null rows first, as a database without IGNORE NULLS might, would give back x itself.
    assert column(out, "x", "month_start") == [None, 3, None, 5, None]
    assert column(panel.carry_forward(df, {"last": "x"}, fill=0), "last", "month_start") == [0, 3, 3, 5, 5]


def test_history_before_the_window_counts_unless_the_panel_starts_late(spark):
    entities = spark.createDataFrame([("a", 6)], "address_id string, units int")
    seen = spark.createDataFrame([("a", date(2016, 1, 1), 4)], "address_id string, month_start date, total int")

    def carried(start):
        dense = panel.dense_panel(entities, start, "2016-04-01", units="units")
        return panel.carry_forward(panel.attach(dense, seen), {"last": "total"})

    whole = splits.test_rows(carried("2016-01-01"), "2016-03-01", target=None)
    late = splits.test_rows(carried("2016-03-01"), "2016-03-01", target=None)
    assert [r["last"] for r in whole.collect()] == [4]
    assert [r["last"] for r in late.collect()] == [None]


@pytest.mark.parametrize("bounded", [True, False])
def test_average_ranks(spark, bounded):
    scores = [0.9, 0.8, 0.8, 0.8, 0.8, 0.1]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(scores)], "m int, id int, score double")
    out = ranking.with_ranks(df, ["m"], bounded=bounded)
    assert column(out, "rank_abs", "id") == [1, 3, 3, 3, 3, 6]
    assert column(out, "rank_pct", "id") == pytest.approx([r / 6 for r in [1, 3, 3, 3, 3, 6]])


def test_average_rank_of_an_even_tie_is_cut(spark):
    df = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.5)], "m int, id int, score double")
    assert column(ranking.with_ranks(df, ["m"]), "rank_abs", "id") == [1, 1]


def scored(spark, labels, units):
    data = [(1, 1, i, 1.0 - i / 10, u, y) for i, (y, u) in enumerate(zip(labels, units))]
    return spark.createDataFrame(data, "model_id int, as_of_date int, entity_id int, score double, units int, label int")


@pytest.mark.parametrize("k, last", [(6, 2), (12, 3), (99, 3)])
def test_capacity_row(spark, k, last):
    df = scored(spark, [1, 1, 1], [4, 3, 5])
    assert ranking.within_capacity(df, k).count() == last


@pytest.mark.parametrize("bounded", [True, False])
@pytest.mark.parametrize("inclusive, cells", [(False, (1, 0, 1, 1)), (True, (1, 1, 1, 0))])
def test_confusion_stops_before_the_capacity_row(spark, inclusive, cells, bounded):
    df = scored(spark, [1, 0, 1], [1, 1, 1])
    row = evaluate.metrics_at_k(df, "label", 2, inclusive=inclusive, bounded=bounded).first()
    names = ["true_positive", "false_positive", "false_negative", "true_negative"]
    assert tuple(row[f"confusion_{n}_no_impute"] for n in names) == cells
    assert row.precision_no_imputed == 0.5


def test_bounds_under_missing_labels(spark):
    row = evaluate.metrics_at_k(scored(spark, [1, None, 0], [1, 1, 1]), "label", 2).first()
    assert (row.precision_lower_bound, row.precision_upper_bound) == (0.5, 1.0)
    assert (row.precision_all, row.recall_all) == (1.0, 1.0)
    assert (row.recall_upper_bound, row.recall_lower_bound) == (1.0, 1.0)


def test_metrics_against_a_plain_loop(spark, tables):
    """All metrics at k of one group, recomputed row by row."""
    import random

    rng = random.Random(5)
    labels = [rng.choice([0, 1, None]) for _ in range(60)]
    units = [rng.randint(1, 9) for _ in range(60)]
    df = scored(spark, labels, units)
    for k in (1, 37, 150, 10_000):
        row = evaluate.metrics_at_k(df, "label", k).first()
        last, total = None, 0
        for i, u in enumerate(units, 1):
            total += u
            if total >= k:
                last = i
                break
        last = last or len(units)
        upper = [(1 if y is None else y) if i <= last else (0 if y is None else y) for i, y in enumerate(labels, 1)]
        assert row.confusion_true_positive_upper_bound == sum(upper[: last - 1])
        assert row.confusion_false_negative_upper_bound == sum(upper[last - 1:])
        known = [y for y in labels[:last] if y is not None]
        assert row.precision_all == (sum(known) / len(known) if known else 0.0)
        cells = [row[f"confusion_{c}{f}"] for f in evaluate.FILLS[1:] for c in evaluate.CELLS]
        assert [sum(cells[i: i + 4]) for i in range(0, 16, 4)] == [60] * 4
        assert row.precision_lower_bound <= row.precision_upper_bound
        assert row.recall_lower_bound <= row.recall_upper_bound


def test_k_may_differ_by_group(spark):
    df = scored(spark, [1, 0, 1], [4, 3, 5]).withColumn("k", F.lit(6))
    row = evaluate.metrics_at_k(df, "label", F.col("k")).first()
    assert (row.top_k, row.precision_no_imputed) == (6, 0.5)


def test_constant_column_scales_to_zero(spark):
    df = spark.createDataFrame([(5,), (5,)], "x int")
    assert column(scale.minmax_scale(df, scale.fit_minmax(df, ["x"])), "x", "x") == [0.0, 0.0]


def test_scaled_training_values_lie_in_the_unit_interval(spark, tables):
    df = tables.customer.select("c_acctbal")
    out = scale.minmax_scale(df, scale.fit_minmax(df, ["c_acctbal"])).agg(F.min("c_acctbal"), F.max("c_acctbal")).first()
    assert tuple(out) == (0.0, 1.0)


def test_mode_takes_the_smallest_and_median_is_exact(spark):
    df = spark.createDataFrame([("b", x) for x in (2, 2, 1, 1, 3)] + [("c", -4), ("c", 7)], "g string, x int")
    counts = order_stats.value_counts(df, ["g"], ["x"])
    assert {r.g: r["mode"] for r in order_stats.modes(counts, ["g"]).collect()} == {"b": 1.0, "c": -4.0}
    assert {r.g: r["median"] for r in order_stats.medians(counts, ["g"]).collect()} == {"b": 2.0, "c": 1.5}


def test_imputation_rules(spark):
    kind = "internal_borough_factor_static string, x double"
    train = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", None)], kind)
    test = spark.createDataFrame([("a", None), ("b", None), ("new", None), (None, None), (None, 9.0)], kind)
    methods = {"x": impute.MEAN}
    out = impute.impute_features(test, impute.fit_group_stats(train, methods), methods).collect()
    # An all-missing group gives 0, an unseen group stays missing, no group falls back to 0.
    assert sorted((str(r[0]), r[1]) for r in out if r[1] is not None) == [("None", 0.0), ("None", 9.0), ("a", 2.0), ("b", 0.0)]
    assert [r[0] for r in out if r[1] is None] == ["new"]


def test_random_labels_keep_their_rate(spark):
    df = spark.range(20_000).select(F.col("id").alias("k"), F.lit(None).cast("int").alias("y"))
    for method, p, want in ((impute.RANDOM, None, 0.5), (impute.WITH_PROBABILITY, 0.2, 0.2)):
        out = impute.impute_labels(df, "y", method, ["k"], p=p)
        assert out.agg(F.avg("y_imputed")).first()[0] == pytest.approx(want, abs=0.02)
    none = impute.impute_labels(df.limit(5), "y", "none", ["k"])
    assert none.where("y_imputed is null and y_imputed_flag = 1").count() == 5


def test_codes(spark):
    df = spark.createDataFrame([("5", "42"), ("12", "1234567"), ("123", ""), ("", "12345")], "c string, t string")
    out = [tuple(r) for r in df.select(s.county_code("c"), s.tract_code("t")).collect()]
    assert out == [("005", "000042"), ("012", "1234567"), ("123", ""), ("", "012345")]


def test_text_functions(spark):
    df = spark.createDataFrame([("12ab_cd", "x/resource/a.json.json", "02--29-2016"), ("", "none", "2016-02-29")],
                               "n string, link string, d string")
    out = df.select(s.display_name("n"), s.resource_id("link"), s.case_date("d")).collect()
    assert tuple(out[0]) == ("12Ab Cd", "a.json", date(2016, 2, 29))
    assert tuple(out[1]) == ("", "", None)


def test_week_across_months(spark):
    raw = spark.createDataFrame([(1, "Heat x", "02--29-2016"), (1, "Tenant Action y", "03--02-2016")],
                                "bin int, casetype string, caseopendate string")
    out = rollups.weekly_litigation(raw).orderBy("month_start").collect()
    assert [(r.week_start, r.month_start, r.housinglitig_ever_count) for r in out] == [
        (date(2016, 2, 29), date(2016, 2, 1), 1),
        (date(2016, 2, 29), date(2016, 3, 1), 2),
    ]
    monthly = rollups.monthly_litigation(rollups.weekly_litigation(raw)).orderBy("month_start").collect()
    assert [r.housinglitig_heatwater_any for r in monthly] == [1, 0]


def test_level_recode(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(["a", "a", "b", None, None])], "address_id int, f string")
    kept = encode.levels_by_feature(encode.fit_levels(df, ["f"], 2))
    assert column(encode.recode(df, kept, ["f"]), "f", "address_id") == ["a", "a", "OTHER", "missing", "missing"]
    joined = encode.recode_by_join(df, encode.fit_levels(df, ["f"], 2), "f")
    assert column(joined, "f", "address_id") == ["a", "a", "OTHER", "missing", "missing"]
    wide = encode.level_dummies(df, kept, ["f"]).orderBy("address_id").collect()
    assert [r.f_OTHER for r in wide] == [0, 0, 1, 0, 0]


def test_any_number_of_levels(spark):
    df = spark.range(10_050).select(F.col("id").alias("address_id"), F.concat(F.lit("St. "), "id").alias("f"), F.lit("x").alias("g"))
    numbered = encode.number_levels(encode.fit_levels(df, ["f", "g"], 1))
    assert numbered.agg(F.min("place"), F.max("place"), F.count_distinct("place")).first()[:] == (0, 10_050, 10_051)
    assert len(encode.levels_by_feature(encode.fit_levels(df, ["f"], 1))["f"]) == 10_050
    sparse = encode.encode_sparse(df, numbered, ["f", "g"], "address_id")
    assert sparse.where("size(places) = 2 and places[1] = 10050").count() == 10_050
    assert encode.encode_sparse(df, numbered.where("feature = 'g'"), ["f"], "address_id").where("size(places) = 0").count() == 10_050


def test_levels_with_dots(spark):
    df = spark.createDataFrame([(1, "St. Mary"), (2, "St_ Mary"), (3, None)], "address_id int, f string")
    kept = encode.levels_by_feature(encode.fit_levels(df, ["f"], 1))
    wide = encode.level_dummies(df, kept, ["f"]).orderBy("address_id")
    assert wide.columns[2:] == ["f_St_ Mary", "f_St_ Mary_2", "f_missing", "f_OTHER"]
    assert [tuple(r)[2:] for r in wide.select(*wide.columns).collect()] == [(1, 0, 0, 0), (0, 1, 0, 0), (0, 0, 1, 0)]


def test_one_hot_null_is_all_zeros(spark):
    train = spark.createDataFrame([("x",), ("y",)], "f string")
    test = spark.createDataFrame([("x",), (None,), ("z",)], "f string")
    common = encode.levels_by_feature(encode.common_levels(train, test, ["f"]))
    assert common == {"f": ["x"]}
    assert sorted((str(r.f), r.f_x) for r in encode.one_hot(test, common).collect()) == [("None", 0), ("x", 1), ("z", 0)]


def test_guarded_ratio(spark):
    df = spark.createDataFrame([(0.3, 0.0), (0.0, 0.0), (0.3, 0.6), (None, 0.5)], "n double, d double")
    assert [r[0] for r in df.select(s.guarded_ratio("n", "d")).collect()] == [100.0, 0.0, 0.5, None]


def test_labels_of_next_month(spark):
    kind = "address_id string, month_start date, internal_knocks_count long, internal_knocks_any int, internal_opens_count long, internal_opens_any int"
    entities = spark.createDataFrame([("a", "10", "1", 1, 10)],
        "address_id string, internal_bin_static string, internal_census_tract_static string, internal_zip_static int, internal_units_static int")
    visits = spark.createDataFrame([("a", date(2016, 2, 1), 4, 1, 2, 1), ("a", date(2016, 3, 1), 1, 1, 0, 0), ("a", date(2016, 4, 1), 2, 1, 1, 1)], kind)
    opened = spark.createDataFrame([("a", date(2016, 2, 1), 3, 1, 3)],
        "address_id string, month_start date, internal_cases_opened_thismonth_count long, internal_cases_opened_thismonth_any int, internal_cases_opened_ever_count long")
    out = panel.build_panel(entities, "2016-01-01", "2016-04-01", visits, opened).orderBy("month_start").collect()
    assert [r.internal_cases_opened_any_next_month for r in out] == [1, None, 0]
    assert [r.internal_knocks_count_next_month for r in out] == [4, 1, 2]
    assert out[0].internal_cases_opened_per_unit_next_month == pytest.approx(0.3)
    assert out[0].internal_cases_opened_per_open_next_month == pytest.approx(1.5)
    assert out[0].internal_cases_opened_per_knock_next_month == pytest.approx(0.75)
    assert [r.internal_cases_opened_count_ever for r in out] == [None, 3, 3]
    assert [r.internal_cases_opened_count_this_month for r in out] == [None, 3, None]


def test_target_flag(spark):
    df = spark.createDataFrame([(date(2016, 1, 1), date(2016, 2, 1)), (date(2016, 2, 1), date(2016, 2, 1)), (date(2016, 2, 1), None)],
                               "m date, first date")
    assert [r[0] for r in df.select(s.target_flag("m", "first")).collect()] == [0, 1, 0]


def test_split_list_and_disjoint_parts(spark):
    days = splits.split_dates()
    assert (len(days), days[0], days[-1]) == (23, date(2016, 4, 1), date(2018, 2, 1))
    entities = spark.createDataFrame([("a", 9)], "address_id string, units int")
    dense = panel.dense_panel(entities, "2016-01-01", "2016-12-01", units="units").withColumn("internal_peu_target_zip", F.lit(1))
    train = {r.month_start for r in splits.train_rows(dense, "2016-06-01").collect()}
    test = {r.month_start for r in splits.test_rows(dense, "2016-06-01", months=2).collect()}
    assert not train & test and len(train) == 5 and test == {date(2016, 6, 1), date(2016, 7, 1)}
    after = {r.month_start for r in splits.test_rows(dense, "2016-06-01", after_split=True).collect()}
    assert after == {date(2016, 7, 1)}


def test_panel_is_dense(spark, tables):
    from panelwright.plans import standins as st

    people = st.entities(tables)
    kept = people.where("internal_units_static >= 6").count()
    dense = panel.dense_panel(people, "1995-01-01", "1996-12-01", units="internal_units_static")
    assert dense.count() == kept * 24


def test_ranks_sum_up_without_ties(spark):
    df = spark.range(500).select(F.lit(1).alias("m"), F.col("id"), (F.col("id") / 500).alias("score"))
    assert ranking.with_ranks(df, ["m"]).agg(F.sum("rank_abs")).first()[0] == 500 * 501 // 2


def test_capacity_list_rounds_half_to_even(spark):
    df = spark.createDataFrame([(1, 1, 30), (2, 0, 20), (3, None, 900)], "month_start int, label int, units int")
    out = evaluate.capacity_list(df, "label", "units", [0.1, 0.5, 0.02, 0.3, 0.7]).collect()
    assert {r.share: r.top_k for r in out} == {0.1: 2, 0.5: 12, 0.02: 0, 0.3: 8, 0.7: 18}
    none = df.withColumn("label", F.lit(None).cast("int"))
    assert evaluate.capacity_list(none, "label", "units").count() == 0
    assert evaluate.months_without_labels(none, "label").count() == 3


def test_null_groups_and_scores_are_ranked(spark):
    df = spark.createDataFrame([(1, None, 0.5), (1, None, 0.9), (1, "m", None), (1, "m", 0.2)], "model_id int, as_of_date string, score double")
    for bounded in (True, False):
        out = ranking.with_ranks(df, bounded=bounded)
        assert sorted((str(r.as_of_date), str(r.score), r.rank_abs, r.rank_pct) for r in out.collect()) == [
            ("None", "0.5", 2, 1.0), ("None", "0.9", 1, 0.5), ("m", "0.2", 1, 0.5), ("m", "None", 2, 1.0)]
