"""Sources, sinks, registry, names, columns, kernels and models on small inputs."""

import json
import os
from datetime import date, datetime

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, IsNotNull
from pyspark.sql.types import StructType

from conftest import rows
from panelwright.operators import columns, kernel, models, names, registry, summary
from panelwright.plans import monthly_run
from panelwright.sources import paged, tables as store


def test_typed_write_and_restore(spark, tmp_path):
    df = spark.createDataFrame([("", 1, 2.5), ("x", None, 3.0)], "a string, b bigint, c double")
    store.write_typed(df, f"{tmp_path}/t")
    back = store.read_table(spark, f"{tmp_path}/t")
    assert {t for _, t in back.dtypes} == {"string"}
    assert rows(back) == [("None", "1", "2.5"), ("x", "None", "3.0")]
    store.write_typed(df, f"{tmp_path}/u", {"a": "string"}, default_to_text=False)
    assert dict(store.read_table(spark, f"{tmp_path}/u").dtypes) == {"a": "string", "b": "bigint", "c": "double"}
    store.backup(df, f"{tmp_path}/csv")
    assert store.restore_csv(spark, f"{tmp_path}/csv", df.schema).count() == 2
    with pytest.raises(ValueError):
        store.backup(df, f"{tmp_path}/x", "hdf")


def test_build_if_absent_and_append(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.createDataFrame([(date(2016, 1, 1), 1)], "as_of_date date, x int")

    name = f"{tmp_path}/t"
    store.build_table(spark, name, build)
    store.build_table(spark, name, build)
    assert len(calls) == 1
    store.append_rows(build(), f"{tmp_path}/p")
    store.append_rows(build(), f"{tmp_path}/p")
    assert store.read_table(spark, f"{tmp_path}/p").count() == 2
    assert store.build_table(spark, name, build, rebuild=True).count() == 1


def test_replace_only_the_given_splits(spark, tmp_path):
    name = f"{tmp_path}/s"
    make = lambda day, x: spark.createDataFrame([(day, x)], "split_date date, x int")
    store.replace_splits(make(date(2016, 4, 1), 1).union(make(date(2016, 5, 1), 2)), name)
    store.replace_splits(make(date(2016, 5, 1), 9), name)
    back = store.read_table(spark, name)
    assert rows(back.select("split_date", "x")) == [("2016-04-01", "1"), ("2016-05-01", "9")]
    assert [r[0] for r in store.available_splits(back).collect()] == [date(2016, 4, 1), date(2016, 5, 1)]


def test_versions_and_row_update(spark, tmp_path):
    folder = f"{tmp_path}/v"
    store.write_version(spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string"), folder, 1)
    current, version = store.read_latest(spark, folder)
    change = spark.createDataFrame([(2, "new")], "id int, name string")
    store.write_version(registry.updated_rows(current, change, "id"), folder, version + 1)
    latest, version = store.read_latest(spark, folder)
    assert version == 2 and rows(latest) == [("1", "a"), ("2", "new")]
    # Half written: part files without the marker are not seen.
    store.write_version(spark.createDataFrame([(7, "half")], "id int, name string"), folder, 3)
    os.remove(f"{folder}/version=3/_SUCCESS")
    latest, version = store.read_latest(spark, folder)
    assert version == 2 and rows(latest) == [("1", "a"), ("2", "new")]
    with pytest.raises(FileNotFoundError):
        os.makedirs(f"{tmp_path}/empty")
        store.read_latest(spark, f"{tmp_path}/empty")


def test_query_parameters_and_label_keys(spark):
    assert store.read_query(spark, "select :a + 1 as x", a=4).first().x == 5
    assert store.label_key("internal_opens_any_next_month") == "anyopen"
    assert store.label_key("internal_cases_opened_per_unit_next_month_binary", 0.75) == "casethresholdlower"
    with pytest.raises(ValueError):
        store.label_key("internal_cases_opened_per_unit_next_month_binary", 0.5)


def test_paged_source(spark, tmp_path):
    for offset in (0, 2):
        with open(f"{tmp_path}/page_{offset}.json", "w") as page:
            page.writelines(json.dumps({"id": offset + i, "name": f"n{i}"}) + "\n" for i in range(2))
    spark.dataSource.register(paged.PagedJson)
    with open(f"{tmp_path}/page_9000000.json", "w") as page:
        page.write(json.dumps({"id": 9, "name": None, "at": "2024-01-01T00:09:58.778549", "day": "2024-02-29"}) + "\n")
    reader = spark.read.format("paged_json").schema("id int, name string, at timestamp, day date")
    df = reader.option("path", str(tmp_path)).option("pages_per_task", 2).load()
    assert rows(df.select("id", "name")) == [("0", "n0"), ("1", "n1"), ("2", "n0"), ("3", "n1"), ("9", "None")]
    last = df.where("id = 9").first()
    assert (last.at, last.day) == (datetime(2024, 1, 1, 0, 9, 58, 778549), date(2024, 2, 29))
    assert df.rdd.getNumPartitions() == 2
    with pytest.raises(Exception, match="No such file"):
        reader.option("path", f"{tmp_path}/absent").load().count()
    assert [r.offset for r in paged.page_offsets(spark, 25_000).collect()] == [0, 10_000, 20_000]


def test_filters_reach_the_pages(spark, tmp_path, monkeypatch):
    """Comparisons with constants are taken by the reader, all others go back; a page that fails to open twice is read at the third try."""
    schema = StructType().add("id", "long").add("name", "string").add("x", "double")
    for offset in (0, 50):
        with open(f"{tmp_path}/page_{offset}.json", "w") as page:
            page.writelines(json.dumps({"id": offset + i, "name": f"n{i}" if i % 5 else None, "x": i / 2}) + "\n" for i in range(50))
    df = paged.read_paged_json(spark, str(tmp_path), schema, pages_per_task=1)
    kept = df.where("id >= 20 and id < 70 and name in ('n1', 'n2', 'n31') and x > 0.6")
    assert rows(kept.select("id", "name")) == [("31", "n31"), ("52", "n2")]
    reader = paged._PageReader({"path": str(tmp_path)}, schema)
    given = [GreaterThan(("id",), 90), IsNotNull(("name",)), GreaterThan(("x",), 1.0), EqualTo(("name", "part"), "n")]
    assert list(reader.pushFilters(given)) == given[2:]
    tries = []

    def fails_twice(*args):
        tries.append(args)
        if len(tries) < 3:
            raise OSError("busy")
        return open(*args)

    monkeypatch.setattr(paged, "open", fails_twice, raising=False)
    monkeypatch.setattr(paged, "WAIT", 0)
    batches = [b for part in reader.partitions() for b in reader.read(part)]
    assert len(tries) == 4 and sorted(v for b in batches for v in b.column("id").to_pylist()) == [91, 92, 93, 94, 96, 97, 98, 99]


def test_source_catalog(spark, tmp_path):
    path = f"{tmp_path}/list.csv"
    with open(path, "w") as f:
        f.write("dataname,apilink,include,unique_id,size_approx\nlit,https://h/resource/ab-1.json,Yes,1,\nx,no,Yes,0,5\ny,https://h/resource/c.json,No,0,5\n")
    catalog = paged.source_catalog(spark, path)
    assert rows(catalog.select("dataname", "json_id")) == [("lit", "ab-1")]
    assert paged.dataset_id(catalog, "lit").first()[0] == "ab-1"


def test_names_against_brute_force(spark):
    given = ["acme corp", "acme corp", "acme corp", "acme crp", "ACME corp", "acmes corp", "acmes corps", "zeta", "zeta", "zetas", "other"]
    df = spark.createDataFrame([(n,) for n in given], "name string")
    counts = df.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    got = {r.name: r.canonical for r in names.canonical_names(names.edit_keys(counts), counts).collect()}

    def keys(n):
        flat = n.strip().lower()
        return {flat} | {flat[:i] + flat[i + 1:] for i in range(len(flat))}

    want, left = {}, set(given)
    while left:
        group, fresh = set(), {min(left)}
        while fresh:
            group |= fresh
            fresh = {n for n in left - group if any(keys(n) & keys(g) for g in group)}
        head = min(group, key=lambda n: (-given.count(n), n))
        want |= {n: head for n in group}
        left -= group
    assert got == want
    renamed = names.rename(df, "name", spark.createDataFrame([("zetas", "zeta")], "name string, canonical string"))
    assert renamed.where("name = 'zeta'").count() == 3


def test_long_chains_of_names_join_up(spark):
    chain = [(f"k{i}", f"n{j:03d}") for i in range(40) for j in (i, i + 1)]
    members = spark.createDataFrame(chain, "group_key string, name string")
    assert {r.component for r in names.connected_names(members).collect()} == {"n000"}


def test_hot_key_in_names(spark):
    """One key shared by very many names is one aggregate, not their pairs."""
    members = spark.range(30_000).select(F.lit("hot").alias("group_key"), F.format_string("n%06d", "id").alias("name"))
    assert names.connected_names(members).select("component").distinct().count() == 1


def test_column_names(spark):
    assert columns.unique_names(["A", "a", "B", "a_1", "A"]) == ["a", "a_1", "b", "a_1_1", "a_2"]
    df = spark.createDataFrame([(1, 2)], "Zip int, Bin int")
    assert columns.mark_static(columns.with_unique_names(df), ["zip"]).columns == ["zip_static", "bin"]
    assert columns.common_features(["a", "b,c", "d", "e"], ["a", "b,c", "e", "x"], ["a", "b,c", "x"], ["d"]) == ["a"]


def test_feature_lists():
    cols = ["address_id", "month_start", "internal_bin_static", "internal_units_static", "internal_opens_any_next_month",
            "internal_knocks_count_next_month", "internal_opens_any_this_month", "internal_cases_opened_count_ever",
            "hpdviols_count_ever", "housinglitig_any_this_month", "pluto_yearbuilt", "acs_tract_percent_x", "rent_a", "month"]
    lists = columns.feature_lists(cols)
    assert lists["internal_static"] == ["internal_units_static"]
    assert lists["external_violations"] == ["hpdviols_count_ever", "housinglitig_any_this_month"]
    assert lists["internal_dynamic_nolabels_orlaggedlabels"] == ["internal_cases_opened_count_ever"]
    assert "acs_tract_percent_x" not in lists["all_features_minusACS"]
    assert "month" not in lists["allfeatures_nolabels_orlaggedlabels"]
    assert lists["all_external"] == ["hpdviols_count_ever", "housinglitig_any_this_month", "pluto_yearbuilt", "rent_a", "acs_tract_percent_x"]
    assert columns.deep_dive_list(lists, ["t"])[-1] == "t"


def test_list_table(spark):
    table = columns.list_table(spark, {"x": ["a", "b"], "y": ["b"]})
    assert rows(table.where("list_name = 'x'").select("column").intersect(table.where("list_name = 'y'").select("column"))) == [("b",)]


def test_registry_rows(spark):
    specs = [{"algorithm_type": "Lasso", "label": "y", "parameters": {"b": 1, "a": 2}, "features": ["f", "g"], "boroughs": ["B", "A"]}]
    groups = registry.model_group_rows(spark, specs)
    empty = spark.createDataFrame([], "model_group_id long")
    numbered = registry.with_serial_ids(groups, empty, "model_group_id", ["algorithm_type", "label"])
    assert numbered.first().model_group_id == 1
    other = spark.createDataFrame([(7, "Lasso", "y", '{"a":2,"b":1}', "g,f", "A_B")],
        "candidate_id int, algorithm_type string, label string, hyperparameters string, feature_list string, borough_fit_on string")
    assert registry.match_model_groups(other, numbered).first().model_group_id == 1
    weights = spark.createDataFrame([(1, "f", 0.5)], "model_group_id long, feature string, coefficient double")
    row = registry.model_rows(numbered, weights, "train", "none").first()
    assert json.loads(row.model_parameters) == {"f": 0.5}
    config = registry.run_config(spark, "r1", {"k": [1, 2]})
    assert registry.only_new(config, config, ["run_key"]).count() == 0
    assert registry.already_known(config, config, ["run_key"]).count() == 1


def test_serial_ids_go_on_behind_the_largest(spark):
    fresh = spark.createDataFrame([("b",), ("a",)], "name string")
    out = registry.with_serial_ids(fresh, spark.createDataFrame([(4,)], "id long"), "id", ["name"])
    assert rows(out) == [("5", "a"), ("6", "b")]


def test_capacity_share_of_a_model(spark):
    df = spark.range(1, 11).select(summary.capacity_share(F.col("id").cast("int")).alias("s"))
    assert [r.s for r in df.collect()] == [0.01, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 9.0, 10.0]


def test_best_models_keep_ties_and_missing_ratios_lose(spark):
    data = [("m", "2016-01-01", 0.1, 1, 2.0), ("m", "2016-02-01", 0.1, 2, 2.0), ("m", "2016-03-01", 0.1, 3, None), ("few", "2016-01-01", 0.1, 4, 9.0)]
    wide = spark.createDataFrame(data, "model_and_hyp string, test_set_month string, top_k_rank double, model_id long, precision_ratio double")
    out = summary.best_models(wide, [0.1], ["2016-01-01", "2016-02-01", "2016-03-01"]).collect()
    assert {r.model_and_hyp for r in out} == {"m"}
    assert {(r.modelid_ofmax, r.modelid_ofmin) for r in out} == {(a, b) for a in (1, 2) for b in (1, 2)}
    assert out[0].test_set_months_all == "2016-01-01; 2016-02-01; 2016-03-01"


@pytest.mark.parametrize(
    "family, parameters",
    [("DecisionTreeClassifier", {}), ("LogisticRegression", {}), ("LassoCV", {"maxIter": 5}), ("SVC", {"maxIter": 8})],
)
def test_families_fit_score_and_explain(spark, family, parameters):
    df = spark.range(300).select((F.col("id") % 10).cast("double").alias("a"), F.rand(3).alias("b"),
                                 (F.col("id") % 10 > 4).cast("int").alias("y"))
    model = models.fit(df, ["a", "b"], "y", family, parameters)
    scored = models.score(model, df, ["y"])
    assert scored.where("(score > 0.5) = (y = 1)").count() > 280
    assert scored.where("score < 0 or score > 1").count() == 0
    top = models.importance_rows(models.importances(spark, model, ["a", "b"]), 3).where("rank_abs = 1").first()
    assert (top.feature, top.model_id) == ("a", 3)


def test_unknown_family():
    with pytest.raises(ValueError):
        models.estimator("KNeighborsClassifier")


def test_kernel_rows_against_numpy(spark):
    x = np.random.default_rng(1).random((40, 3))
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id int, v array<double>")
    marks = df.where("id < 4").withColumnRenamed("id", "mark")
    got = kernel.rbf_against(df, marks, "id", "mark", "v", sigma=0.4, count=4).collect()
    assert len(got) == 160
    for r in got:
        assert r.k == pytest.approx(np.exp(-((x[r.id] - x[r.mark]) ** 2).sum() / (2 * 0.4**2)))
    with pytest.raises(ValueError):
        kernel.landmark_rows(df, "id", "v", 10)


def test_kernel_classifier_separates_a_ring(spark):
    df = spark.range(600).select(F.rand(1).alias("a"), F.rand(2).alias("b")).withColumn(
        "y", (((F.col("a") - 0.5) ** 2 + (F.col("b") - 0.5) ** 2) < 0.09).cast("int")).checkpoint()
    out = kernel.fit_kernel_classifier(df, ["a", "b"], "y", landmarks=20, sigma=0.2).score(df, ["y"])
    assert out.where("(score > 0.5) = (y = 1)").count() > 540


def test_run_with_unseen_group_and_every_k(spark):
    """A test row of a group that train does not hold is scored and flagged; a feature that is kept as well is prepared and kept raw."""
    kind = "address_id long, month_start date, internal_borough_factor_static string, internal_units_static int, x double, y int, internal_peu_target_zip int"
    months = [date(2000, m, 1) for m in (1, 2, 3)]
    data = [(i, m, "new" if i == 0 and m == months[2] else "ab"[i % 2], 10 + i, None if i % 5 == 0 else float(i), int(i > 9), 1) for i in range(20) for m in months]
    parts = monthly_run.prepared_split(spark.createDataFrame(data, kind), "2000-03-01", ["internal_units_static", "x"], "y")
    done = monthly_run.fit_prepared(parts, "2000-03-01", ["internal_units_static", "x"], "y", 1, "DecisionTreeClassifier", {}, [30, 60])
    assert parts[1].where("group_unseen = 1").count() == 1
    assert parts[1].agg(F.min("internal_units_static"), F.max("internal_units_static"), F.max("_kept_internal_units_static")).first()[:] == (0.0, 1.0, 29)
    assert rows(done.predictions.groupBy("top_k").count()) == [("30", "20"), ("60", "20")]
    assert done.predictions.where("score is null or rank_abs is null").count() == 0


def test_ids_without_bounds(spark):
    view = spark.createDataFrame([(5, summary.DEFAULT_LABEL, summary.DEFAULT_BOROUGHS), (950_000_000, summary.DEFAULT_LABEL, summary.DEFAULT_BOROUGHS)],
                                 "model_id bigint, label string, borough_fit_on string")
    assert summary.pick_evaluations(view).count() == 2
    assert summary.pick_evaluations(view, low=6).count() == 1
    assert summary.pick_evaluations(view, ids=[5]).first().model_id == 5


def test_repeated_append_is_decided(spark):
    df = spark.createDataFrame([("k", 2, 0.5), ("k", 2, 0.25), ("k", 1, 0.1)], "key string, model_id int, value double")
    for n in (1, 3):
        assert rows(summary.drop_older(df.repartition(n), ["key"])) == [("k", "2", "0.25")]


def test_models_by_splits(spark, tables, tmp_path):
    from panelwright.plans import model_queries as mq
    from panelwright.plans.panel_queries import label_panel
    from panelwright.session import durable

    panel = durable(label_panel(tables))
    done = list(monthly_run.run_models(panel, ["2000-01-01", "2000-06-01"], [{"algorithm": "DecisionTreeClassifier"}],
                                       mq.FEATURES, mq.LABEL, top_k=[100, 200], boroughs=["all"]))
    assert len(done) == 2
    first = done[0].predictions
    assert first.where("score is null or rank_abs is null").count() == 0
    assert {r.top_k for r in first.select("top_k").distinct().collect()} == {100, 200}
    assert {r.top_k for r in done[1].evaluations.select("top_k").distinct().collect()} == {"100", "200"}
    assert done[0].importances.count() == len(mq.FEATURES)
    for result in done:
        monthly_run.store_result(result, str(tmp_path))
    stored = store.read_table(spark, f"{tmp_path}/evaluations")
    assert rows(stored.select("model_id").distinct()) == [("1",), ("2",)]
    assert store.read_table(spark, f"{tmp_path}/predictions").where("model_id = 1").count() == first.count()
    assert store.read_table(spark, f"{tmp_path}/feature_importances").count() == 2 * len(mq.FEATURES)
