"""The run over models and splits: called again, killed between two writes, run by two at once; things put once."""

import threading
from datetime import date

import pytest
from pyspark.sql import functions as F

from conftest import rows
from panelwright.operators import encode, models, registry
from panelwright.plans import model_run
from panelwright.sources import once

MONTHS = [date(2000, m, 1) for m in range(1, 7)]
KIND = "address_id bigint, month_start date, internal_borough_factor_static string, internal_units_static int, internal_peu_target_zip int, " \
    "internal_x_any_this_month int, internal_y_count_this_month double, kind string, label int"
TREE, LOGIT = {"algorithm": "DecisionTreeClassifier", "parameters": {"maxDepth": 2}}, {"algorithm": "Lasso", "parameters": {"maxIter": 3, "regParam": 0.01}}


@pytest.fixture(scope="module")
def panel(spark):
    data = []
    for i in range(40):
        for m in MONTHS:
            label = None if m == MONTHS[-1] or i % 7 == 0 else int((i + m.month) % 3 == 0)
            data.append((i, m, "ab"[i % 2], 1 + i % 9, 1, (i + m.month) % 2, None if i % 5 == 0 else float(i), ["red", "blue", None, "rare"][min(i % 4, 3) if i < 39 else 3], label))
    return spark.createDataFrame(data, KIND).checkpoint()


@pytest.fixture
def visited(panel):
    return panel.groupBy("month_start").agg(F.sum("internal_units_static").alias("units_canvassed"))


SETTINGS = model_run.Settings("label", ["internal_x_any_this_month", "internal_y_count_this_month"], levels=["kind"], level_threshold=5, feature_list_name="few")


def sizes(spark, folder):
    return {t: model_run.results(spark, folder, t).count() for t in model_run.TABLES}


def test_called_again(spark, panel, visited, tmp_path):
    """The second call fits nothing, a longer list fits what is new only, and a split without labels waits."""
    folder, days = str(tmp_path), ["2000-04-01", "2000-06-01"]
    assert model_run.run(panel, days, [TREE], visited, folder, SETTINGS, "key") == 1
    before = sizes(spark, folder)
    assert before["models"] == 1 and before["predictions"] == 40 and before["evaluations"] == 31
    assert model_run.run(panel, days, [TREE], visited, folder, SETTINGS, "key") == 0
    assert sizes(spark, folder) == before and len(list(tmp_path.glob("models/*"))) == 1
    known = panel.withColumn("label", F.coalesce("label", F.lit(0)))
    assert model_run.run(known, days, [TREE, LOGIT], visited, folder, SETTINGS, "key") == 3
    fitted = model_run.results(spark, folder, "models")
    assert rows(fitted.select("model_id", "model_group_id", "model_type", F.substring("training_table_name", 13, 10).alias("d"))) == [
        ("1", "1", "DecisionTreeClassifier", "2000-04-01"), ("2", "2", "Lasso", "2000-04-01"), ("3", "1", "DecisionTreeClassifier", "2000-06-01"), ("4", "2", "Lasso", "2000-06-01")]
    ranked = model_run.results(spark, folder, "predictions")
    assert ranked.where("score is null or rank_abs is null").count() == 0 and ranked.count() == 160
    assert rows(model_run.results(spark, folder, "feature_importances").where("model_id = 2").select("feature")) == [
        ("internal_x_any_this_month",), ("internal_y_count_this_month",), ("kind_blue",), ("kind_missing",), ("kind_rare",), ("kind_red",)]
    half = visited.where("month_start = '2000-04-01'").first()["units_canvassed"] // 2
    assert {r.top_k for r in model_run.results(spark, folder, "evaluations").where("model_id = 2").collect()} == {str(half)}
    assert registry.read_configs(spark, f"{folder}/configs").select("run_key").distinct().count() == 1


def test_killed_between_two_writes(spark, panel, visited, tmp_path, monkeypatch):
    """Rows that were written before the end are not seen, in any table, and the next call fits the model under a new number."""
    folder, whole = str(tmp_path), model_run.once.put_if_absent

    def dies(spark, path, text):
        if "/published/" in path:
            raise KeyboardInterrupt
        return whole(spark, path, text)

    monkeypatch.setattr(model_run.once, "put_if_absent", dies)
    with pytest.raises(KeyboardInterrupt):
        model_run.run(panel, ["2000-04-01"], [TREE], visited, folder, SETTINGS)
    monkeypatch.undo()
    assert len(list(tmp_path.glob("evaluations/attempt=*"))) == 1
    assert set(sizes(spark, folder).values()) == {0}
    assert model_run.run(panel, ["2000-04-01"], [TREE], visited, folder, SETTINGS) == 1
    assert rows(model_run.results(spark, folder, "predictions").select("model_id").distinct()) == [("2",)]
    assert sizes(spark, folder)["models"] == 1


def test_two_runs_at_once(spark, panel, visited, tmp_path):
    """Both write the same model; one is seen."""
    folder = str(tmp_path)
    groups = model_run.register_groups(spark, folder, [{"algorithm_type": "DecisionTreeClassifier", "label": "label", "parameters": {"maxDepth": 2}, "features": ["x"], "boroughs": ["all"]}])
    capacity = visited.select("month_start", F.lit(50).alias("top_k"))
    seen = []
    for number in (once.reserve_ids(spark, f"{folder}/ids/models", 1), once.reserve_ids(spark, f"{folder}/ids/models", 1)):
        todo = [r.asDict() | {"model_id": number} for r in model_run.candidates(spark, groups, ["2000-04-01"], SETTINGS).collect()]
        seen.append(model_run.publish(spark, folder, model_run.fit_split(panel, "2000-04-01", todo, [TREE], capacity, SETTINGS), todo))
    assert seen == [1, 0] and sizes(spark, folder)["models"] == 1 and sizes(spark, folder)["predictions"] == 40


def test_groups_are_shared(spark, tmp_path):
    spec = {"algorithm_type": "Lasso", "label": "y", "parameters": {"b": 1, "a": 2}, "features": ["f", "g"], "boroughs": ["B", "A"]}
    other = {**spec, "features": ["g", "f"], "boroughs": ["A", "B"]}
    assert model_run.register_groups(spark, str(tmp_path), [spec, other, {**spec, "label": "z"}])[:2] == [1, 1]
    assert model_run.register_groups(spark, str(tmp_path), [other, {**spec, "label": "q"}])[0] == 1
    assert model_run.model_groups(spark, str(tmp_path)).count() == 3


def at_once(n, act):
    out, gate = [], threading.Barrier(n)

    def one():
        gate.wait()
        out.append(act())

    threads = [threading.Thread(target=one) for _ in range(n)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    return out


def test_put_once_by_many(spark, tmp_path):
    path = f"{tmp_path}/a/x.json"
    assert sorted(at_once(8, lambda: once.put_if_absent(spark, path, "whole"))) == [False] * 7 + [True]
    assert once.read_text(spark, path) == "whole" and once.names_in(spark, f"{tmp_path}/a") == ["x.json"]
    assert once.names_in(spark, f"{tmp_path}/none") == []


def test_reserved_blocks_do_not_meet(spark, tmp_path):
    firsts = sorted(at_once(6, lambda: once.reserve_ids(spark, f"{tmp_path}/ids", 10)))
    assert firsts == [1, 11, 21, 31, 41, 51]
    assert once.reserve_ids(spark, f"{tmp_path}/ids", 1, behind=500) == 501


def test_config_is_appended_once(spark, tmp_path):
    folder = str(tmp_path)
    assert registry.read_configs(spark, folder).count() == 0
    assert sorted(at_once(4, lambda: registry.append_config(spark, folder, "run/1", {"a": [1, None], "b": "é\n"}))) == [False, False, False, True]
    assert not registry.append_config(spark, folder, "run/1", {"a": 2})
    assert registry.append_config(spark, folder, "none", {})
    assert rows(registry.read_configs(spark, folder)) == [("run/1", "a", "[1, null]"), ("run/1", "b", '"\\u00e9\\n"')]


def test_models_score_in_one_pass(spark):
    df = spark.range(200).select("id", (F.col("id") % 5).cast("double").alias("a"), (F.col("id") % 5 > 2).cast("int").alias("y")).checkpoint()
    fitted = {7: models.fit(df, ["a"], "y", "DecisionTreeClassifier"), 3: models.fit(df, ["a"], "y", "SVC", {"maxIter": 5}), 5: models.fit(df, ["a"], "y", "LassoCV", {"maxIter": 3})}
    long = models.score_all(fitted, df, ["id"])
    assert long._jdf.queryExecution().executedPlan().toString().count("Scan ExistingRDD") == 1
    for number, model in fitted.items():
        assert rows(long.where(F.col("model_id") == number).select("id", "score")) == rows(models.score(model, df, ["id"]))


def test_any_number_of_levels_in_a_model(spark):
    """100,000 levels as one sparse vector: the fit and the importances take them."""
    n = 100_000
    df = spark.range(n * 2).select(F.col("id").alias("address_id"), F.concat(F.lit("v"), F.col("id") % n).alias("f"), (F.col("id") % n < 10).cast("int").alias("y"))
    places = encode.level_places(encode.number_levels(encode.fit_levels(df, ["f"], 1)))
    vectors = encode.level_vector(df, places, ["f"])
    model = models.fit(vectors, ["levels"], "y", "LogisticRegression", {"maxIter": 2})
    top = models.importances(spark, model, [v for _, v in places]).orderBy(F.desc("feature_importance")).limit(10)
    assert {r.feature for r in top.collect()} == {f"v{i}" for i in range(10)}
    with pytest.raises(ValueError):
        encode.level_places(spark.createDataFrame([("f", "a", 0), ("f", "b", 1)], "feature string, level string, place long"), most=1)


def test_levels_as_vectors(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "new", None), (3, None, "x")], "address_id int, f string, g string")
    places = [("f", "a"), ("f", "missing"), ("g", "missing"), ("g", "x")]
    got = encode.level_vector(df, places, ["f", "g"]).orderBy("address_id").collect()
    assert [r.levels.indices.tolist() for r in got] == [[0, 3], [2], [1, 3]] and got[0].levels.size == 4
    assert encode.level_vector(df, [], ["f"]).first().levels.numNonzeros() == 0


def test_a_split_stores_only_what_it_reads(spark, tables, monkeypatch):
    """The stored rows give the train and test rows of the whole panel, and are fewer and narrower than it."""
    from panelwright.operators import splits
    from panelwright.plans import model_queries as mq
    from panelwright.plans.panel_queries import label_panel

    stored = []
    monkeypatch.setattr(mq, "durable", lambda df: stored.append(df) or df)
    monkeypatch.setattr(mq.monthly_run, "run_split", lambda panel, *a, **k: panel)
    got, whole = mq._run(tables, "DecisionTreeClassifier", {}).cache(), label_panel(tables).cache()
    assert got.count() == stored[0].count() < whole.count() / 3 and len(got.columns) < len(whole.columns) / 2
    for part in (lambda p: splits.train_rows(p, mq.SPLIT, mq.LABEL), lambda p: splits.test_rows(p, mq.SPLIT, 3)):
        assert rows(part(got)) == rows(part(whole.select(got.columns))) != []
