"""Every registered query against its SQL, and against itself on other partitionings."""

import importlib
import re
import subprocess
import sys

import pytest

import __spark_entry__ as entry
from conftest import SMALL, rows
from tools.check_queries import compare, connect

QUERIES, SQL = entry.queries(), entry.oracle_sql()
ROWS_ONLY = [q for q in QUERIES if q not in SQL]


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


# Kernel rows are computed in an Arrow function inside the tasks; all other checked queries stay in the JVM.
PYTHON = {"rbf_pairs"}


@pytest.mark.parametrize("name", list(SQL))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    text = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin", text)
    assert name in PYTHON or not re.search(r"EvalPython|MapInPandas|FlatMapGroups", text)
    assert compare(duck, df, SQL[name]) == []


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0


def test_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_queries_load_without_a_session():
    code = "import __spark_entry__ as e; assert e.queries() and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=importlib.util.find_spec("__spark_entry__").origin.rsplit("/", 1)[0])


PARTITIONED = ["panel_monthly", "rank_scores", "metrics_at_k", "group_stats", "impute_labels_random", "name_canonical", "serial_ids"]


@pytest.mark.parametrize("name", PARTITIONED)
def test_same_on_any_partitioning(spark, many_pieces, name):
    results = []
    for n in (1, 7, 20):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            results.append(rows(QUERIES[name](spark, SMALL)))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 8)
    assert results[0] == results[1] == results[2]
