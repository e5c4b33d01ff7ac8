"""Texts of one id, items without an id, items longer than a block, columns of the operators' own names, empty tables."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from panelwright.llm import decontaminate, near_copies, quality, suffix_dedup
from panelwright.llm.queries import CHECK_SQL
from tools.check_queries import compare


def letters(n):
    return "".join(random.choice("abcdefgh ") for _ in range(n))


@pytest.mark.parametrize("prefix", [150, 0])
def test_passage_goes_from_all_texts_of_an_id(spark, prefix):
    """Two texts of id 5 in one partition share a passage with a smaller id in another one: both lose it, whole."""
    random.seed(12)
    one, two, three, shared = letters(150), letters(170), letters(160), letters(400)
    left = spark.createDataFrame([(1, shared + three)], "doc_id bigint, text string").coalesce(1)
    right = spark.createDataFrame([(5, one + shared), (5, two + shared)], "doc_id bigint, text string").coalesce(1)
    parts = [left, right] if prefix else [right, left]
    got = sorted((r.doc_id, r.n_removed) for r in suffix_dedup.find_repeats(parts[0].union(parts[1])).collect())
    assert got == [(1, 0), (5, 400), (5, 400)]


def test_items_without_an_id_hit(spark):
    import duckdb

    words = [f"w{i}" for i in range(40)]
    docs = spark.createDataFrame([(1, " ".join(words[:20])), (2, " ".join(words[20:])), (3, "short one"), (4, "clean")], "doc_id bigint, text string")
    items = spark.createDataFrame([(None, " ".join(words[:20])), (7, " ".join(words[5:35])), (None, "Short, one")], "item_id bigint, text string")
    found = decontaminate.find_benchmark(docs, items)
    assert {r.doc_id: (sum(h["end"] - h["start"] for h in r.hits), r["items"]) for r in found.collect()} == {1: (20, ["7"]), 2: (15, ["7"]), 3: (2, []), 4: (0, [])}
    assert [r.doc_id for r in decontaminate.drop_contaminated(docs, items).collect()] == [4]
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    con.register("benchmark", items.toArrow())
    assert compare(con, decontaminate.digest(found), CHECK_SQL["op3_benchmark_decontamination"]) == []


def test_long_items_lie_in_several_blocks(spark):
    random.seed(3)
    words = [f"x{random.randrange(400)}" for _ in range(300)]
    docs = spark.createDataFrame([(i, " ".join(words[i * 7 : i * 7 + 25])) for i in range(40)], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[100:112])), (3, "x1 x2")], "item_id bigint, text string")
    blocks = list(decontaminate.item_blocks(items, "item_id", "text", 10, 400))
    assert len(blocks) > 10 and max(sum(len(w.split()) for _, w in b) for b in blocks) < 60
    whole, cut = (decontaminate.digest(decontaminate.find_benchmark(docs, items, block_bytes=b)) for b in (10**9, 3_000))
    assert sorted(whole.collect()) == sorted(cut.collect()) and whole.where("contaminated").count() == 40


def test_item_pieces_hold_every_window():
    for n in (0, 1, 9, 10, 11, 50):
        words = [b"w%d" % i for i in range(n)]
        for most in (1, 60, 10_000):
            pieces = list(decontaminate.item_pieces(words, 10, most))
            assert set().union(*[decontaminate.windows_of(p, 10) for _, p in pieces]) == decontaminate.windows_of(words, 10)
            assert sum(max(1, len(p) - 9) for _, p in pieces) == (max(1, n - 9) if n else 0)


def odd_documents(spark):
    base = " ".join(f"common{i % 40}x{i} of" for i in range(60))
    rows = [(1, base, 1, "a", 0), (2, base + " end", 2, "b", 0), (2, base + " end", 2, "b", 0), (3, None, 3, None, 1), (None, base, 4, "c", 1), (5, "", 5, "", None)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, _near_node int, _null string, _m int")


def test_columns_of_own_names_are_kept(spark):
    docs = odd_documents(spark)
    for step in (near_copies.keep_one, suffix_dedup.without_repeats, quality.keep_good, lambda d: decontaminate.drop_contaminated(d, d.select("text", F.lit(None).cast("string").alias("item_id")).limit(0))):
        out = step(docs)
        assert out.columns == docs.columns
        given = {(r.doc_id, r["_near_node"], r["_null"], r["_m"]) for r in docs.collect()}
        assert {(r.doc_id, r["_near_node"], r["_null"], r["_m"]) for r in out.collect()} <= given
    assert {r["_near_node"] for r in near_copies.keep_one(docs).collect()} == {1, 3, 4}
    assert suffix_dedup.without_repeats(docs).where("text is null").select("_near_node").first()[0] == 3


def test_stages_on_an_empty_table(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        assert out.count() == 0 and (name == "best_fit_packing" or out.columns == docs.columns)


def test_leader_is_the_text_that_others_were_edited_from(spark):
    """400 edits of one text, which differ from each other by more than the bound: one component from one round of pairs."""
    random.seed(8)
    base = [f"w{random.randrange(10**6)}" for _ in range(200)]
    texts = [" ".join(base)]
    for n in range(400):
        words = list(base)
        words[random.randrange(200)] = words[random.randrange(200)] = f"new{n}"
        words[random.randrange(200)] = f"newer{n}"
        texts.append(" ".join(words))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert [r.doc_id for r in near_copies.keep_one(df).select("doc_id").collect()] == [0]
