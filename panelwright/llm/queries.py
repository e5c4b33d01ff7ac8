"""The registered queries of this subpackage: each operator over its whole table, and its check SQL where SQL can express it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm import decontaminate, language_id, licenses, packing, prefix_trie, quality, ranked_search, sharding, simhash, suffix_dedup, token_counts, toxicity, url_filter
from panelwright.plans.catalog import Tables
from panelwright.session import shared_dir, tune

QUERIES: dict = {}
CHECK_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = lambda spark, folder: fn(Tables(tune(spark), folder))
        if sql is not None:
            CHECK_SQL[name] = sql
        return fn

    return register


@query("op1_best_fit_packing")
def best_fit_packing(t: Tables) -> DataFrame:
    return packing.pack(t.documents)


@query("op2_url_filters", url_filter.SQL)
def url_filters(t: Tables) -> DataFrame:
    """A page's outcome is the quality label of the document of the same number."""
    judged = url_filter.judge_urls(t.pages, t.labels.select("doc_id", "quality"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


@query("op3_benchmark_decontamination", decontaminate.SQL)
def benchmark_decontamination(t: Tables) -> DataFrame:
    return decontaminate.digest(decontaminate.find_benchmark(t.documents, t.benchmark))


@query("op4_suffix_array_dedup")
def suffix_array_dedup(t: Tables) -> DataFrame:
    return suffix_dedup.find_repeats(t.documents)


@query("op5_token_counts")
def token_count_totals(t: Tables) -> DataFrame:
    table = token_counts.CountTable(t.spark, f"{shared_dir(t.spark)}/token-totals-{uuid.uuid4().hex}")
    return token_counts.maintain(t.documents, table)


@query("op6_quality_rules", quality.SQL)
def quality_rules(t: Tables) -> DataFrame:
    judged = quality.judge_quality(t.documents)
    return judged.select("doc_id", *quality.COUNTS, "base_failed", "kept")


@query("op7_toxicity")
def toxicity_scores(t: Tables) -> DataFrame:
    return toxicity.score_toxicity(t.documents, t.labels.select("doc_id", "toxic"))


@query("op8_sharding")
def sharding_by_bytes(t: Tables) -> DataFrame:
    return sharding.shard(t.documents).withColumn("grown_shard", F.lit(None).cast("int"))


@query("op9_license_scans", licenses.SQL)
def license_scans(t: Tables) -> DataFrame:
    return licenses.scan_licenses(t.documents)


@query("op10_simhash_near_dedup")
def simhash_near_dedup(t: Tables) -> DataFrame:
    found = simhash.near_duplicates(t.documents)
    return found.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


@query("op11_ranked_search", ranked_search.SQL)
def ranked_lexical_search(t: Tables) -> DataFrame:
    return ranked_search.rank_documents(t.documents, t.benchmark)


@query("op12_language_id")
def language_predictions(t: Tables) -> DataFrame:
    return language_id.identify_languages(t.documents)


@query("op13_conversation_prefix_trie", prefix_trie.SQL)
def conversation_prefix_trie(t: Tables) -> DataFrame:
    return prefix_trie.prefix_trie(t.conversations)
