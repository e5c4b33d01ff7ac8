"""End-to-end chains and the registered queries with their check SQL."""

from __future__ import annotations


def _load():
    from panelwright.plans import catalog, extension_queries, feature_queries, model_queries, panel_queries, ranking_queries, results_queries, run_queries, store_queries  # noqa: F401

    return catalog


def all_queries():
    return dict(_load().QUERIES)


def all_check_sql():
    return dict(_load().CHECK_SQL)
