"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query runs in full (noop sink, so no column is pruned away), once to warm up and once timed.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from panelwright.plans import all_queries  # noqa: E402
from panelwright.session import local_session  # noqa: E402

HEADLINE = [
    "panel_monthly",
    "carry_forward",
    "full_panel",
    "case_issue_rollup",
    "followup_chain",
    "worker_flags",
    "split_train",
    "split_profile",
    "impute_group_stats",
    "recode_levels",
    "rank_scores",
    "curve_bounds",
    "metrics_at_k",
    "topk_entities",
    "quantile_label",
    "rbf_pairs",
    "wide_metrics",
    "best_models",
]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark = local_session("bench", cores, shuffle_partitions=int(cores) if cores.isdigit() else 8)
    queries = all_queries()
    seconds = {}
    for name in names:
        for _ in range(2):
            start = time.perf_counter()
            run(queries[name](spark, folder))
            seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
