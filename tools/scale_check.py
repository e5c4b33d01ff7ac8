"""Time headline queries on the driver tables with every entity repeated n times.

usage: python tools/scale_check.py FOLDER N [query ...]

Customers, orders, their lines and documents are copied under new keys, into a new temporary folder.
"""

from __future__ import annotations

import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F

from panelwright.plans import all_queries
from panelwright.session import local_session

# Key columns per table, moved by copy * step so that joins between copies stay intact.
KEYS = {
    "customer": ["c_custkey"],
    "orders": ["o_orderkey", "o_custkey"],
    "lineitem": ["l_orderkey"],
    "documents": ["doc_id"],
    "labels": ["doc_id"],
}
PLAIN = ["nation", "region", "supplier", "part", "events", "embeddings"]
STEP = 10_000_000
DEFAULT = ["panel_monthly", "full_panel", "worker_flags", "metrics_at_k", "rank_scores"]


def enlarge(spark, source: str, n: int) -> str:
    target = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    for name in PLAIN:
        spark.read.parquet(f"{source}/{name}.parquet").write.parquet(f"{target}/{name}.parquet")
    for name, keys in KEYS.items():
        rows = spark.read.parquet(f"{source}/{name}.parquet")
        if name == "documents":
            rows = rows.drop("text")
        copies = rows.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        moved = copies.withColumns({k: F.col(k) + F.col("copy") * STEP for k in keys}).drop("copy")
        moved.write.parquet(f"{target}/{name}.parquet")
    return target


def main(source: str, n: int, names: list[str]) -> None:
    spark = local_session("scale", "8", shuffle_partitions=8 * max(1, n // 2))
    folder = enlarge(spark, source, n) if n > 1 else source
    for name in names or DEFAULT:
        start = time.perf_counter()
        all_queries()[name](spark, folder).write.format("noop").mode("overwrite").save()
        print(f"{name:20}x{n} {time.perf_counter() - start:8.2f}s", flush=True)


if __name__ == "__main__":
    main(sys.argv[1], int(sys.argv[2]), sys.argv[3:])
