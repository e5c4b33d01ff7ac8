"""Shards of near-equal bytes by Karmarkar-Karp differencing of indivisible groups.

Groups (equal texts) are summed up, cut by a hash of their key into chunks of bounded size, and differenced within each chunk by a task: the two
partial partitions with the largest spread are combined, oppositely ordered, until one is left. The chunks' partitions are partial partitions themselves;
they are differenced again, level by level in tasks, until few are left for the driver. So no task and no driver ever sees more
than a chunk, and the spread of the whole is that of the last few steps.
"""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions.sizing import broadcast_if_small
from panelwright.llm.common import stored, text_or_empty

SHARDS = 16
CHUNK_GROUPS = 20_000
DRIVER_PARTITIONS = 2_000


def difference(partitions: list[list[int]]) -> tuple[list[list[int]], list[int]]:
    """(order, sums): slot s of partial partition i goes to subset order[i][s] of the whole; sums of the subsets.

    Ties in spread are broken by position, so that the result does not depend on the order of a heap.
    """
    if not partitions:
        return [], []
    k = len(partitions[0])
    heap, made = [], []
    for i, sums in enumerate(partitions):
        slots = sorted(range(k), key=lambda s: -sums[s])
        ordered = [sums[s] for s in slots]
        made.append((None, None, slots))
        heap.append((ordered[-1] - ordered[0], i, ordered))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a, x = heapq.heappop(heap)
        _, b, y = heapq.heappop(heap)
        joined = [x[s] + y[k - 1 - s] for s in range(k)]
        slots = sorted(range(k), key=lambda s: -joined[s])
        made.append((a, b, slots))
        ordered = [joined[s] for s in slots]
        heapq.heappush(heap, (ordered[-1] - ordered[0], len(made) - 1, ordered))
    # Top down: where each node's slots (in its own descending order) end up.
    goal: list = [None] * len(made)
    goal[-1] = list(range(k))
    order: list = [None] * len(partitions)
    for n in range(len(made) - 1, -1, -1):
        a, b, slots = made[n]
        to = [0] * k
        for rank, s in enumerate(slots):
            to[s] = goal[n][rank]
        if a is None:
            order[n] = to
        else:
            goal[a] = to
            goal[b] = to[::-1]
        goal[n] = None
    return order, heap[0][2]


def _chunk(shards: int):
    """One chunk of groups: each group's subset, and the subsets' sums on the rows of the first group."""

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["size", "key"], ascending=[False, True], kind="stable")
        order, sums = difference([[int(s)] + [0] * (shards - 1) for s in pdf["size"]])
        return pd.DataFrame({"chunk": pdf["chunk"], "key": pdf["key"], "size": pdf["size"], "subset": [o[0] for o in order]})

    return run


def _level(shards: int):
    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values("chunk", kind="stable")
        order, sums = difference([list(map(int, s)) for s in pdf["sums"]])
        rows = [(up, int(c), o) for up, c, o in zip(pdf["up"], pdf["chunk"], order)]
        return pd.DataFrame(rows, columns=["up", "chunk", "order"]).assign(sums=[sums] * len(rows))

    return run


def _whole(partials: DataFrame, shards: int, fit: int) -> DataFrame:
    """partials (chunk, sums) -> (chunk, order): the final subset of each of a chunk's subsets. More than `fit` are combined by tasks first."""
    spark = partials.sparkSession
    rows = partials.limit(fit + 1).collect()
    if len(rows) <= fit:
        rows.sort(key=lambda r: r["chunk"])
        order, _ = difference([list(r["sums"]) for r in rows])
        return spark.createDataFrame([(r["chunk"], o) for r, o in zip(rows, order)], "chunk bigint, order array<int>")
    up = F.floor(F.col("chunk") / fit).cast("bigint")
    step = partials.withColumn("up", up).groupBy("up").applyInPandas(_level(shards), "up bigint, chunk bigint, order array<int>, sums array<bigint>")
    step = stored(step, "shard-level")
    tops = step.groupBy("up").agg(F.first("sums").alias("sums")).select(F.col("up").alias("chunk"), "sums")
    above = _whole(stored(tops, "shard-tops"), shards, fit).select(F.col("chunk").alias("up"), F.col("order").alias("goal"))
    moved = step.join(broadcast_if_small(above), "up")
    return moved.select("chunk", F.transform("order", lambda s: F.col("goal")[s]).alias("order"))


def assign(groups: DataFrame, shards: int = SHARDS, chunk_groups: int = CHUNK_GROUPS, fit: int = DRIVER_PARTITIONS) -> DataFrame:
    """groups (key, size), keys distinct and not null -> (key, shard)."""
    groups = stored(groups.select("key", "size"), "shard-groups")
    chunks = max(1, -(-groups.count() // chunk_groups))
    parted = groups.withColumn("chunk", F.pmod(F.xxhash64("key"), F.lit(chunks)))
    kind = groups.schema["key"].dataType.simpleString()
    own = parted.groupBy("chunk").applyInPandas(_chunk(shards), f"chunk bigint, key {kind}, size bigint, subset int")
    own = stored(own, "shard-subsets")
    sums = own.groupBy("chunk", "subset").agg(F.sum("size").alias("s"))
    per_chunk = sums.groupBy("chunk").agg(F.map_from_entries(F.collect_list(F.struct("subset", "s"))).alias("m"))  # at most `shards` each
    every = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.coalesce(F.element_at("m", s), F.lit(0).cast("bigint")))
    goal = _whole(stored(per_chunk.select("chunk", every.alias("sums")), "shard-partials"), shards, fit)
    return own.join(broadcast_if_small(goal), "chunk").select("key", F.col("order")[F.col("subset")].alias("shard"))


# --- places within shards ---------------------------------------------------------------------

def _count_in_partition(column: str):
    def run(batches):
        import numpy as np

        part, seen = TaskContext.get().partitionId(), {}
        for batch in batches:
            values = batch.column(column).to_numpy()
            number = np.empty(len(values), dtype=np.int64)
            for v in np.unique(values):
                own = np.flatnonzero(values == v)
                number[own] = np.arange(len(own)) + seen.get(v, 0)
                seen[v] = seen.get(v, 0) + len(own)
            columns = [*batch.columns, pa.array(np.full(len(values), part, dtype=np.int32)), pa.array(number)]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "_part", "_number"])

    return run


def with_slots(rows: DataFrame, column: str = "shard", out: str = "slot") -> DataFrame:
    """rows with a number per value of `column`, gapless from 0: the number in the partition plus the rows of earlier partitions.

    Rows are stored once with their partition, so nothing is sorted and no value's rows are gathered. Few distinct values are meant.
    """
    from pyspark.sql import types as T

    schema = T.StructType([*rows.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField("_number", T.LongType())])
    placed = stored(rows.mapInArrow(_count_in_partition(column), schema), "placed")
    counts = placed.groupBy("_part", column).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(column).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stored(counts.select("_part", column, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")), "slot-offsets")
    joined = placed.join(broadcast_if_small(offsets), ["_part", column])
    return joined.select(*rows.columns, (F.col("_number") + F.col("_before")).alias(out))


def crc32(column: Column) -> Column:
    return F.crc32(column.cast("binary"))


def shard(documents: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", chunk_groups: int = CHUNK_GROUPS, fit: int = DRIVER_PARTITIONS) -> DataFrame:
    """A row per document: id, size (bytes of the text and 1), text_crc32, shard and slot. The law is bytes: documents of equal text stay together.

    A null text counts as empty. Repeated rows are placed each; a null id is carried along. A group larger than a shard's share stays whole,
    so its shard is larger. Other columns are not looked at. No documents, no rows.
    """
    text = text_or_empty(text_col)
    rows = documents.select(
        F.col(id_col).alias("_id"), (F.octet_length(text) + 1).cast("bigint").alias("size"), crc32(text).alias("text_crc32"), F.sha2(text, 256).alias("key")
    )
    rows = stored(rows, "sizes")
    goal = assign(rows.groupBy("key").agg(F.sum("size").alias("size")), shards, chunk_groups, fit)
    placed = with_slots(rows.join(goal, "key").select("_id", "size", "text_crc32", "shard"))
    return placed.select(F.col("_id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot")
