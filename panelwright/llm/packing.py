"""Best-fit packing of documents into training sequences by minimum bin slack.

1. Tasks tokenize whole texts, end each document with an id, and cut those longer than a sequence into pieces.
2. Only the number of pieces of each length goes to the driver: at most `capacity` numbers, whatever the data.
3. Per bin, the longest length left is placed, and a subset-sum over a bitset of the lengths left finds the fullest feasible
   rest. The combination is removed as often as the counts allow, so the plan is as short as the list of lengths, not of documents.
4. A piece takes its place from its number among the pieces of its length: its number in its partition plus an offset.
"""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwright.functions.sizing import broadcast_if_small
from panelwright.llm.common import stored, text_or_empty
from panelwright.llm.tokens import default_tokenizer, encoder

CAPACITY = 1024
END_ID = 2


# --- the plan ---------------------------------------------------------------------------------

def fullest(lengths: list[int], counts: dict[int, int], room: int) -> dict[int, int]:
    """The combination of available lengths that fills `room` best: length -> times. Lengths are in descending order.

    Layer i is the bitset of the sums that the first i lengths reach; a sum is traced back to the earliest layer that has it,
    so longer lengths are preferred.
    """
    layers, used = [1], []
    mask = (1 << (room + 1)) - 1
    for length in lengths:
        if length > room:
            continue
        reach, left, step = layers[-1], min(counts[length], room // length), 1
        while left:
            take = min(step, left)
            reach |= (reach << (length * take)) & mask
            left -= take
            step *= 2
        layers.append(reach)
        used.append(length)
        if reach >> room & 1:
            break
    target = layers[-1].bit_length() - 1
    chosen: dict[int, int] = {}
    for i in range(len(used) - 1, -1, -1):
        while not layers[i] >> target & 1:
            chosen[used[i]] = chosen.get(used[i], 0) + 1
            target -= used[i]
    return chosen


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(combination, times) until nothing is left; every combination holds the longest length left."""
    left = {k: v for k, v in counts.items() if v}
    plan = []
    while left:
        lengths = sorted(left, reverse=True)
        first = lengths[0]
        left[first] -= 1
        bins = fullest([x for x in lengths if left[x]], left, capacity - first)
        left[first] += 1
        bins[first] = bins.get(first, 0) + 1
        times = min(left[x] // n for x, n in bins.items())
        for x, n in bins.items():
            left[x] -= n * times
            if not left[x]:
                del left[x]
        plan.append((bins, times))
    return plan


def places(plan: list[tuple[dict[int, int], int]]):
    """Plan rows (length, first number, times, first sequence, offset), sorted by length and first number."""
    import numpy as np

    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for bins, times in plan:
        offset = 0
        for length in sorted(bins, reverse=True):
            rows.append((length, taken.get(length, 0), times, sequence, offset))
            taken[length] = taken.get(length, 0) + bins[length] * times
            offset += length * bins[length]
        sequence += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


# --- the tasks --------------------------------------------------------------------------------

def _encoded(encode, texts):
    """Packed ids of a batch's texts, some at a time."""
    for at in range(0, len(texts), 256):
        yield from encode(texts.slice(at, 256).to_pylist())


def _cut(path: str, end_id: int, capacity: int, with_ids: bool, schema: pa.Schema):
    def run(batches):
        import numpy as np

        encode = encoder(path).packed
        end = np.array([end_id], dtype="<u4").tobytes()
        part, width = TaskContext.get().partitionId(), capacity * 4
        seen = [0] * (capacity + 1)
        for batch in batches:
            ids_of, texts = batch.column(0), batch.column(1)
            which, rows, packed = [], [], []
            for i, ids in enumerate(_encoded(encode, texts)):
                ids += end
                start = 0
                stop = len(ids) % width or width
                piece = 0
                while start < len(ids):
                    own = ids[start:stop]
                    length = len(own) // 4
                    which.append(i)
                    rows.append((piece, start // 4, length, zlib.crc32(own), part, seen[length]))
                    seen[length] += 1
                    if with_ids:
                        packed.append(own)
                    start, stop, piece = stop, stop + width, piece + 1
                if len(rows) >= 20_000 or i == len(texts) - 1:
                    columns = [ids_of.take(pa.array(which)), *map(pa.array, zip(*rows))]
                    if with_ids:
                        flat = np.frombuffer(b"".join(packed), dtype="<u4").astype(np.int32)
                        offsets = np.cumsum([0, *(len(x) // 4 for x in packed)], dtype=np.int32)
                        columns.append(pa.ListArray.from_arrays(offsets, flat))
                    yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)
                    which, rows, packed = [], [], []

    return run


def pieces_of(documents: DataFrame, tokenizer: str, end_id: int, capacity: int, id_col: str, text_col: str, with_ids: bool) -> DataFrame:
    """Stored pieces with their partition and their number among the partition's pieces of the same length."""
    chosen = documents.select(F.col(id_col), text_or_empty(text_col).alias("_text"))
    fields = [
        T.StructField(id_col, chosen.schema[0].dataType),
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
        T.StructField("_part", T.IntegerType()),
        T.StructField("_number", T.LongType()),
    ]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType(fields)
    return stored(chosen.mapInArrow(_cut(tokenizer, end_id, capacity, with_ids, to_arrow_schema(schema)), schema), "pieces")


def _place(table):
    def run(batches):
        import numpy as np

        t = table.value
        high = np.int64(1) << 44
        keys = t[:, 0] * high + t[:, 1]
        for batch in batches:
            length = batch.column("length").to_numpy()
            number = batch.column("_number").to_numpy()
            row = t[np.searchsorted(keys, length * high + number, side="right") - 1]
            nth = number - row[:, 1]
            times = row[:, 2]
            keep = [n for n in batch.schema.names if n not in ("_number", "ids")]
            columns = [batch.column(n) for n in keep]
            columns += [pa.array(row[:, 3] + nth % times), pa.array(row[:, 4] + nth // times * length)]
            names = [*keep, "sequence_id", "offset"]
            if "ids" in batch.schema.names:
                columns.append(batch.column("ids"))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def pack(
    documents: DataFrame,
    tokenizer: str | None = None,
    end_id: int = END_ID,
    capacity: int = CAPACITY,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """A row per piece: id, piece, start, length, ids_crc32, sequence_id, offset, and `ids` if asked for.

    A null or empty text is the end id alone. A repeated row is packed as often as it occurs; a null document id is carried along.
    Other columns are not looked at. No documents, no pieces.
    """
    spark = documents.sparkSession
    pieces = pieces_of(documents, tokenizer or default_tokenizer(), end_id, capacity, id_col, text_col, with_ids)
    counted = stored(pieces.groupBy("_part", "length").agg(F.count(F.lit(1)).alias("_n")), "piece-counts")
    by_length = counted.groupBy("length").agg(F.sum("_n").alias("n")).collect()  # at most `capacity` rows
    table = spark.sparkContext.broadcast(places(plan_bins({r["length"]: r["n"] for r in by_length}, capacity)))
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.select("_part", "length", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    numbered = pieces.join(broadcast_if_small(offsets), ["_part", "length"])
    columns = [id_col, "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    numbered = numbered.select(*columns, (F.col("_number") + F.col("_before")).alias("_number"))
    fields = [numbered.schema[c] for c in columns if c != "ids"]
    fields += [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    fields += [f for f in numbered.schema if f.name == "ids"]
    return numbered.mapInArrow(_place(table), T.StructType(fields))
