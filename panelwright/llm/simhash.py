"""SimHash near-duplicates by a segment-popcount embedding.

A fingerprint of 64 bits is mapped to the number of ones in each of its 32 segments of two bits: a point of a grid. Flipping one bit moves the point by one
step, so the Manhattan distance of two points is a lower bound of the Hamming distance of the fingerprints. Two points within Manhattan distance two
share a grid vertex that is at most one step from both; the range join is therefore an equality join on vertices, 49 per fingerprint on
average, and leaves out all fingerprints without a neighbour; the exact check is one on fingerprints: two of them differ in at most two bits if and only if some fingerprint, the midpoint, differs from
each in at most one. Members of a midpoint are tied to the smallest one, so no pairs are made: a midpoint has at
most 65 distinct members, whatever the data.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import stored, text_or_empty
from panelwright.llm.graph import components

SHINGLE = 3
SEED = 42
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
GROUP_HASHES = 100_000

EACH_SECOND = 0x5555555555555555


# --- fingerprints -----------------------------------------------------------------------------

def shingle_hashes(text: str, size: int = SHINGLE) -> list[int]:
    """XXH64 of each shingle, repeats included; bytes.split() parts words at the six ASCII white-space characters."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
    if len(words) <= size:
        return [xxh64_intdigest(b" ".join(words), SEED)] if words else []
    return [xxh64_intdigest(s, SEED) for s in map(b" ".join, zip(*(words[i:] for i in range(size))))]


def fingerprints(hashes: list[int], sizes: list[int]):
    """The fingerprint of each run of hashes, as signed 64-bit numbers; a run of none gives 0."""
    import numpy as np

    counts = np.array(sizes, dtype=np.int64)
    out = np.zeros(len(sizes), dtype=np.int64)
    full = np.flatnonzero(counts)
    if len(full):
        bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        starts = (np.cumsum(counts) - counts)[full]
        ones = np.add.reduceat(bits, starts, axis=0, dtype=np.uint32)
        majority = (2 * ones.astype(np.int64) > counts[full, None]).astype(np.uint8)
        out[full] = np.packbits(majority, axis=1, bitorder="little").view("<i8")[:, 0]
    return out


def _fingerprint(size: int):
    def run(batches):
        for batch in batches:
            found, hashes, sizes = [], [], []
            for text in batch.column(1):
                own = shingle_hashes(text.as_py(), size)
                hashes += own
                sizes.append(len(own))
                if len(hashes) > GROUP_HASHES:
                    found.append(fingerprints(hashes, sizes))
                    hashes, sizes = [], []
            found.append(fingerprints(hashes, sizes))
            columns = [batch.column(0), pa.concat_arrays([pa.array(x, pa.int64()) for x in found])]
            yield pa.RecordBatch.from_arrays(columns, names=[batch.schema.names[0], "fp"])

    return run


def fingerprinted(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """(id, fp): a row per document."""
    chosen = documents.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text"))
    kind = chosen.schema["_id"].dataType.simpleString()
    return chosen.mapInArrow(_fingerprint(size), f"_id {kind}, fp bigint")


# --- links ------------------------------------------------------------------------------------

def embedding(fp: Column) -> Column:
    """32 counts of 0 to 2, two bits each, packed in one number; by logic alone, as sums could overflow."""
    low, high = fp.bitwiseAND(F.lit(EACH_SECOND)), F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(EACH_SECOND))
    return low.bitwiseXOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def _signed(n: int) -> int:
    return n - (1 << 64) if n >> 63 else n


def vertices(point: Column) -> Column:
    """The point and the grid vertices one step from it: 0 and 1 differ by the pattern 01, 1 and 2 by 11."""
    out = [point]
    for k in range(0, 64, 2):
        count = F.shiftrightunsigned(point, k).bitwiseAND(F.lit(3))
        out.append(F.when(count < 2, point.bitwiseXOR(F.lit(_signed(1 << k)))))
        out.append(F.when(count > 0, point.bitwiseXOR(F.lit(_signed(3 << k)))))
    return F.array_compact(F.array(*out))


def midpoints(fp: Column) -> Column:
    return F.array(fp, *[fp.bitwiseXOR(F.lit(_signed(1 << i))) for i in range(64)])


def links(prints: DataFrame) -> DataFrame:
    """prints (fp), distinct -> edges (a, b) whose components are those of all pairs within two bits."""
    points = prints.select("fp", F.explode(vertices(embedding(F.col("fp")))).alias("vertex"))
    shared = points.groupBy("vertex").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("vertex")
    near = points.join(shared, "vertex", "left_semi").select("fp").distinct()
    around = near.select("fp", F.explode(midpoints(F.col("fp"))).alias("middle"))
    members = around.groupBy("middle").agg(F.collect_list("fp").alias("m")).where(F.size("m") > 1)  # at most 65
    star = members.select(F.array_min("m").alias("b"), F.explode("m").alias("a")).where("a <> b")
    return star.distinct()


def near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """A row per document: id, fp (number), component_id: the smallest id that links lead to, itself included.

    A null or empty text, or one of white space, has fingerprint 0 and is linked like any other; a text of fewer words than a shingle is
    one shingle. Repeated rows share a component. A null id is never a component's id unless no member has another. Other columns are not looked at.
    """
    each = stored(fingerprinted(documents, id_col, text_col, size), "fingerprints")
    first = stored(each.groupBy("fp").agg(F.min("_id").alias("first")), "distinct-fingerprints")
    linked = components(links(first.select("fp")))
    tied = first.join(linked.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    whole = tied.groupBy("root").agg(F.min("first").alias("component_id"))
    named = tied.join(whole, "root").select("fp", "component_id")
    return each.join(named, "fp").select(F.col("_id").alias(id_col), "fp", "component_id")


def hex_digits(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def keep_one(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """The documents of smallest id of each component, with all their columns. Rows without an id stay; of repeated ids one row stays."""
    found = stored(near_duplicates(documents, id_col, text_col, size), "near-duplicates")
    kept = found.where(F.col(id_col) == F.col("component_id")).select(id_col).distinct()
    out = documents.join(kept, id_col, "left_semi")
    if not found.where(F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1").isEmpty():
        out = out.dropDuplicates([id_col])
    nameless = documents.where(F.col(id_col).isNull())
    return out if nameless.isEmpty() else out.unionByName(nameless)
