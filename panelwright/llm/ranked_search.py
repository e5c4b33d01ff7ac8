"""Ranked lexical search by pipelined term partitioning.

Documents are indexed in blocks (BLOCK_DOCS documents or BLOCK_BYTES of text): a posting list per block and term. Terms are dealt to owners by how common
they are, the rarest first, and the postings are stored by owner. The items (queries) travel as bundles: per item and block a sparse accumulator,
document slots and integer scores. At every owner's stage the bundles of a block meet that owner's postings of the block in a cogroup, the
contributions are added, and what the next stage needs goes on. After the last stage the best of all blocks are selected.

Two numbers keep bundles small without losing a row: an item's floor, the k-th best score so far over all documents, which its k-th best final
score cannot fall below; and its rest, the most that later owners can add, from the largest contribution that any document gets from each term. An
accumulator below floor - rest cannot be among the k best, so it is dropped (a tie stays). A document that comes back at a
later owner counts too little then, and was too low already.

A cogroup holds one block and one group of items: BLOCK_DOCS * about GROUP_ITEMS sums, whatever the tables' sizes or how common a term is.
"""

from __future__ import annotations

import uuid
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from panelwright.functions.sizing import broadcast_if_small
from panelwright.llm.common import stored, text_or_empty
from panelwright.llm.decontaminate import TABLE
from panelwright.session import shared_dir

TOP = 20
BLOCK_DOCS = 4_096
BLOCK_BYTES = 16_000_000
GROUP_ITEMS = 256
SLICE_BYTES = 1_000_000
#: Owners by the share of documents that hold a term, the rarest terms first.
OWNER_SHARES = (1 / 64, 1 / 16, 1 / 4)
#: Terms of all items are sent to the indexing tasks up to this size; beyond it every term is indexed and the join drops the others.
VOCABULARY_BYTES = 16_000_000
ASKED_ROWS = 500_000


def terms_of(raw: bytes):
    """Lists of the terms of a UTF-8 text, a slice of it at a time, so that a very long text is never held as words."""
    if len(raw) <= SLICE_BYTES:
        yield raw.translate(TABLE).split()
        return
    at = 0
    clean = raw.translate(TABLE)
    while at < len(clean):
        end = clean.find(b" ", at + SLICE_BYTES)
        end = len(clean) if end < 0 else end
        yield clean[at:end].split()
        at = end


# --- index ------------------------------------------------------------------------------------

def _lists(values: np.ndarray, offsets: np.ndarray, kind=pa.int32()) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def _index(vocabulary, id_type: pa.DataType):
    """Blocks of documents -> rows per (block, term) with slots, times in the document and the document's length; and one row without a term per block."""

    def block_rows(block: int, docs: list[tuple]):
        known = vocabulary.value if vocabulary is not None else {}
        docs.sort(key=lambda d: (d[0] is None, d[0] if d[0] is not None else 0))
        found, lens = [], []
        for _, raw in docs:
            n, own = 0, []
            for words in terms_of(raw):
                n += len(words)
                if vocabulary is None:
                    own.append(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words)))
                else:
                    ids = np.fromiter(map(known.get, words, repeat(-1)), np.int64, len(words))
                    own.append(ids[ids >= 0])
            found.append(np.concatenate(own) if own else np.empty(0, np.int64))
            lens.append(n)
        lens = np.array(lens, np.int64)
        keys = np.concatenate(found) * len(docs) + np.repeat(np.arange(len(docs)), [len(f) for f in found])
        keys, tfs = np.unique(keys, return_counts=True)
        term, slots = keys // len(docs), keys % len(docs)
        begins = np.flatnonzero(np.diff(term, prepend=-1))
        names = list(known)
        offsets = np.append(begins, len(term))
        n_terms = len(begins)
        every = [names[t] for t in term[begins].tolist()]
        empty = np.full(n_terms + 2, 0)
        empty[-1] = len(docs)
        ids = pa.ListArray.from_arrays(pa.array(empty, pa.int32()), pa.array([d[0] for d in docs], id_type))
        with_docs = lambda v, last: _lists(np.append(v, last), np.append(offsets, len(v) + len(last)))
        none = np.empty(0, np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(n_terms + 1, block)), pa.array([*every, None], pa.binary()), with_docs(slots, none), with_docs(tfs, none), with_docs(lens[slots], lens), ids],
            names=["block", "term", "slots", "tfs", "lens", "ids"],
        )

    def run(batches):
        block, docs, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for doc, raw in zip(batch.column("id").to_pylist(), batch.column("raw")):
                raw = raw.as_py()
                if docs and (len(docs) == BLOCK_DOCS or size + len(raw) > BLOCK_BYTES):
                    yield block_rows(block, docs)
                    block, docs, size = block + 1, [], 0
                docs.append((doc, raw))
                size += len(raw)
        if docs:
            yield block_rows(block, docs)

    return run


def _item_terms(batches):
    for batch in batches:
        rows = []
        for item, raw in zip(batch.column("item").to_pylist(), batch.column("raw")):
            counts: dict[bytes, int] = {}
            for words in terms_of(raw.as_py()):
                for w in words:
                    counts[w] = counts.get(w, 0) + 1
            rows += [(item, t, n) for t, n in counts.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], k) for j, k in enumerate((pa.int64(), pa.binary(), pa.int64()))], names=["item", "term", "times"])


def _vocabulary(wanted: DataFrame):
    """The items' terms, numbered, for all indexing tasks; None if they are too many to send."""
    distinct = stored(wanted.select("term").distinct(), "item-vocabulary")
    size = distinct.agg(F.sum(F.octet_length("term") + 100)).first()[0] or 0
    if size > VOCABULARY_BYTES:
        return None
    return wanted.sparkSession.sparkContext.broadcast({bytes(r["term"]): i for i, r in enumerate(distinct.collect())})


def _contributions(documents: int, length: int):
    """Postings with the part of the score that a document's count and length give, and the largest of each list."""

    def run(batches):
        for batch in batches:
            tfs, lens = (batch.column(c).flatten().to_numpy().astype(np.int64) for c in ("tfs", "lens"))
            slots = batch.column("slots")
            m = 100 - 25 + (25 * lens * documents) // length
            parts = (1_000_000_000 * tfs) // (1000 * tfs + 12 * m)
            offsets = slots.offsets.to_numpy() - slots.offsets[0].as_py()
            most = np.maximum.reduceat(parts, offsets[:-1]) if len(parts) else np.empty(0, np.int64)
            keep = ["owner", "block", "term", "w"]
            arrays = [*[batch.column(c) for c in keep], _lists(slots.flatten().to_numpy(), offsets), _lists(parts, offsets), pa.array(most, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, "slots", "parts", "most"])

    return run


# --- stages -----------------------------------------------------------------------------------

BUNDLE = "part bigint, block bigint, item bigint, slots array<int>, scores array<bigint>, best array<bigint>"


def _stage(top: int, last: bool):
    """Adds an owner's contributions to the accumulators of one block and one group of items."""

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.combine_chunks(), right.combine_chunks()
        asked = right.column("items").combine_chunks().flatten() if right.num_rows else pa.array([], pa.int64())
        asked = np.asarray(asked, np.int64)
        held = left.column("item").to_numpy()
        items, place = np.unique(np.concatenate([held, asked]), return_inverse=True)
        floors, rests = np.zeros(len(items), np.int64), np.zeros(len(items), np.int64)
        flat = {c: np.asarray(right.column(c).combine_chunks().flatten(), np.int64) if right.num_rows else np.empty(0, np.int64) for c in ("floors", "rests", "times", "slots", "parts")}
        old = {c: np.asarray(left.column(c).combine_chunks().flatten(), np.int64) if left.num_rows else np.empty(0, np.int64) for c in ("slots", "scores")}
        floors[place] = np.concatenate([left.column("floor").to_numpy(), flat["floors"]])
        rests[place] = np.concatenate([left.column("rest").to_numpy(), flat["rests"]])
        width = 1 + max(flat["slots"].max(initial=-1), old["slots"].max(initial=-1))
        sums = np.zeros((len(items), width), np.int64)
        if left.num_rows:
            sizes = np.diff(left.column("slots").combine_chunks().offsets.to_numpy())
            sums[np.repeat(place[: len(held)], sizes), old["slots"]] = old["scores"]
        if right.num_rows:
            w = right.column("w").to_numpy()
            a, p = (c.offsets.to_numpy() - c.offsets[0].as_py() for c in (right.column(n).combine_chunks() for n in ("items", "slots")))
            rows = place[len(held) :]
            for k in range(right.num_rows):
                own, docs = rows[a[k] : a[k + 1], None], flat["slots"][None, p[k] : p[k + 1]]
                sums[own, docs] += flat["times"][a[k] : a[k + 1], None] * (w[k] * flat["parts"][None, p[k] : p[k + 1]])
        keep = (sums > 0) & (sums + rests[:, None] >= floors[:, None])
        best = []
        for x in range(len(items)):
            scores = sums[x][keep[x]]
            if len(scores) > top:
                least = np.partition(scores, len(scores) - top)[len(scores) - top]
                keep[x] &= sums[x] + rests[x] >= least
                scores = scores[scores >= least]
                if last:  # slots are in the order of ids: of equal scores the first ones stay
                    tied = np.flatnonzero(keep[x] & (sums[x] == least))
                    keep[x][tied[top - int((scores > least).sum()) :]] = False
                scores = np.sort(scores)[::-1][:top]
            best.append(scores)
        counts = keep.sum(axis=1)
        alive = np.flatnonzero(counts)
        at, slots = np.nonzero(keep)
        ends = np.append(0, np.cumsum(counts[alive]))
        best = [best[x] for x in alive]
        lists = [
            _lists(slots, ends),
            _lists(sums[at, slots], ends, pa.int64()),
            _lists(np.concatenate([*best, np.empty(0, np.int64)]), np.append(0, np.cumsum([len(x) for x in best])), pa.int64()),
        ]
        ids = [pa.array(np.full(len(alive), k.as_py()), pa.int64()) for k in key]
        return pa.Table.from_arrays([*ids, pa.array(items[alive], pa.int64()), *lists], names=["part", "block", "item", "slots", "scores", "best"])

    return run


def _floors(bundles: DataFrame, top: int) -> DataFrame:
    """(item, floor): the top-th best score so far, of items with that many documents. Each task sends the best of its own rows only."""
    scores = bundles.select("item", F.explode("best").alias("score"))
    best = scores.withColumn("nth", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score")))).where(F.col("nth") <= top)
    return best.groupBy("item").agg(F.max("nth").alias("nth"), F.min("score").alias("floor")).where(F.col("nth") == top).select("item", "floor")


def rank_documents(
    documents: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    top: int = TOP,
    owner_shares: tuple[float, ...] = OWNER_SHARES,
) -> DataFrame:
    """The `top` best documents of each item: item id, rank from 1, document id, score; fewer if fewer have a score above 0.

    Every row of either table stands for itself: repeated items are answered each, repeated documents rank each, a null id is an id (after
    all others among equal scores). Null and empty texts have no terms: such items get no row, such documents are never found and do not count. Other columns are not looked at.
    """
    spark = documents.sparkSession
    asked = items.select(F.col(item_col).alias("name"), text_or_empty(item_text_col).cast("binary").alias("raw"))
    asked = stored(asked.withColumn("item", F.monotonically_increasing_id()), "items")
    groups = max(1, -(-asked.count() // GROUP_ITEMS))
    wanted = stored(asked.select("item", "raw").mapInArrow(_item_terms, "item bigint, term binary, times bigint"), "item-terms")
    texts = documents.select(F.col(id_col).alias("id"), text_or_empty(text_col).cast("binary").alias("raw"))
    id_type = documents.schema[id_col].dataType
    kind = id_type.simpleString()
    index_schema = f"block bigint, term binary, slots array<int>, tfs array<int>, lens array<int>, ids array<{kind}>"
    index = stored(texts.mapInArrow(_index(_vocabulary(wanted), to_arrow_type(id_type)), index_schema), "index")
    empty = spark.createDataFrame([], f"{item_col} {asked.schema['name'].dataType.simpleString()}, rank int, {id_col} {kind}, score bigint")

    every = index.where("term is null")
    n_docs, length = every.agg(
        F.sum(F.size(F.filter("lens", lambda x: x > 0))), F.sum(F.aggregate("lens", F.lit(0).cast("bigint"), lambda a, x: a + x))
    ).first()
    if not n_docs:
        return empty
    df = index.where("term is not null").groupBy("term").agg(F.sum(F.size("slots")).alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2.0 * F.col("df") + 1))).cast("bigint")
    owner = sum((F.when(F.col("df") > s * n_docs, 1).otherwise(0) for s in owner_shares), F.lit(0))
    weighed = df.join(wanted.select("term").distinct(), "term").select("term", weight.alias("w"), owner.alias("owner")).where("w > 0")
    weighed = broadcast_if_small(stored(weighed, "terms"))

    # The postings, by owner.
    path = f"{shared_dir(spark)}/postings-{uuid.uuid4().hex}"
    schema = "owner int, block bigint, term binary, w bigint, slots array<int>, parts array<int>, most bigint"
    lists = index.where("term is not null").join(weighed, "term").select("owner", "block", "term", "w", "slots", "tfs", "lens")
    lists = lists.mapInArrow(_contributions(n_docs, length), schema)
    lists.write.partitionBy("owner").parquet(path)
    postings = spark.read.schema(schema).parquet(path)

    most = postings.groupBy("term").agg(F.max("w").alias("w"), F.max("most").alias("most"), F.max("owner").alias("owner"))
    needs = wanted.join(most, "term").withColumn("part", F.pmod(F.xxhash64("item"), F.lit(groups)))
    needs = stored(needs, "needs")
    stages = len(owner_shares) + 1
    gain = F.col("times") * F.col("w") * F.col("most")
    rests = needs.groupBy("item").agg(*[F.sum(F.when(F.col("owner") > s, gain).otherwise(0)).alias(f"rest{s}") for s in range(stages)])
    rests = stored(rests, "rests")
    pairs = needs.groupBy("owner").count().collect()
    small = max([r["count"] for r in pairs], default=0) <= ASKED_ROWS

    bundles = spark.createDataFrame([], BUNDLE)
    bounds = rests.withColumn("floor", F.lit(0).cast("bigint"))
    for s in range(stages):
        bound = bounds.select("item", "floor", F.col(f"rest{s}").alias("rest"))
        one = F.collect_list(F.struct("item", "times", "floor", "rest"))
        by_term = needs.where(F.col("owner") == s).join(bound, "item").groupBy("term", "part").agg(one.alias("asked"))
        by_term = by_term.select("term", "part", *[F.col(f"asked.{c}").alias(f"{c}s") for c in ("item", "times", "floor", "rest")]).withColumnRenamed("timess", "times")
        right = postings.where(F.col("owner") == s).join(F.broadcast(by_term) if small else by_term, "term")
        right = right.select("part", "block", "w", "slots", "parts", "items", "times", "floors", "rests")
        left = bundles.join(bound, "item").select("part", "block", "item", "slots", "scores", "floor", "rest")
        met = left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInArrow(_stage(top, s == stages - 1), BUNDLE)
        bundles = stored(met, f"bundles-{s}")
        bounds = rests.join(_floors(bundles, top), "item", "left").withColumn("floor", F.coalesce("floor", F.lit(0).cast("bigint")))
        bounds = broadcast_if_small(stored(bounds, "bounds"))

    found = bundles.join(bounds.select("item", "floor"), "item")
    found = found.select("item", "block", "floor", F.explode(F.arrays_zip("slots", "scores")).alias("x")).where("x.scores >= floor")
    ids = every.select("block", F.posexplode("ids").alias("slot", "id"))
    ranked = found.select("item", "block", F.col("x.slots").alias("slot"), F.col("x.scores").alias("score")).join(ids, ["block", "slot"])
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"), "block", "slot")
    ranked = ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(asked.select("item", "name"), "item").select(F.col("name").alias(item_col), "rank", F.col("id").alias(id_col), "score")


SQL = r"""
with terms as (
  select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from documents),
item_terms as (
  select item_id, term, count(*) as times from (
    select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark) group by all),
counts as (select doc_id, term, count(*) as tf from terms group by all),
lens as (select doc_id, count(*) as n from terms group by all),
size as (select count(*) as docs, sum(n)::bigint as len from lens),
weights as (
  select term, floor(1000 * ln((2 * docs + 2)::double / (2 * count(*) + 1)))::bigint as w from counts, size
  where term in (select term from item_terms) group by term, docs),
parts as (
  select c.doc_id, c.term, w.w * ((1000000000 * c.tf) // (1000 * c.tf + 12 * (75 + (25 * l.n * s.docs) // s.len))) as part
  from counts c join weights w on w.term = c.term join lens l on l.doc_id = c.doc_id cross join size s),
scores as (
  select i.item_id, p.doc_id, sum(i.times * p.part)::bigint as score from item_terms i join parts p on p.term = i.term group by all),
ranked as (
  select item_id, row_number() over (partition by item_id order by score desc, doc_id) as r, doc_id, score from scores where score > 0)
select item_id, r::int as rank, doc_id, score from ranked where r <= 20
"""
