"""Benchmark decontamination with one Aho-Corasick automaton over normalised test items.

Texts are normalised to words of a-z, 0-9 and non-ASCII characters, joined by one space, as bytes; windows of ten item words, with a space on either
side, are the automaton's patterns. One scan over a normalised text finds all occurrences of all windows. Normalisation maps byte to byte before it
drops separators, so a hit's words lead back to byte offsets of the original text.

Items are broadcast. Their size is checked: beyond BLOCK_BYTES of windows they are cut into blocks with one automaton and one pass over the stored
hits so far each, so that any number of items works, and an item of any length: its windows may lie in several blocks.
"""

from __future__ import annotations

import bisect
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwright.llm.common import stored, text_or_empty

WINDOW = 10
#: A byte of a window is a node of the automaton, some 50 bytes of memory, where windows share no beginning.
BLOCK_BYTES = 4_000_000

#: Byte to byte: A-Z to a-z; digits, a-z and all bytes from 0x80 stay; the rest become spaces.
TABLE = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)
WORD = re.compile(rb"[^ ]+")


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(TABLE).split()


def windows_of(words: list[bytes], size: int) -> set[bytes]:
    """Windows as automaton patterns; an item shorter than a window is one window, an item without words none."""
    if not words:
        return set()
    if len(words) <= size:
        return {b" " + b" ".join(words) + b" "}
    return {b" " + b" ".join(words[i : i + size]) + b" " for i in range(len(words) - size + 1)}


def item_pieces(words: list[bytes], size: int, most: int):
    """(bytes of its windows, words) of an item, in pieces whose windows have about ``most`` bytes; together they have the item's windows."""
    first = 0
    while first < len(words):
        weight, windows = 0, 0
        while windows == 0 or (weight < most and first + windows + size <= len(words)):
            weight += sum(map(len, words[first + windows : first + windows + size])) + size + 1
            windows += 1
        yield weight, words[first : first + windows + size - 1]
        first += windows
        if first + size > len(words):
            return


def item_blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int, block_bytes: int):
    """Blocks of (item, normalised words) whose windows have about block_bytes each, read partition by partition. An item without an id has None."""
    rows = benchmark.select(F.col(item_col).cast("string").alias("i"), text_or_empty(text_col).alias("t"))
    block, used = [], 0
    for row in rows.toLocalIterator(prefetchPartitions=True):
        for weight, words in item_pieces(words_of(row["t"]), window, block_bytes):
            if used and used + weight > block_bytes:
                yield block
                block, used = [], 0
            block.append((row["i"], b" ".join(words)))
            used += weight
    yield block


_AUTOMATA: dict = {}


def _automaton(key: str, block, size: int):
    """The automaton of a block, with each pattern's length and items; built once per Python worker and block."""
    if key not in _AUTOMATA:
        import ahocorasick

        owners: dict[bytes, list[str]] = {}
        for item, words in block.value:
            for window in windows_of(words.split(), size):
                named = owners.setdefault(window, [])
                if item is not None:
                    named.append(item)
        machine = ahocorasick.Automaton()
        for pattern, items in owners.items():
            machine.add_word(pattern.decode("latin-1"), (pattern.count(b" ") - 1, items))
        if owners:
            machine.make_automaton()
        _AUTOMATA.clear()
        _AUTOMATA[key] = machine if owners else None
    return _AUTOMATA[key]


def scan_text(text: str, machine) -> tuple[int, list[tuple[int, int]], set[str], list[tuple[int, int]]]:
    """(number of words, merged hit word ranges, items found, their byte ranges in the original)."""
    flat = text.encode("utf-8", "surrogatepass").translate(TABLE)
    words = flat.split()
    if machine is None or not words:
        return len(words), [], set(), []
    ends, items = [], set()
    for end, (length, found) in machine.iter((b" " + b" ".join(words) + b" ").decode("latin-1")):
        ends.append((end, length))
        items.update(found)
    if not ends:
        return len(words), [], set(), []
    starts, at = [], 1
    for w in words:
        starts.append(at)
        at += len(w) + 1
    ranges: list[tuple[int, int]] = []
    for first, last in sorted((bisect.bisect_left(starts, end) - length, bisect.bisect_left(starts, end)) for end, length in ends):
        if ranges and first <= ranges[-1][1]:
            ranges[-1] = (ranges[-1][0], max(last, ranges[-1][1]))
        else:
            ranges.append((first, last))
    places = [m.span() for m in WORD.finditer(flat)]
    return len(words), ranges, items, [(places[a][0], places[b - 1][1]) for a, b in ranges]


def _merge(ranges):
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return out


RANGES = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _scan(key: str, block, size: int, schema: pa.Schema):
    def run(batches):
        machine = _automaton(key, block, size)
        for batch in batches:
            names = batch.schema.names
            old = [batch.column(n).to_pylist() for n in ("hits", "items", "spans")] if "hits" in names else None
            counts, hits, items, spans = [], [], [], []
            for i, text in enumerate(batch.column("_text")):
                n, ranges, found, places = scan_text(text.as_py(), machine)
                if old:
                    ranges = _merge([(x["start"], x["end"]) for x in old[0][i]] + ranges)
                    found = found | set(old[1][i])
                    places = _merge([(x["start"], x["end"]) for x in old[2][i]] + places)
                counts.append(n)
                hits.append([{"start": a, "end": b} for a, b in ranges])
                items.append(sorted(found))
                spans.append([{"start": a, "end": b} for a, b in places])
            made = {"n_words": pa.array(counts, pa.int64()), "hits": pa.array(hits, RANGES), "items": pa.array(items, pa.list_(pa.string())), "spans": pa.array(spans, RANGES)}
            columns = [made[n] if n in made else batch.column(n) for n in schema.names]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def _scanned(df: DataFrame, benchmark: DataFrame, item_col: str, item_text_col: str, window: int, block_bytes: int) -> DataFrame:
    """df with `_text` replaced by n_words, hits, items and spans; its other columns are carried along and must not have these names."""
    from pyspark.sql.pandas.types import to_arrow_schema

    ranges = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    made = [T.StructField("n_words", T.LongType()), T.StructField("hits", ranges), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("spans", ranges)]
    kept = [f for f in df.schema if f.name != "_text"]
    blocks = item_blocks(benchmark, item_col, item_text_col, window, block_bytes)
    block = next(blocks)
    while block is not None:
        following = next(blocks, None)
        last = following is None
        schema = T.StructType([*kept, *([] if last else [df.schema["_text"]]), *made])
        sent = df.sparkSession.sparkContext.broadcast(block)
        df = df.mapInArrow(_scan(uuid.uuid4().hex, sent, window, to_arrow_schema(schema)), schema)
        if not last:
            df = stored(df, "benchmark-hits")
        block = following
    return df


def find_benchmark(
    documents: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """A row per document: id, n_words, hits (word ranges), items found, spans (byte ranges of the hits in the original).

    A null text has no words; items that are null, empty or without words match nothing; the windows of an item whose id is null hit, and name no item;
    items with the same window are all found. Repeated rows and null document ids are scanned like any other row. Columns other than those named are not looked at.
    """
    df = documents.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text"))
    return _scanned(df, benchmark, item_col, item_text_col, window, block_bytes).withColumnRenamed("_id", id_col)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return found.select(
        id_col,
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def drop_contaminated(
    documents: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The documents without any hit, with all their columns, in one pass and without a shuffle.

    Null and empty texts have no hit; repeated rows are judged each; items without an id count like others. No items, no hits.
    """
    names = documents.columns
    df = documents.select(*[F.col(c).alias(f"_carry_{i}") for i, c in enumerate(names)], text_or_empty(text_col).alias("_text"))
    found = _scanned(df, benchmark, item_col, item_text_col, window, block_bytes)
    return found.where(F.size("hits") == 0).select(*[F.col(f"_carry_{i}").alias(c) for i, c in enumerate(names)])


#: The same in DuckDB, by joining windows.
SQL = f"""
with low as (select row_number() over () r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') t from documents),
doc as (select r, doc_id, regexp_extract_all(t, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') w from low),
item as (select item_id::varchar i, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') w from benchmark),
pattern as (
  select distinct i, n, array_to_string(w[p:p + n - 1], ' ') s
  from (select i, w, least(len(w), {WINDOW}) n, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) p from item where len(w) > 0)),
size as (select distinct n from pattern),
win as (select r, n, p, array_to_string(w[p:p + n - 1], ' ') s from (select r, w, n, unnest(range(1, len(w) - n + 2)) p from doc, size where len(w) >= n)),
hit as (select r, win.n, p, i from win join pattern on win.n = pattern.n and win.s = pattern.s),
word as (select r, count(distinct q) c from (select r, unnest(range(p, p + n)) q from hit) group by r),
found as (select r, count(*) c, string_agg(i, ',' order by i) l from (select distinct r, i from hit where i is not null) group by r)
select doc_id, len(w)::bigint n_words, coalesce(word.c, 0)::bigint n_hit, coalesce(found.c, 0)::bigint n_items,
  sha256(coalesce(l, '')) items_sha256, word.c is not null contaminated
from doc left join word using (r) left join found using (r)
"""

