"""Prefix trie of rebuilt conversations from their sorted order, with range minima over the longest common prefixes of neighbours (LCPs).

Conversations are sorted by their sequences of turns, equal ones by id, so the members of every node of the trie are an interval of that order.
Every conversation and depth is a candidate; by a sparse table of LCP minima each finds its interval alone: steps of halving length to
the right and to the left, as long as the least LCP stays at the depth or above. No stack walks over the order, so candidates need no order of work.

The order is cut into blocks by range (equal conversations too, as the id is part of the key). Within a block the table is local; beyond its edges a
second sparse table over the blocks (least LCP inside each, LCP at each edge: two numbers a block, MAX_BLOCKS blocks at most) finds the block in which
an interval begins. What a node counts are sums over its interval (see `_nodes`), so nodes that cross an edge add up the parts that
blocks give; all others are complete within one block.

Turns are compared by the first 16 bytes of SHA-256 over role and text: for 10^10 different turns two share them with a chance below 10^-18.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwright.functions.sizing import bounded_rows, broadcast_if_small
from panelwright.llm.common import stored

FAMILY = 5
MOST_SHARED = 9
SYMBOL_BYTES = 16
BLOCK_TURNS = 100_000
MAX_BLOCKS = 100_000
FAR = np.iinfo(np.int32).max


# --- rebuilding -------------------------------------------------------------------------------

def shared_turns(conv: Column) -> Column:
    """How many turns a conversation takes over from the first one of its family."""
    return (F.crc32(conv.cast("string").cast("binary")) % MOST_SHARED).cast("int")


def rebuild(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, seq (a symbol a turn) and sizes (UTF-8 bytes a text) of every conversation: the first turns of conversation conv - conv % 5, then its own later ones.

    Turns go by number, null first; those of one number by symbol. Null role or text is empty. Rows without a conversation id belong to none.
    One row holds a conversation's symbols: 24 bytes a turn.
    """
    conv = F.col(conv_col).cast("bigint")
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    symbol = F.substring(F.unhex(F.sha2(whole.cast("binary"), 256)), 1, SYMBOL_BYTES)
    turn = F.struct(F.col(turn_col).alias("turn"), symbol.alias("symbol"), F.octet_length(text).cast("bigint").alias("bytes"))
    turns = conversations.select(conv.alias("conv"), (conv - conv % FAMILY).alias("family"), turn.alias("turn")).where("conv is not null")
    own = turns.repartition("family").groupBy("family", "conv").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    # A family has five conversations at most, and both steps below keep its partitioning.
    first = F.first(F.when(F.col("conv") == F.col("family"), F.slice("turns", 1, MOST_SHARED - 1)), ignorenulls=True)
    taken = shared_turns(F.col("conv"))
    named = own.withColumn("first", first.over(Window.partitionBy("family"))).withColumn("taken", taken)
    none = F.slice("turns", 1, 0)
    head = F.slice(F.coalesce("first", none), F.lit(1), F.col("taken"))
    rest = F.slice("turns", F.col("taken") + 1, F.greatest(F.size("turns") - F.col("taken"), F.lit(0)))
    whole = named.select("conv", F.concat(head, rest).alias("all"))
    return whole.select("conv", F.col("all.symbol").alias("seq"), F.col("all.bytes").alias("sizes"))


# --- sorted blocks ----------------------------------------------------------------------------

BLOCK_SCHEMA = "block int, n bigint, inside int, first array<binary>, last array<binary>, convs binary, lens binary, lcps binary, sizes binary"


def _within(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... within each of the stated counts."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def neighbour_lcps(symbols: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """LCP of each sequence with the one before it; -1 for the first. symbols: a row a turn."""
    lcps = np.full(len(lens), -1, np.int64)
    if len(lens) > 1:
        starts = np.cumsum(lens) - lens
        both = np.minimum(lens[1:], lens[:-1])
        at = _within(both)
        pair = np.repeat(np.arange(len(both)), both)
        differ = np.flatnonzero((symbols[starts[:-1][pair] + at] != symbols[starts[1:][pair] + at]).any(axis=1))
        np.minimum.at(both, pair[differ], at[differ])
        lcps[1:] = both
    return lcps


def _list_parts(column: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
    offsets = column.offsets.to_numpy()
    return np.diff(offsets).astype(np.int64), column.values.slice(offsets[0], offsets[-1] - offsets[0])


def _blocks(batches):
    """The sorted rows of one range, as one row of packed numbers."""
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    table = pa.Table.from_batches(parts).combine_chunks()
    seq, sizes, convs = (table.column(c).chunk(0) for c in ("seq", "sizes", "conv"))
    lens, flat = _list_parts(seq)
    fixed = flat.cast(pa.binary(SYMBOL_BYTES))
    symbols = np.frombuffer(fixed.buffers()[1] or b"", np.uint64, count=2 * (len(fixed) + fixed.offset)).reshape(-1, 2)[fixed.offset :]
    lcps = neighbour_lcps(symbols, lens)
    row = {
        "block": [table.column("block")[0].as_py()],
        "n": [len(lens)],
        "inside": [int(lcps[1:].min()) if len(lens) > 1 else int(FAR)],
        "first": [seq[0].as_py()],
        "last": [seq[len(seq) - 1].as_py()],
        "convs": [convs.to_numpy().astype(np.int64).tobytes()],
        "lens": [lens.tobytes()],
        "lcps": [lcps.tobytes()],
        "sizes": [_list_parts(sizes)[1].to_numpy(zero_copy_only=False).astype(np.int64).tobytes()],
    }
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.binary()), pa.list_(pa.binary()), *[pa.binary()] * 4]
    yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row.values(), kinds)], names=list(row))


def sorted_blocks(rebuilt: DataFrame, block_turns: int, max_blocks: int) -> DataFrame:
    """Blocks of the order by (sequence, id). Their number is bounded, so beyond max_blocks * block_turns turns the blocks grow."""
    n = rebuilt.agg(F.sum(F.size("seq") + 1)).first()[0] or 0
    blocks = max(1, min(max_blocks, -(-n // block_turns)))
    ordered = rebuilt.repartitionByRange(blocks, "seq", "conv").sortWithinPartitions("seq", "conv")
    return stored(ordered.withColumn("block", F.spark_partition_id()).mapInArrow(_blocks, BLOCK_SCHEMA), "trie-blocks")


def block_edges(blocks: DataFrame, max_blocks: int) -> tuple[dict[int, int], np.ndarray, np.ndarray]:
    """Place of each block in the order, the LCP at its left edge (-1 for the first) and the least LCP inside."""
    most = max(max_blocks, 10_000)
    rows = sorted((r["block"], r["inside"]) for r in bounded_rows(blocks.select("block", "inside"), most, "blocks"))
    place = {b: k for k, (b, _) in enumerate(rows)}
    edge = np.full(len(rows), -1, np.int64)
    if len(rows) > 1:
        pairs = blocks.sparkSession.createDataFrame([(rows[k][0], rows[k - 1][0]) for k in range(1, len(rows))], "block int, before int")
        before = blocks.select(F.col("block").alias("before"), "last")
        met = pairs.join(blocks.select("block", "first"), "block").join(before, "before")
        unlike = F.array_position(F.zip_with("first", "last", lambda x, y: x != y), F.lit(True))
        shared = F.when(unlike > 0, unlike - 1).otherwise(F.least(F.size("first"), F.size("last")).cast("bigint"))
        for r in bounded_rows(met.select("block", shared.alias("shared")), most, "edges"):
            edge[place[r["block"]]] = r["shared"]
    return place, edge, np.array([inside for _, inside in rows], np.int64)


# --- intervals --------------------------------------------------------------------------------

class RangeMin:
    """Sparse table: level v holds the minima of 2^v values from each place on."""

    def __init__(self, values: np.ndarray):
        self.levels = [np.asarray(values, np.int64)]
        while 2 ** len(self.levels) <= len(values):
            low, half = self.levels[-1], 2 ** (len(self.levels) - 1)
            self.levels.append(np.minimum(low[:-half], low[half:]))

    def over(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Least value of each closed range."""
        out = np.empty(len(first), np.int64)
        level = np.frexp((last - first + 1).astype(np.float64))[1] - 1
        for v in np.unique(level):
            own = level == v
            out[own] = np.minimum(self.levels[v][first[own]], self.levels[v][last[own] - 2**v + 1])
        return out

    def reach_right(self, start: np.ndarray, floor: np.ndarray) -> np.ndarray:
        """How many values from start on are at least floor, by binary search."""
        at = start.copy()
        for v in range(len(self.levels) - 1, -1, -1):
            level = self.levels[v]
            fits = at < len(level)
            fits[fits] = level[at[fits]] >= floor[fits]
            at[fits] += 2**v
        return at - start

    def reach_left(self, end: np.ndarray, floor: np.ndarray) -> np.ndarray:
        """How many values before end are at least floor, by binary search."""
        at = end.copy()
        for v in range(len(self.levels) - 1, -1, -1):
            level = self.levels[v]
            fits = at >= 2**v
            fits[fits] = level[at[fits] - 2**v] >= floor[fits]
            at[fits] -= 2**v
        return end - at


NODE_SCHEMA = (
    "conv bigint, depth bigint, n bigint, children bigint, leaves bigint, saved bigint, home int, parent_conv bigint, parent_home int, "
    "ends_sha256 string, block int, ends string"
)


def _nodes(place: dict[int, int], edge: np.ndarray, inside: np.ndarray):
    """Nodes, or the parts of nodes, of a block. Over the interval l..r of a node of depth d, with B the LCP to the left neighbour:

    n_convs is r - l + 1; a child begins wherever B = d and the conversation goes on (and at l, if that one goes on); a leaf ends wherever the next B
    is below the own length; saved bytes are the sum, over l+1..r, of the bytes shared with the left neighbour less those of the
    first d - 1 turns, as each node is shared once for every member but one.
    """

    def block_rows(k: int, row: dict):
        convs, lens, lcps, sizes = (np.frombuffer(row[c], np.int64) for c in ("convs", "lens", "lcps", "sizes"))
        m = len(convs)
        b = np.append(lcps, edge[k + 1] if k + 1 < len(edge) else -1)
        b[0] = edge[k]
        starts = np.cumsum(lens) - lens
        summed = np.append(0, np.cumsum(sizes))
        bytes_to = lambda i, d: summed[starts[i] + d] - summed[starts[i]]
        # Candidates: every conversation i and depth d from 0 to its length.
        i = np.repeat(np.arange(m), lens + 1)
        d = _within(lens + 1)
        minima = RangeMin(b[1:m]) if m > 1 else None
        left = i - minima.reach_left(i, d) if m > 1 else i
        right = i + minima.reach_right(i, d) if m > 1 else i
        over_left, over_right = (left == 0) & (b[0] >= d), (right == m - 1) & (b[m] >= d)
        # The block where a crossing interval begins: edges and insides alternate in the table over blocks.
        home = np.where(over_left | over_right, k, -1)
        reached = np.flatnonzero(over_left)
        if len(reached):
            upper = RangeMin(np.column_stack([edge, inside]).ravel())
            steps = upper.reach_left(np.full(len(reached), 2 * k + 1), d[reached])
            home[reached] = k - (steps + 1) // 2
        # One candidate per node: the leftmost here. The parent of (i, d) is the candidate before it.
        own = np.flatnonzero(left == i)
        up = own - 1
        l, r, d, home_up, left_up, right_up = i[own], right[own], d[own], home[up], left[up], right[up]
        home = home[own]
        begins = (home < 0) | (home == k)
        since = np.where(begins, l + 1, l)
        shared = np.append(0, np.cumsum(bytes_to(np.arange(m), np.maximum(b[:m], 0))))
        saved = shared[r + 1] - shared[np.minimum(since, r + 1)] - (r + 1 - since) * bytes_to(l, np.maximum(d - 1, 0))
        going = np.flatnonzero((lens > b[:m]) & (b[:m] >= 0))
        keys = np.sort(b[going] * (m + 1) + going)
        children = np.searchsorted(keys, d * (m + 1) + r + 1) - np.searchsorted(keys, d * (m + 1) + since) + (begins & (lens[l] > d))
        leaf = np.append(0, np.cumsum(b[1:] < lens))
        leaves = leaf[r + 1] - leaf[l]
        least = RangeMin(convs)
        conv = least.over(l, r)
        root = d == 0
        up_conv = np.where(root, 0, least.over(np.where(root, l, left_up), np.where(root, r, right_up)))
        no_up_conv, no_up_home = root | (home_up >= 0), root | (home_up < 0)
        # Conversations that end at the node: those of its depth, which come first.
        breaks = np.flatnonzero(np.append(True, (b[1:m] < lens[1:]) | (lens[1:] != lens[:-1])))
        run_end = np.append(breaks[1:], m)[np.searchsorted(breaks, l, side="right") - 1]
        ends = [",".join(map(str, convs[x:y].tolist())) if z else "" for x, y, z in zip(l.tolist(), run_end.tolist(), (lens[l] == d).tolist())]
        crossing = home >= 0
        digest = [None if c else hashlib.sha256(e.encode()).hexdigest() for c, e in zip(crossing.tolist(), ends)]
        columns = [
            pa.array(conv), pa.array(d), pa.array(r - l + 1), pa.array(children), pa.array(leaves), pa.array(saved),
            pa.array(home.astype(np.int32), mask=~crossing), pa.array(up_conv, mask=no_up_conv), pa.array(home_up.astype(np.int32), mask=no_up_home),
            pa.array(digest, pa.string()), pa.array(np.full(len(own), k, np.int32)),
            pa.array([e if c and e else None for c, e in zip(crossing.tolist(), ends)], pa.string()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in NODE_SCHEMA.split(", ")])

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                yield block_rows(place[row["block"]], row)

    return run


def _digests(batches):
    """SHA-256 over the pieces of each node, which come in order; one state at a time, whatever the length."""
    now, state = None, None
    for batch in batches:
        out = []
        for home, depth, ends in zip(*(batch.column(c).to_pylist() for c in ("home", "depth", "ends"))):
            if now != (home, depth):
                if now:
                    out.append((*now, state.hexdigest()))
                now, state = (home, depth), hashlib.sha256(ends.encode())
            else:
                state.update(b"," + ends.encode())
        yield _digest_batch(out)
    if now:
        yield _digest_batch([(*now, state.hexdigest())])


def _digest_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"home": pa.int32(), "depth": pa.int64(), "ends_sha256": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], k) for j, k in enumerate(kinds.values())], names=list(kinds))


def prefix_trie(
    conversations: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    block_turns: int = BLOCK_TURNS,
    max_blocks: int = MAX_BLOCKS,
) -> DataFrame:
    """A row per node of the trie of rebuilt conversations: conv_id (smallest member), depth, parent_conv_id (of the root: null), n_convs, n_children, n_leaves,
    saved_tokens and ends_sha256.

    Null role or text is empty, a null turn comes first, rows without a conversation id are left out, repeated rows are turns like others. A table
    without conversations has no node. Other columns are not looked at. n_leaves counts childless nodes, the node itself included.
    """
    rebuilt = stored(rebuild(conversations, conv_col, turn_col, role_col, text_col), "rebuilt")
    blocks = sorted_blocks(rebuilt, block_turns, max_blocks)
    place, edge, inside = block_edges(blocks, max_blocks)
    packed = blocks.select("block", "convs", "lens", "lcps", "sizes")
    nodes = stored(packed.mapInArrow(_nodes(place, edge, inside), NODE_SCHEMA), "trie-nodes")
    sums = [F.min("conv").alias("conv"), *[F.sum(c).alias(c) for c in ("n", "children", "leaves", "saved")], F.min("parent_home").alias("parent_home")]
    parts = nodes.where("home is not null")
    crossing = parts.groupBy("home", "depth").agg(*sums)
    pieces = parts.where("ends is not null").select("home", "depth", "block", "ends").repartition("home", "depth")
    digests = pieces.sortWithinPartitions("home", "depth", "block").select("home", "depth", "ends").mapInArrow(_digests, "home int, depth bigint, ends_sha256 string")
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    crossing = stored(crossing.join(digests, ["home", "depth"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", empty)), "crossing-nodes")
    numbers = ["conv", "depth", "n", "children", "leaves", "saved", "ends_sha256"]
    every = nodes.where("home is null").select(*numbers, "parent_conv", "parent_home").unionByName(
        crossing.select(*numbers, F.lit(None).cast("bigint").alias("parent_conv"), "parent_home")
    )
    above = crossing.select(F.col("home").alias("parent_home"), (F.col("depth") + 1).alias("depth"), F.col("conv").alias("above"))
    named = every.join(broadcast_if_small(above), ["parent_home", "depth"], "left")
    return named.select(
        F.col("conv").alias("conv_id"),
        "depth",
        F.coalesce("parent_conv", "above").alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        "ends_sha256",
    )


# DuckDB has no crc32: bytes and, after each, eight steps of the register, folded in order.
SQL = """
with turns as (
  select conv_id as c, row_number() over (partition by conv_id order by turn nulls first, role, text) as p,
    strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '') as symbol, strlen(coalesce(text, '')) as bytes
  from conversations where conv_id is not null),
convs as (
  select c, c - c % 5 as base, xor(4294967295, list_reduce(
    list_concat([4294967295::bigint], flatten(list_transform(string_split(c::varchar, ''), lambda x: [ascii(x)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, x: case when x >= 0 then xor(a, x) else xor(a >> 1, 3988292384 * (a & 1)) end)) % 9 as h
  from (select distinct c from turns)),
taken as (
  select v.c, t.p, t.symbol, t.bytes from convs v join turns t on t.c = v.base and t.p <= v.h
  union all
  select v.c, 1000000 + t.p, t.symbol, t.bytes from convs v join turns t on t.c = v.c and t.p > v.h),
seqs as (select c, row_number() over (partition by c order by p) as d, sha256(symbol) as symbol, bytes from taken),
lens as (select v.c, count(s.d) as len from convs v left join seqs s on s.c = v.c group by v.c),
prefixes as (
  select c, 0 as d, '' as node, null as up, 0 as bytes from convs
  union all
  select c, d, sha256(string_agg(symbol, '') over (partition by c order by d)), null, bytes from seqs),
members as (
  select c, d, node, bytes, lag(node) over (partition by c order by d) as up from prefixes),
nodes as (select node, any_value(d) as d, min(c) as c, any_value(up) as up, any_value(bytes) as bytes, count(*) as n from members group by node),
kids as (select up as node, count(*) as k from nodes where up is not null group by up),
own as (select x.*, coalesce(k.k, 0) as k, (x.n - 1) * x.bytes as saved from nodes x left join kids k on k.node = x.node),
sums as (
  select m.node, sum(case when x.k = 0 then 1 else 0 end) as leaves, sum(x.saved) as saved
  from own x join members m on m.c = x.c and m.d <= x.d group by m.node),
ends as (select m.node, string_agg(m.c::varchar, ',' order by m.c) as ids from members m join lens l on l.c = m.c and l.len = m.d group by m.node)
select x.c as conv_id, x.d::bigint as depth, u.c as parent_conv_id, x.n as n_convs, x.k::bigint as n_children, s.leaves::bigint as n_leaves,
  s.saved::bigint as saved_tokens, sha256(coalesce(e.ids, '')) as ends_sha256
from own x left join nodes u on u.node = x.up join sums s on s.node = x.node left join ends e on e.node = x.node
"""
