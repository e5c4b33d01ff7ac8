"""Near copies by SimHash links and exact Jaccard similarity of word shingles.

Each text has a SimHash of its distinct shingles. Fingerprints within two bits are found as in `simhash`: segment popcounts, range-joined on grid vertices,
and midpoints; their links are verified on the whole shingle sets, and what they join is not compared again. At 64 bits the grid
can't reach further: texts of similarity 0.8 differ in ten bits on average and in up to 17, at which distance its points prune nothing. So min-hash bands look
for links between different components of SimHash links, and lose none that the bands alone would find.

Candidates of the bands share all four min-hashes of one of 28 bands: two texts of similarity s share none with a chance of (1 - s^4)^28, 4e-7 at 0.8 and less above;
texts with only a common passage hardly ever do. Every link is verified on the whole shingle sets; texts of equal sets stand as one.

A bucket's members are first held against its leader, the member that meets most others over all its buckets: of a text and its edits that is the
text. Whoever then is in the leader's component is settled with it. Small buckets compare what is open pair by pair. In larger ones the members of a leader are
compared through their differences from it: two sets are similar if and only if their differences from the leader share enough shingles,
and where both lie about as far from the leader as the bound, or further, that is nearly all of what both differ in. Differences are put in an order with common shingles
last, and two of them can share enough only if their beginnings share a shingle (prefix filter): only beginnings become rows. Edits made apart from each other add
shingles of their own, so such a group makes hardly any pairs, whatever its size, and no possible link is left out.
Open members of a group whose leader settled many or a fair share get a leader of their own in the next round; in other groups they are compared with each other.
Pairs still grow with the square of a group whose members differ from the leader in the same many shingles and are not linked to it.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import stored, text_or_empty, unused
from panelwright.llm.graph import components
from panelwright.llm.simhash import fingerprints, links, shingle_hashes

WORDS = 5
SIMILARITY = 0.8
BANDS = 28
ROWS = 4
#: Buckets of at most so many members compare what the leader did not settle pair by pair.
FEW = 16
#: A leader that settles this share of its group, or so many members, is followed by another one for the rest.
SETTLED_SHARE, SETTLED = 1 / 8, 64
#: Shingles of more than this share of a group's differences come last in their order.
FREQUENT_SHARE = 1 / 32
#: Bounds are widened by this against rounding; every pair is verified exactly.
SLACK = 1e-6


def hashes_of(text: str, words: int):
    """Distinct hashes of a text's shingles, sorted; texts without words have one of their own."""
    import numpy as np

    return np.unique(np.array(shingle_hashes(text, words) or [0], dtype=np.uint64))


def _factors(bands: int, rows: int):
    import numpy as np

    return np.random.default_rng(42).integers(0, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def bands_of(hashes, factors, rows: int = ROWS):
    """One number per band, of the smallest products of the hashes with ``rows`` odd factors."""
    import numpy as np

    least = np.min([(factors[:, None] * hashes[i : i + 2048]).min(axis=1) for i in range(0, len(hashes), 2048)], axis=0).reshape(-1, rows)
    mixed = np.arange(1, len(least) + 1, dtype=np.uint64)
    for k in range(rows):
        mixed = (mixed ^ least[:, k]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return mixed.view(np.int64)


def _banded(words: int, bands: int, rows: int):
    """(node, fp, numbers of its bands) of each text; fp is the SimHash of its distinct shingles."""

    def run(batches):
        factors = _factors(bands, rows)
        for batch in batches:
            found, prints = [], []
            for text in batch.column(1):
                hashes = hashes_of(text.as_py(), words)
                found.append(bands_of(hashes, factors, rows))
                prints.append(int(fingerprints(hashes, [len(hashes)])[0]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64()), _lists(found)], names=["node", "fp", "numbers"])

    return run


def _shingled(words: int):
    """(node, hashes, digest of the hashes) of each text."""

    def run(batches):
        from hashlib import md5

        for batch in batches:
            found = [hashes_of(text.as_py(), words) for text in batch.column(1)]
            digests = pa.array([md5(x.tobytes()).digest() for x in found], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(found), digests], names=["node", "numbers", "digest"])

    return run


def _lists(found: list):
    import numpy as np

    ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
    flat = np.concatenate(found) if found else np.zeros(0, dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) that are as similar; sets (node, numbers)."""
    left = pairs.join(sets.select(F.col("node").alias("a"), F.size("numbers").alias("n_a")), "a")
    sized = left.join(sets.select(F.col("node").alias("b"), F.size("numbers").alias("n_b")), "b")
    sized = sized.where(F.least("n_a", "n_b") / F.greatest("n_a", "n_b") >= similarity).select("a", "b")
    both = sized.join(sets.select(F.col("node").alias("a"), F.col("numbers").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("numbers").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return both.where(shared / (F.size("x") + F.size("y") - shared) >= similarity).select("a", "b")


def _led(members: DataFrame) -> DataFrame:
    """members (key, node) -> (key, node, n, least) of the buckets with n > 1 nodes; least is the leader, the node that meets most others."""
    shared = members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sized = stored(members.join(shared, "key").select("key", "node", "n"), "sized-buckets")
    met = stored(sized.groupBy("node").agg(F.sum("n").alias("met")), "met")
    leaders = sized.join(met, "node").groupBy("key").agg(F.max(F.struct("met", "node"))["node"].alias("least"))
    return stored(sized.join(leaders, "key").select("key", "node", "n", "least"), "buckets")


def _ordered(one, other) -> list:
    return [F.greatest(one, other).alias("a"), F.least(one, other).alias("b")]


def _differences(groups: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(least, node, ..., e, i): the shingles that a member and its leader do not share, from rare in the group to common, i from 0.

    Let c = (1 - s) / (1 + s). Sets x and y are similar if and only if |x ^ y| <= c (|x| + |y|). With X and Y their differences from the leader
    and f(x) = |X| - c |x| that is |X & Y| >= (f(x) + f(y)) / 2. A leader's own difference is empty, so f >= -c |leader| for all, and
    f > c |leader| for members that are not linked to it. f(x) and f(y) of similar sets differ by at most 2 c |x| / s, as the shared part is no larger than either difference.
    Of each difference only the beginning is returned that can hold the first shared shingle. Any order that holds for the whole group will do for that:
    shingles that the leader lacks, those that it has, and last, by their counts, those in which a large share of the members differ from it.
    So a difference is put in order where it lies, and only its beginning becomes rows.
    """
    c = (1 - similarity) / (1 + similarity)
    own = sets.select("node", F.col("numbers").alias("x"))
    its = sets.select(F.col("node").alias("least"), F.col("numbers").alias("y"))
    size, top = F.size("x"), F.size("y")
    both = groups.join(own, "node").join(its, "least")
    apart = both.select(*groups.columns, size.alias("size"), (c * top).alias("far"), F.concat(F.array_except("x", "y"), F.array_except("y", "x")).alias("d"))
    apart = apart.withColumn("n_d", F.size("d")).withColumn("f", F.col("n_d") - c * F.col("size"))
    partner = F.when(F.col("open"), -F.col("far")).otherwise(F.col("far"))  # an open member may meet a settled one; a settled one only open ones
    need = F.ceil((F.col("f") + F.greatest(partner, F.col("f") - 2 * c / similarity * F.col("size"))) / 2 - SLACK)
    apart = apart.withColumn("reach", (F.col("n_d") - F.greatest(F.lit(1), need) + 1).cast("int")).drop("far").where("reach > 0")
    apart = stored(apart.repartition("node"), "differences")
    in_order = F.coalesce(F.concat(F.array_except("d", "frequent"), F.array_intersect("frequent", "d")), "d")
    placed = apart.join(_frequent(apart), "least", "left").withColumn("d", F.slice(in_order, F.lit(1), F.col("reach"))).drop("frequent", "reach")
    # Dealt by member again, so that no task makes the rows of a whole group.
    return stored(placed.repartition("node").select(*[x for x in placed.columns if x != "d"], F.posexplode("d").alias("i", "e")), "beginnings")


def _frequent(apart: DataFrame) -> DataFrame:
    """(least, frequent): the shingles of more than FREQUENT_SHARE of a group's differences, by their counts; at most 1 / FREQUENT_SHARE times as many as a member has on average."""
    members = apart.groupBy("least").agg(F.count(F.lit(1)).alias("members"))
    counts = apart.select("least", F.explode("d").alias("e")).groupBy("least", "e").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    own = counts.join(members, "least").where(F.col("n") > FREQUENT_SHARE * F.col("members"))
    return own.groupBy("least").agg(F.array_sort(F.collect_list(F.struct("n", "e")))["e"].alias("frequent"))


def _by_differences(groups: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of members of a group that may be similar. groups: (least, node, root, open, last), open unless settled with the leader;
    settled members are compared with open ones, and in groups that are `last` open ones with each other."""
    rows = _differences(groups, sets, similarity)
    one, other = rows.where("open").alias("p"), rows.alias("q")
    met = one.join(other, ["least", "e"]).where(
        (F.col("p.root") != F.col("q.root"))
        & (~F.col("q.open") | (F.col("q.last") & (F.col("p.node") < F.col("q.node"))))
        & (F.least(F.col("p.n_d") - F.col("p.i"), F.col("q.n_d") - F.col("q.i")) >= (F.col("p.f") + F.col("q.f")) / 2 - SLACK)
        & (F.least("p.size", "q.size") >= similarity * F.greatest("p.size", "q.size") - SLACK)
    )
    return met.select(*_ordered(F.col("p.node"), F.col("q.node"))).distinct()


def _near_prints(prints: DataFrame) -> DataFrame:
    """prints (node, fp) -> pairs (a, b): nodes of one fingerprint with the smallest of them, and the smallest ones of fingerprints that `simhash.links` ties."""
    first = stored(prints.groupBy("fp").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("n")), "fingerprints")
    same = prints.join(first.where("n > 1"), "fp").where("node <> least").select(*_ordered("node", "least"))
    one, other = first.select(F.col("fp").alias("a"), F.col("least").alias("p")), first.select(F.col("fp").alias("b"), F.col("least").alias("q"))
    across = links(first.select("fp")).join(one, "a").join(other, "b").select(*_ordered("p", "q"))
    return stored(same.union(across), "near-fingerprints")


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs (a, b) that roots (node, root) do not join yet."""
    its = pairs.join(roots.toDF("a", "_of_a"), "a", "left").join(roots.toDF("b", "_of_b"), "b", "left")
    return its.where(F.coalesce("_of_a", "a") != F.coalesce("_of_b", "b")).select("a", "b")


def linked(texts: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """texts (node, text), equal texts with equal nodes -> (node, root) of every node that is linked to a smaller one."""
    each = texts.select("node", "text").mapInArrow(_banded(words, BANDS, ROWS), "node binary, fp bigint, numbers array<bigint>")
    each = stored(each.dropDuplicates(["node"]), "fingerprints-and-bands")
    close = _near_prints(each.select("node", "fp"))
    drawn = stored(each.select("node", F.explode(F.array_distinct("numbers")).alias("key")), "bands")
    shared = drawn.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    members = stored(drawn.join(shared, "key", "left_semi").select("key", "node"), "members")
    met = members.select("node").union(close.select("a")).union(close.select("b")).distinct()
    chosen = texts.dropDuplicates(["node"]).join(met, "node", "left_semi").select("node", "text")
    sets = stored(chosen.mapInArrow(_shingled(words), "node binary, numbers array<bigint>, digest binary"), "shingle-sets")
    first = sets.groupBy("digest").agg(F.min("node").alias("stands"))
    alike = stored(sets.select("node", "digest").join(first, "digest").where("node <> stands").select(F.col("node").alias("a"), F.col("stands").alias("b")), "alike")
    edges = stored(alike.union(_verified(close, sets, similarity)), "near-pairs")
    roots = components(edges)
    if not alike.isEmpty():
        members = members.join(alike.select(F.col("a").alias("node")), "node", "left_anti")
    while True:
        led = _led(members)
        fresh = _apart(led.where("node <> least").select(*_ordered("node", "least")).distinct(), roots)
        edges = stored(edges.union(_verified(stored(fresh, "led-pairs"), sets, similarity)), "near-pairs")
        roots = components(edges)
        top = roots.select(F.col("node").alias("least"), F.col("root").alias("top"))
        named = led.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).join(top, "least", "left")
        named = stored(named.withColumn("open", F.col("root") != F.coalesce("top", "least")).drop("top"), "named")
        torn = named.where("open").select("key").distinct()
        torn = stored(named.join(torn, "key", "left_semi"), "torn")
        if torn.isEmpty():
            return roots
        few = torn.where(F.col("n") <= FEW).select("key", "node", "root")
        pairs = few.alias("p").join(few.alias("q"), "key").where("p.node > q.node and p.root <> q.root").select(F.col("p.node").alias("a"), F.col("q.node").alias("b")).distinct()
        many = torn.where(F.col("n") > FEW)
        group = many.groupBy("least", "node").agg(F.first("root").alias("root"), F.first("open").alias("open"))
        settled = F.sum((~F.col("open") & (F.col("node") != F.col("least"))).cast("int"))
        last = group.groupBy("least").agg(((settled < SETTLED) & (settled < SETTLED_SHARE * F.count(F.lit(1)))).alias("last"))
        groups = stored(group.join(last, "least"), "groups")
        if groups.isEmpty():
            edges = stored(edges.union(_verified(pairs, sets, similarity)), "near-pairs")
            return components(edges)
        fresh = stored(pairs.union(_by_differences(groups, sets, similarity)).distinct(), "pairs")
        edges = stored(edges.union(_verified(fresh, sets, similarity)), "near-pairs")
        again = groups.where("open and not last").select("least", "node")
        members = stored(many.join(again, ["least", "node"], "left_semi").select("key", "node"), "members")
        if members.isEmpty():
            return components(edges)


def keep_one(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """The document of smallest id of each component, with all its columns; null and empty texts are alike.

    Rows without an id stay and are never a component's document. Different texts of one id are told apart; of equal rows of id and text one stays.
    """
    node = F.unhex(F.md5(text_or_empty(text_col)))
    roots = linked(documents.select(node.alias("node"), text_or_empty(text_col).alias("text")), words, similarity)
    first = stored(documents.where(F.col(id_col).isNotNull()).select(node.alias("node"), F.col(id_col).alias("id")).groupBy("node").agg(F.min("id").alias("id")), "first-ids")
    tied = first.join(roots, "node", "left").select("node", "id", F.coalesce("root", "node").alias("root"))
    mark = unused(documents, "_near_node")
    kept = stored(tied.groupBy("root").agg(F.min(F.struct("id", "node")).alias("k")).select(F.col("k.id").alias("_kept_id"), F.col("k.node").alias("_kept_node")), "kept")
    marked = documents.withColumn(mark, node)
    out = marked.join(kept, (marked[id_col] == kept["_kept_id"]) & (marked[mark] == kept["_kept_node"]), "left_semi")
    repeated = documents.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id"), node.alias("node")).count().where("count > 1")
    if not repeated.isEmpty():
        out = out.dropDuplicates([id_col, mark])
    nameless = documents.where(F.col(id_col).isNull())
    out = out.drop(mark)
    return out if nameless.isEmpty() else out.unionByName(nameless)
