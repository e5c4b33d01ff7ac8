"""Canonical names: groups of similar spellings become one name, the most frequent.

Similarity comes as membership rows (group_key, name): two names are linked when
they share a key, directly or through others. Memberships grow with the names, not with their
pairs, and a key shared by very many names is only a long aggregate.

``similar_keys`` links names within d edits of each other exactly, in two ways that together miss no pair:

- Names share a gram of q letters. d edits spoil at most q * d grams, so of two names within d edits the q * d + 1 rarest grams of each have one in
  common, at places and in names whose places and lengths differ by d at most. Names that meet there are compared by Levenshtein distance.
- Names that are too short for so many grams, and names whose gram very many share, are written as patterns instead: up to d letters left out or blanked.
  Of the names with one pattern, that with the fewest letters left out is linked to all whose edits and its own add up to d. This needs no pairs,
  and loses no link: if two names of a pattern are within d that way, so are each of them and the one with the fewest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.functions.sizing import broadcast_if_small
from panelwright.session import durable

GRAM = 2
#: Names that share a gram at one place beyond this number are linked through patterns instead of pairs.
HEAVY = 200
BLANK = "\u0001"


def _plain(names: DataFrame, name: str) -> DataFrame:
    """(name, flat): distinct names, and their form that is compared: lower case, without outer blanks."""
    plain = names.select(F.col(name).alias("name")).where(F.col("name").isNotNull()).distinct()
    return plain.withColumn("flat", F.lower(F.trim("name")))


def _patterns(flat: DataFrame, d: int) -> DataFrame:
    """(flat, pattern, out, blanks): each name with up to d letters left out or blanked."""
    start = F.struct(F.col("flat").alias("pattern"), F.lit(0).alias("out"), F.lit(0).alias("blanks"))
    every, last = F.array(start), F.array(start)

    def edits(p: Column) -> Column:
        places = F.when(F.length(p["pattern"]) > 0, F.sequence(F.lit(1), F.length(p["pattern"]))).otherwise(F.array().cast("array<int>"))
        left = lambda i: F.substr(p["pattern"], F.lit(1), i - 1)
        right = lambda i: F.substr(p["pattern"], i + 1)
        gone = F.filter(places, lambda i: F.substr(p["pattern"], i, F.lit(1)) != BLANK)
        out = F.transform(gone, lambda i: F.struct(F.concat(left(i), right(i)).alias("pattern"), (p["out"] + 1).alias("out"), p["blanks"].alias("blanks")))
        blank = F.transform(
            gone, lambda i: F.struct(F.concat(left(i), F.lit(BLANK), right(i)).alias("pattern"), p["out"].alias("out"), (p["blanks"] + 1).alias("blanks"))
        )
        return F.concat(out, blank)

    rows = flat.select("flat", every.alias("every"), last.alias("last"))
    for _ in range(d):
        rows = rows.withColumn("last", F.array_distinct(F.flatten(F.transform("last", edits))))
        rows = rows.withColumn("every", F.concat("every", "last"))
    return rows.select("flat", F.explode("every").alias("p")).select("flat", "p.*").distinct()


def _grams(flat: DataFrame, d: int, q: int) -> DataFrame:
    """(flat, gram, place, length) of the q * d + 1 rarest grams of each name; the order of grams is the same for all names."""
    places = F.sequence(F.lit(1), F.length("flat") - (q - 1))
    rows = flat.select("flat", F.explode(F.transform(places, lambda i: F.struct(F.substr("flat", i, F.lit(q)).alias("gram"), i.alias("place")))).alias("g"))
    rows = rows.select("flat", "g.gram", "g.place")
    common = rows.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    listed = rows.join(broadcast_if_small(durable(common)), "gram").groupBy("flat").agg(F.sort_array(F.collect_list(F.struct("n", "gram", "place"))).alias("g"))
    return listed.select("flat", F.length("flat").alias("length"), F.explode(F.slice("g", 1, q * d + 1)).alias("g")).select("flat", "length", "g.gram", "g.place")


def similar_keys(names: DataFrame, d: int = 1, name: str = "name", q: int = GRAM, heavy: int = HEAVY) -> DataFrame:
    """(group_key, name): memberships of names within d edits (Levenshtein; case and outer blanks do not count) of each other, directly or through others.

    The number of patterns of a name grows as its length to the power d, so d is meant to be 1 to 3.
    """
    plain = durable(_plain(names, name))
    flat = durable(plain.select("flat").distinct())
    least = q * d + q  # with fewer letters a name has fewer than q * d + 1 grams
    grams = durable(_grams(flat.where(F.length("flat") >= least), d, q))
    # How many rows meet at a place: of one gram, in names as long, within d places.
    near = F.sequence(F.lit(-d), F.lit(d))
    rows = grams.groupBy("gram", "length", "place").agg(F.count(F.lit(1)).alias("n"))
    full = durable(rows.where(F.col("n") > heavy).select("gram").distinct())
    light = grams.join(broadcast_if_small(full), "gram", "left_anti")
    reach = light.select("flat", "gram", F.explode(F.transform(near, lambda x: F.col("length") + x)).alias("length"), "place")
    reach = reach.select(F.col("flat").alias("other"), "gram", "length", F.explode(F.transform(near, lambda x: F.col("place") + x)).alias("place"))
    met = light.join(reach, ["gram", "length", "place"]).where(F.col("flat") < F.col("other")).select("flat", "other").distinct()
    pairs = met.where(F.levenshtein("flat", "other", d) >= 0)
    pair = F.concat(F.lit("pair "), F.sha2(F.concat_ws(BLANK, "flat", "other"), 256))
    linked = pairs.select(F.explode(F.array("flat", "other")).alias("flat"), pair.alias("group_key"))
    # Short names, those they may be within d of, and names with a gram that very many share.
    written = flat.where(F.length("flat") < least + d).union(grams.join(broadcast_if_small(full), "gram", "left_semi").select("flat")).distinct()
    patterns = durable(_patterns(written, d))
    fewest = patterns.groupBy("pattern").agg(F.min("out").alias("fewest"))
    joined = patterns.join(fewest, "pattern").where(F.col("out") + F.col("blanks") + F.col("fewest") <= d)
    starred = joined.select("flat", F.concat(F.lit("like "), "pattern").alias("group_key"))
    # Spellings with one compared form belong together too.
    alike = plain.select(F.concat(F.lit("same "), "flat").alias("group_key"), "name")
    return linked.union(starred).join(plain, "flat").select("group_key", "name").union(alike).distinct()


def edit_keys(names: DataFrame, name: str = "name") -> DataFrame:
    """(group_key, name): the name and its forms with one character left out.

    Names one edit apart always share a key; case and outer blanks are ignored.
    """
    plain = names.select(F.col(name).alias("name")).where(F.col("name").isNotNull()).distinct()
    plain = plain.withColumn("flat", F.lower(F.trim("name")))
    places = F.sequence(F.lit(1), F.greatest(F.length("flat"), F.lit(1)))
    cut = F.transform(
        places, lambda i: F.concat(F.substr("flat", F.lit(1), i - 1), F.substr("flat", i + 1))
    )
    return plain.select(F.explode(F.array_distinct(F.array_append(cut, F.col("flat")))).alias("group_key"), "name")


def connected_names(memberships: DataFrame) -> DataFrame:
    """(name, component) where component is the smallest name reachable through shared keys.

    Smallest labels pass from names to keys and back until nothing changes; every round is stored. Labels of labels are
    followed, so the number of rounds grows with the logarithm of the longest chain, and there is no limit on it.
    """
    edges = durable(memberships.select("group_key", "name").distinct())
    labels = durable(edges.select("name").distinct().withColumn("component", F.col("name")))
    while True:
        # Stored per key, so that the join below may split a key that very many names share.
        per_key = durable(edges.join(labels, "name").groupBy("group_key").agg(F.min("component").alias("component")))
        moved = edges.join(per_key, "group_key").groupBy("name").agg(F.min("component").alias("reached"))
        # Follow the label of the label as well, which shortens long chains.
        jump = labels.select(F.col("name").alias("reached"), F.col("component").alias("jumped"))
        merged = durable(
            labels.join(moved, "name")
            .join(jump, "reached", "left")
            .select("name", F.col("component").alias("before"), F.least("component", "reached", "jumped").alias("component"))
        )
        labels = merged.select("name", "component")
        if merged.where(F.col("before") != F.col("component")).limit(1).count() == 0:
            return labels


def canonical_names(memberships: DataFrame, counts: DataFrame) -> DataFrame:
    """(name, canonical): the most frequent name of each component, the smallest on ties.

    ``counts`` has one row (name, n) per name.
    """
    components = connected_names(memberships)
    counted = components.join(counts, "name", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    first = F.min(F.struct((-F.col("n")).alias("rank"), F.col("name").alias("canonical")))
    heads = durable(counted.groupBy("component").agg(first.alias("first")).select("component", "first.canonical"))
    return components.join(heads, "component").select("name", "canonical")


def rename(df: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """Canonical name where the mapping has one, else the raw name."""
    side = mapping.select(F.col("name").alias("_raw"), F.col("canonical").alias("_canonical"))
    joined = df.join(side, F.col(column) == F.col("_raw"), "left")
    return joined.select(*[F.coalesce("_canonical", column).alias(c) if c == column else F.col(c) for c in df.columns])
