"""Connected components of an edge table, without gathering a component anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import stored


def _largest_first(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours are tied to its smallest neighbour (or itself)."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _smallest_first(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are tied to its smallest neighbour. Edges go from the larger node to the smaller."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of comparable, non-null nodes -> (node, root) for every node that has an edge, the root left out; root is the smallest
    node of the component.

    Alternates the two star operations of Kiveris and others (2014) until nothing moves: the number of rounds grows with the logarithm of the
    size. Minima are combined before the shuffle and joined back, so a node with very many edges is never gathered. Every
    round is stored.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    edges = stored(edges, "edges")
    before = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if before == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state
        edges = stored(_smallest_first(_largest_first(edges)), "edges")
