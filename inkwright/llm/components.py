"""Connected components of a graph given as edges, without bringing it to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import cut


#: Nodes with at least this share of the edges are broadcast with their least neighbour: by their share, that many at most.
HOT = 1000
#: Edges that a written part holds: a small graph takes few tasks.
PART = 1 << 17


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of all nodes in ``edges`` (a, b: long); the component is its least node.

    Alternates large-star and small-star steps (Kiveris and others, 2014): the number of rounds grows
    with the logarithm of the graph, edges never get more, and each round is written to the shared
    folder. Minima are combined before each shuffle. A graph that hasn't settled raises an error.
    """
    def with_least(rows: DataFrame, least: DataFrame, total: int) -> DataFrame:
        """``rows`` with the least neighbour m of their u; the few nodes with a large share of all edges meet it without a shuffle."""
        hot = F.broadcast(least.filter(F.col("n") * HOT > total).select(F.col("u").alias("h"), F.col("m").alias("hm")))
        rows = rows.join(hot, F.col("u") == F.col("h"), "left")
        cold = rows.filter("h is null").drop("h", "hm").join(least.select(F.col("u").alias("w"), "m"), F.col("u") == F.col("w")).drop("w")
        return rows.filter("h is not null").select("u", "v", F.col("hm").alias("m")).union(cold.select("u", "v", "m"))

    def settled(rows: DataFrame, most: int) -> tuple[DataFrame, int, tuple]:
        """``rows`` written out in as many parts as ``most`` rows need, their number, and a sum that tells sets of edges apart."""
        out = cut(rows.coalesce(-(-most // PART) or 1))
        seen = out.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("a"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")).alias("b")).first()
        return out, seen["n"], tuple(seen)

    first = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    now, total, mark = settled(first, first.count())
    for _ in range(max_rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        # Large star: what is greater than a node goes to the least in its neighbourhood.
        large = with_least(both.filter("v > u"), least, 2 * total).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # Small star: what is smaller, and the node itself, goes to the least of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = with_least(large, least, 2 * total).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        now, total, after = settled(small, total)
        # Settled: every node has one edge, to a node that has none.
        if after == mark:
            roots = now.select("v").distinct()
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("v", "v"))
        mark = after
    raise RuntimeError("components: not settled")
