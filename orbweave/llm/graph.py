"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave.llm.runtime import cut


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


#: Edges of a node from which its neighbours' minimum is broadcast instead of shuffled to, and the nodes that may have so many.
HEAVY_EDGES = 256
HEAVY_NODES = 200_000


def _to_neighbours(edges: DataFrame, least: DataFrame) -> DataFrame:
    """``edges`` with ``m`` of their ``u``; the few heavy nodes' edges stay where they are.

    ``least`` has ``u``, ``m`` and the number of edges ``c``. A node with a third of all edges would
    put these in one task of a shuffled join.
    """
    heavy = cut(least.where(F.col("c") >= HEAVY_EDGES).select("u", "m"))
    n = heavy.count()
    if not 0 < n <= HEAVY_NODES:
        return edges.join(least.select("u", "m"), "u")
    few = F.broadcast(heavy)
    return edges.join(few, "u").unionByName(edges.join(few.select("u"), "u", "left_anti").join(least.where(F.col("c") < HEAVY_EDGES).select("u", "m"), "u"))


def components(edges: DataFrame) -> DataFrame:
    """Smallest reachable node of every node with an edge.

    ``edges`` has long columns ``a`` and ``b``; direction, repeats and loops do not matter. Returns
    ``node``, ``component`` for all nodes but the components' own smallest ones. Each round
    shuffles the edges only and is cut; the number of rounds grows with the logarithm of the
    longest chain. Minima are aggregated before the shuffle, and those of heavy nodes (a star's
    centre) are broadcast back, at most ``HEAVY_NODES`` of 16 bytes. An empty input gives an empty result.
    """
    edges = cut(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    before = _state(edges)
    while before[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("c")).select("u", F.least("u", "m").alias("m"), "c")
        large = cut(_to_neighbours(both, least).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("c"))
        rest = _to_neighbours(large, low).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(rest.union(low.select("u", F.col("m").alias("v"))).distinct())
        after = _state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
