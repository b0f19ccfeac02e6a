"""Greedy one-to-one matching of two sides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbweave.sources.paths import cut


def greedy_matching(edges: DataFrame, by: list[str], left: str, right: str, order: list[Column]) -> DataFrame:
    """The edges that a walk in ``order`` takes, each only if neither of its ends is taken; ``by`` separates groups.

    In rounds: an edge that comes first at both of its ends is taken, and all other edges of these
    ends go. An edge that is first among all that are left is taken in every round, and no edge is
    taken before one that would have blocked it, so the result is the walk's. ``order`` must tell any
    two edges of an end apart (end with a key). A round is two groupings and no task holds a group's
    edges; the number of rounds is the longest chain of ends that pull each other away. Edges with
    a null end are never taken. Empty edges give an empty result.
    """
    names = edges.columns
    left_key, right_key = F.struct(*by, left), F.struct(*by, right)
    open_ = cut(edges.where(F.col(left).isNotNull() & F.col(right).isNotNull()).withColumns({"_o": F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]), "_l": left_key, "_r": right_key}))
    taken = open_.limit(0)
    while open_.limit(1).count():
        first_l = open_.groupBy("_l").agg(F.min("_o").alias("_o"))
        first_r = open_.groupBy("_r").agg(F.min("_o").alias("_o"))
        best = cut(open_.join(first_l, ["_l", "_o"], "left_semi").join(first_r, ["_r", "_o"], "left_semi"))
        taken = taken.unionByName(best)
        open_ = cut(open_.join(best.select("_l"), "_l", "left_anti").join(best.select("_r"), "_r", "left_anti"))
    return taken.select(*names)
