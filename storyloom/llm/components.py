"""Connected components by repeated contraction; everything stays distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.llm.common import table


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges`` (a, b); root is one node of its component, the same for all.

    A round points every node to the smallest among itself and its neighbours, replaces nodes by those and drops
    the edges inside. At least half of the nodes that have an edge vanish each round, so rounds grow with the logarithm. The neighbours
    of a node are only ever reduced by min, before the shuffle too, and never gathered. Empty input: empty result.
    """
    maps = []
    left = table(edges.select("a", "b").where("a <> b"))
    while not left.isEmpty():
        both = left.unionAll(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = table(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("up")))
        maps.append(parent)
        a, b = (parent.select(F.col("node").alias(x), F.col("up").alias(f"{x}_up")) for x in "ab")
        left = table(left.join(a, "a").join(b, "b").where("a_up <> b_up").select(F.col("a_up").alias("a"), F.col("b_up").alias("b")).distinct())
    if not maps:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = maps[-1].select("node", F.col("up").alias("root"))
    for parent in maps[-2::-1]:
        above = roots.select(F.col("node").alias("up"), "root")
        roots = parent.join(above, "up", "left").select("node", F.coalesce("root", "up").alias("root"))
    return roots
