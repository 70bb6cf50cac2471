"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolesift.operators.joins import many_to_one
from rolesift.session import stage


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (a, b); nodes of one component share the root.

    In each round a node moves to its least neighbour, or stays, and twice on to where that
    one moved; the edges are then those between the places reached. A round at least halves
    every path of falling nodes and leaves no node that has a lesser neighbour, so the
    rounds grow as the logarithm of the longest path. Each round is a written table.
    """
    a, b = F.col("a"), F.col("b")
    left = stage(edges.filter(a != b).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct(), "edges")
    roots = stage(left.select(a.alias("node")).union(left.select(b.alias("node"))).distinct()
                  .withColumn("root", F.col("node")), "roots")
    while not left.isEmpty():
        both = left.union(left.select(b.alias("a"), a.alias("b")))
        moves = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("to"))
        moves = stage(moves.select(a.alias("at"), "to"), "moves")
        for _ in range(2):
            onward = moves.select(F.col("at").alias("to"), F.col("to").alias("_next"))
            moves = stage(many_to_one(moves, onward, ["to"]).select("at", F.col("_next").alias("to")), "moves")
        roots = stage(
            many_to_one(roots, moves.select(F.col("at").alias("root"), "to"), ["root"], "left")
            .select("node", F.coalesce("to", "root").alias("root")),
            "roots",
        )
        moved = many_to_one(left, moves.select(F.col("at").alias("a"), F.col("to").alias("_a")), ["a"])
        moved = many_to_one(moved, moves.select(F.col("at").alias("b"), F.col("to").alias("_b")), ["b"])
        x, y = F.col("_a"), F.col("_b")
        left = stage(moved.filter(x != y).select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct(), "edges")
    return roots
