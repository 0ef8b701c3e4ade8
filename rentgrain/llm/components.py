"""Connected components by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentgrain.llm.frames import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); the root is the smallest node that is reachable.

    In each round every node points to its smallest neighbour if that is smaller, pointers are followed
    twice, and the edges are rewritten to where their ends point. Rounds grow with the logarithm of the
    longest path of falling numbers; edges only get fewer. Edges of one hub may be split in its joins,
    since the other side has one row for each node.
    """
    left = stored(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    roots: DataFrame | None = None
    while not left.isEmpty():
        ends = left.select("a", "b").unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        point = ends.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("to"))
        point = stored(_followed(stored(point)))
        if roots is None:
            roots = point.withColumnRenamed("to", "root")
        else:
            roots = roots.join(point.select(F.col("node").alias("root"), "to"), "root", "left").select(
                "node", F.coalesce("to", "root").alias("root")
            )
        roots = stored(roots)
        ends = ("a", "b")
        for end in ends:
            left = left.join(point.withColumnRenamed("node", end), end).drop(end).withColumnRenamed("to", end)
        left = stored(left.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    return roots if roots is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0)


def _followed(point: DataFrame) -> DataFrame:
    """Pointers after one more step."""
    further = point.select(F.col("node").alias("to"), F.col("to").alias("next"))
    return point.join(further, "to", "left").select("node", F.coalesce("next", "to").alias("to"))
