"""Connected components of a table of links, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexgrove.llm.common import checkpointed


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``links(a, b)`` (long, in any direction).

    In each round a node points to the neighbour, or itself, that comes first in
    a hashed order, and links are redrawn between the nodes pointed to. Links
    keep their components, and the hashed order makes the number of nodes fall by
    a constant factor in expectation, also along sorted chains. A hub is only
    ever the key of a combining aggregate or of a join that Spark may split.
    """
    rounds: list[DataFrame] = []
    links = checkpointed(links.select("a", "b").where("a <> b").distinct())
    while links.take(1):
        both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("n"))
        points = both.groupBy("a").agg(F.min(first("b")).alias("best"))
        points = checkpointed(
            points.select(F.col("a").alias("node"), F.least(F.col("best"), first("a"))["n"].alias("to"))
        )
        rounds.append(points)
        left = points.select(F.col("node").alias("a"), F.col("to").alias("x"))
        right = points.select(F.col("node").alias("b"), F.col("to").alias("y"))
        links = checkpointed(
            links.join(left, "a").join(right, "b").where("x <> y")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        )
    if not rounds:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = rounds[-1].select("node", F.col("to").alias("root"))
    for points in reversed(rounds[:-1]):
        later = roots.select(F.col("node").alias("to"), "root")
        roots = points.join(later, "to", "left").select("node", F.coalesce("root", "to").alias("root"))
    return roots
