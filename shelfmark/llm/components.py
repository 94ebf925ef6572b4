"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (a, b): the smallest node that can be reached.

    Alternates two steps on the edges, both one grouping and one join: hang all larger neighbours
    of a node on its smallest one, then all smaller ones. The number of rounds grows with the
    logarithm of the longest path. Every round is written, so a lost executor repeats one round.
    Loops and repeated edges change nothing; an empty table gives an empty table; edges with a
    null end are ignored.
    """
    edges = materialize(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    before = None
    while (now := edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()) != before:
        before = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(
            F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")
        )
        # A node whose smaller neighbours move on keeps its own edge to the smallest.
        edges = materialize(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
