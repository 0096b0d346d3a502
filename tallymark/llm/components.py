"""Connected components of a link table, as Spark joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.session import stage


def components(links: DataFrame) -> DataFrame:
    """``node, component`` of every node in ``links(a, b)``; a component is its smallest node.

    Each round points all larger neighbours of a node, and then all smaller ones, at
    the smallest node near it; the number of rounds grows with the logarithm of the
    longest path. Links are deduplicated before every shuffle. A node with very many
    neighbours is one aggregate whose map side is combined, and its result is written
    before it meets the links again, so that the join has exchanges of its own, which
    AQE can split (or none, where the result is small). Every round is written to the shared folder: a lost executor costs tasks of
    one round, not the whole history.
    """
    edges = stage(
        links.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(),
        "links",
    )
    while True:
        # Large star: neighbours above a node move to the smallest of its neighbourhood.
        both = edges.select("v", "u").union(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        lowest = stage(both.groupBy("v").agg(F.least("v", F.min("u")).alias("m")), "lowest")
        large = (
            both.where("u > v").join(lowest, "v")
            .select(F.col("u").alias("v"), F.col("m").alias("u")).distinct()
        )
        large = stage(large, "links")
        # Small star: a node and its lower neighbours move to the lowest of them.
        lowest = stage(large.groupBy("v").agg(F.min("u").alias("m")), "lowest")
        moved = large.join(lowest, "v").where("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u"))
        small = stage(moved.union(lowest.select("v", F.col("m").alias("u"))).distinct(), "links")
        # Done when all are stars: one way up for each node, and none that is also a root.
        ends = small.select(F.col("v").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
            small.select("u", F.lit(0), F.lit(1))
        )
        roles = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        if roles.where("up > 1 OR (up = 1 AND down = 1)").isEmpty():
            break
        edges = small
    roots = small.select(F.col("u").alias("node")).distinct()
    return small.select(F.col("v").alias("node"), F.col("u").alias("component")).union(
        roots.select("node", F.col("node").alias("component"))
    )
