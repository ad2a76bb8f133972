"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace


def components(links: DataFrame, space: Workspace) -> DataFrame:
    """(node, root) for each node of ``links`` (a, b): root is the smallest node it reaches.

    Each round writes its links to the workspace and joins them with the smallest neighbour of
    each node, a partial aggregate, so no node's neighbours are ever collected. Rounds grow with
    the logarithm of the longest path. Links from a node to itself, repeated ones and nulls are ignored.
    """

    def smallest(edges: DataFrame, of: str, other: str) -> DataFrame:
        return edges.groupBy(F.col(of).alias("hub")).agg(F.min(other).alias("m"))

    # Edges point from the larger node a to the smaller node b.
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = space.save(edges, "links0")
    for k in range(1, 100):
        # Large star: the larger neighbours of each node move to its smallest neighbour, or to itself.
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = smallest(both, "a", "b").select("hub", F.least("hub", "m").alias("m"))
        large = both.where("b > a").join(least, F.col("a") == F.col("hub")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: the smaller neighbours of each node, and itself, move to the smallest of them.
        least = smallest(large, "a", "b")
        small = large.join(least, F.col("a") == F.col("hub")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(least.select(F.col("hub").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()
        new = space.save(small, f"links{k}")
        # Settled once every node has one link, and no root has a link of its own.
        hubs = new.agg(F.count("*").alias("n"), F.countDistinct("a").alias("nodes")).first()
        chained = new.join(new.select(F.col("a").alias("b")), "b", "left_semi").limit(1).count()
        space.drop(f"links{k - 1}")
        edges = new
        if hubs["n"] == hubs["nodes"] and not chained:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
