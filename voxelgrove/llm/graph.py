"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every end of edges (a, b): component is the smallest node reachable.

    Each round points every node at its smallest neighbour, follows that pointer twice more and keeps
    the edges that still join different nodes, so the table shrinks fast; no neighbour list is gathered.
    Nulls and loops are ignored; an empty table gives an empty table."""
    pairs = edges.where("a is not null and b is not null")
    left = settle(pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    nodes = settle(left.select(F.col("a").alias("node")).union(left.select("b")).distinct().withColumn("component", F.col("node")))
    while not left.isEmpty():
        both = left.union(left.select("b", "a"))
        point = settle(both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).select("u", F.least("u", "m").alias("p")))
        for _ in range(2):
            up = point.select(F.col("u").alias("p"), F.col("p").alias("q"))
            point = point.join(up, "p").select("u", F.col("q").alias("p"))
        nodes = settle(
            nodes.join(point.withColumnRenamed("u", "component"), "component", "left")
            .select("node", F.coalesce("p", "component").alias("component"))
        )
        left = left.join(point.select(F.col("u").alias("a"), F.col("p").alias("x")), "a")
        left = left.join(point.select(F.col("u").alias("b"), F.col("p").alias("y")), "b")
        left = settle(left.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    return nodes


def add_links(comps: DataFrame, links: DataFrame) -> DataFrame:
    """components() of all links so far, from comps of the earlier ones and further links (a, b).

    Only the components that the new links join are looked at again."""
    ends = links
    for side in "ab":
        of = comps.select(F.col("node").alias(side), F.col("component").alias("c" + side))
        ends = ends.join(of, side, "left").withColumn("c" + side, F.coalesce("c" + side, side))
    ends = settle(ends.select("a", "b", "ca", "cb"))
    joined = components(ends.select(F.col("ca").alias("a"), F.col("cb").alias("b"))).select(F.col("node").alias("component"), F.col("component").alias("into"))
    new = ends.select(F.col("a").alias("node"), F.col("ca").alias("component")).union(ends.select("b", "cb")).distinct()
    every = comps.join(new, "node", "left_anti").select("node", "component").union(new)
    return settle(every.join(joined, "component", "left").select("node", F.coalesce("into", "component").alias("component")))
