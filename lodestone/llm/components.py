"""Connected components of a link table, in rounds of large-star and small-star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import materialize


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, component`` for each node of ``links`` (``u, v`` long): the smallest node reachable.

    Large-star ties each node's larger neighbours to its smallest neighbour, small-star does so for the
    smaller ones; links never grow in number and paths halve, so a few rounds do.  Each round's
    links are written to the shared folder; the driver sees a count and a checksum of them.
    Null ends and loops are ignored.
    """
    edges = links.where("u <> v").select(F.greatest("u", "v").cast("long").alias("a"), F.least("u", "v").cast("long").alias("b")).distinct()
    edges, before = materialize(edges, "links"), None
    for _ in range(max_rounds):
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = materialize(small.unionByName(small_least.select("a", F.col("m").alias("b"))).distinct(), "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"links did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))


def least_reachable(nodes: DataFrame, classes: DataFrame) -> DataFrame:
    """``nodes`` (``node, least``, ...) with ``component_id``: the smallest id of a node's class, null if no row of the class has an id."""
    linked = nodes.join(classes, "node")
    of_class = linked.groupBy("component").agg(F.min("least").alias("_least"))
    by_node = linked.select("node", "component").join(of_class, "component").select("node", "_least")
    return nodes.join(by_node, "node", "left").withColumn("component_id", F.coalesce("_least", "least")).drop("_least", "least")
