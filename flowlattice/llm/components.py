"""Connected components of a link table by alternating large and small stars."""

from pyspark.sql import functions as F

from flowlattice.llm import common

MAX_ROUNDS = 60


def _stars(links, larger):
    """One star step on distinct undirected links (u, v).

    Large star: every larger neighbour of a node is linked to the smallest node around it. Small star: every neighbour that
    is not larger, and the node itself, is.
    """
    both = links.select("u", "v").unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))  # partial minima first, so hubs are no burden
    side = both.where("v > u") if larger else both.where("v < u")
    moved = side.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not larger:
        moved = moved.unionAll(low.where("m < u").select("u", F.col("m").alias("v")))
    return moved.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(links):
    """(node, root) for every node with a link; root is the smallest node of the component. Links are (u, v)."""
    links = common.materialized(
        links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    for _ in range(MAX_ROUNDS):
        moved = common.materialized(_stars(_stars(links, True), False), "links")
        # Done when the links are stars around the smallest nodes: no node is on both sides and none has two roots.
        again = moved.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").limit(1).unionAll(
            moved.select("u").join(moved.select(F.col("v").alias("u")), "u", "left_semi").withColumn("n", F.lit(1)).limit(1))
        links = moved
        if again.isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(
        links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
