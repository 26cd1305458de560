"""Connected components by alternating large-star and small-star steps."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyscope.functions.staging import release, stage


def _star(edges: DataFrame) -> DataFrame:
    """Point both ends of each edge at the smaller one: (node, root) with root < node, distinct."""
    return edges.where("u <> v").select(
        F.greatest("u", "v").alias("node"), F.least("u", "v").alias("root")).distinct()


def connected_components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, root) where root is the smallest member of the node's component.

    Large-star links every larger neighbour of a node to the node's smallest neighbour,
    small-star links the smaller ones; the two alternate until the star forest stops changing,
    which takes a logarithmic number of rounds. The smallest neighbour is a map-side-combined
    ``min``, so a node with very many neighbours is no problem, and each round is staged.
    """
    links = stage(_star(edges.select(F.col(left).alias("u"), F.col(right).alias("v"))), "components")
    previous = None
    while True:
        both = links.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(
            links.select(F.col("root").alias("u"), F.col("node").alias("v")))
        smallest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = _star(both.where("v > u").join(smallest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        lowest = large.groupBy("node").agg(F.min("root").alias("m"))
        small = large.join(lowest, "node").select(
            F.explode(F.array(F.struct(F.col("node").alias("u"), F.col("m").alias("v")),
                              F.struct(F.col("root").alias("u"), F.col("m").alias("v")))).alias("e")
        ).select("e.u", "e.v")
        nxt = stage(_star(small), "components")
        mark = nxt.agg(F.count("*"), F.sum(F.xxhash64("node", "root").cast("decimal(38,0)"))).first()
        if mark == previous:
            release(nxt)
            break
        release(links)
        links, previous = nxt, mark
    roots = links.select("root").distinct().select(F.col("root").alias("node"), "root")
    return links.select("node", "root").unionByName(roots)
