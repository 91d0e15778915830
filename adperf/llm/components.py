"""Connected components of a link table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import cut


def _stars(links: DataFrame, large: bool) -> DataFrame:
    """One contraction: neighbours of a node are relinked to its smallest neighbour.

    ``large`` relinks only the larger neighbours (from the node's whole neighbourhood), else
    the smaller ones and the node itself. The smallest neighbour is an aggregate with map-side
    combine and the join may be split by AQE, so a hub node needs no task of its own.
    """
    if large:
        sides = links.select("a", "b").unionByName(
            links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:  # from each node to its smaller neighbours
        sides = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = sides.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    near = sides.join(least, "a")
    if large:
        out = near.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"),
                                                         F.col("m").alias("b"))
    else:
        out = near.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b")))
    return out.where(F.col("a") != F.col("b")).distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in ``links`` (a, b); component is the smallest node.

    Each round writes the contracted links, which cuts the lineage; it ends when a round
    changes nothing (a sum of hashes and the count of the links are equal).
    """
    links = cut(links.where(F.col("a") != F.col("b")).select("a", "b"), "links")
    last = None
    while True:
        links = cut(_stars(_stars(links, True), False), "stars")
        mark = links.agg(F.count(F.lit(1)),
                         F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == last:
            break
        last = mark
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
