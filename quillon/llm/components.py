"""Connected components of a link table, by alternating large-star and small-star steps.

Links and labels stay in distributed tables; each round is a join and two aggregations that combine map-side, so a hub of
any size is handled, and its result goes to reliable storage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _large_star(links: DataFrame) -> DataFrame:
    """Every neighbour larger than a node is linked to the node's smallest neighbour (or itself)."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Every neighbour smaller than a node, and the node, are linked to the smallest of them. Links have u > v."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _signature(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(links: DataFrame) -> DataFrame:
    """``u, v`` links (longs) to ``node, root`` rows: the smallest node of each node's component.

    Only nodes with a link to another appear; self-links, repeated links and null ends are ignored.
    """
    links = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    links = cut(links)
    before = None
    while (now := _signature(links)) != before:
        before = now
        if not now[0]:
            break
        links = cut(_small_star(_large_star(links)), now[0])  # a round adds no links
    stars = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
