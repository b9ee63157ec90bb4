"""Connected components by alternating large-star and small-star.

Both steps are an aggregate (each node's smallest neighbour) joined back to the edges, so a
node with very many neighbours is reduced in the map tasks and its edges can be split by
adaptive execution; no neighbourhood is ever gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymeter.session import pin


def _large(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the smallest of its neighbourhood."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("w"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("w").alias("v")).where("u <> v")


def _small(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the smallest of them (here always u > v)."""
    least = edges.groupBy("u").agg(F.min("v").alias("w"))
    tied = edges.join(least, "u").where("v <> w").select(F.col("v").alias("u"), F.col("w").alias("v"))
    return tied.union(least.select("u", F.col("w").alias("v"))).distinct()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``node, component`` for every node that has a smaller one in its component.

    ``component`` is the smallest reachable node. Nodes without links, and the smallest nodes
    themselves, have no row. Links with a null end or equal ends are ignored. Each round is
    written to the shared folder, and only a row count and a checksum reach the driver.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    edges = pin(edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))).distinct(), "edges")
    before = None
    while True:
        now = tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == before or now[0] == 0:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = now
        edges = pin(_small(_large(edges).distinct()), "edges")
