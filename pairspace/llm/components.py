"""Connected components of links by alternating star operations, as joins and groupings only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairspace.plans.storage import materialise


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of the links ``a, b`` (integers): the smallest node that it reaches.

    Each round connects a node's larger neighbours to its smallest one (large star), then its smaller ones (small
    star), until nothing changes; the number of rounds grows with the logarithm of the longest
    path. Links may repeat or join a node to itself; a null end is ignored. Rounds are stored, so lost executors cost one round at
    most; only a count and a checksum come to the driver.
    """
    known = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter(F.col("a").isNotNull() & F.col("b").isNotNull())
    own = materialise(known.filter("a = b").select("a").distinct(), "component-loops")
    edges = materialise(known.filter("a <> b").distinct(), "component-links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        smallest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(smallest, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = materialise(small.unionByName(smallest.select("a", F.col("m").alias("b"))).distinct(), "component-links")
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == before:
            break
        before = state
    found = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component"))
    alone = own.select(F.col("a").alias("node"), F.col("a").alias("component"))
    return found.unionByName(roots).unionByName(alone).groupBy("node").agg(F.min("component").alias("component"))
