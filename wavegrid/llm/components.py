"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over ``links`` (a, b); nodes without links have no row.

    Each step is an aggregation and a join on the node. A hub's neighbours meet in one aggregate buffer only as a
    minimum, so a hub with very many links costs no task more than its share.
    """
    edges = C.saved(links.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    state = None
    while True:
        # large star: every larger neighbour of a node, and the node itself, hang on its smallest neighbour
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select("lo", "hi"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        large = large.union(least.select(F.col("u").alias("hi"), F.col("m").alias("lo"))).where("hi <> lo").distinct()
        # small star: the smaller neighbours of a node hang on the smallest of them
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).union(low.select("hi", F.col("m").alias("lo")))
        new = C.saved(small.where("hi <> lo").distinct())
        now = new.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo")), F.bit_xor(F.xxhash64("lo", "hi", F.lit(1)))).first()
        edges, done, state = new, now == state, now  # of the set of links, which are distinct: its size and two checksums
        if done:
            return edges.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
