"""Connected components of a link table by alternating star operations; all state stays in written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wearline.llm.common import cut


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of `links` (a, b); a component is named by its smallest node.

    Each round links every node's larger neighbours to the smallest one around it (large star), then every node and its smaller
    neighbours to the smallest (small star), until nothing changes; the rounds grow with the logarithm of the longest chain.
    Minima are combined inside the map tasks, so a node that a third of all links meet needs no special care.
    """
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())
        before = state
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = cut(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        edges = cut(joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", "m")).where("u <> v").distinct())
