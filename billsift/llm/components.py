"""Connected components of a link table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


def star_roots(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of ``links``; root is the smallest node of its component.

    Large and small stars take turns: each node's neighbours are hung onto the
    smallest of them, which halves distances, so the rounds grow with the
    logarithm of the longest chain. A node's smallest neighbour is a partial
    minimum before the shuffle and is joined back, so a node with a third of
    all links is split by the adaptive join rather than gathered. Each round is
    checkpointed. Links with a null end are ignored, self-links keep their node.
    """
    pair = links.select(F.col(a).alias("u"), F.col(b).alias("v")).dropna()
    pair = cut(pair.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
               .distinct())
    nodes = pair.select(F.col("u").alias("node")).union(pair.select("v")).distinct()
    now, before = pair.where("u > v"), None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select("v", "m").where("v > m").select(
            F.col("v").alias("u"), F.col("m").alias("v"))
        now = cut(small.union(low.select("u", F.col("m").alias("v"))).distinct())
        mark = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")),
                             F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if mark == before:
            break
        before = mark
    return nodes.join(now.select(F.col("u").alias("node"), F.col("v").alias("r")), "node", "left") \
        .select("node", F.coalesce("r", "node").alias("root"))
