"""Connected components over a links table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def _stars(pairs: DataFrame) -> DataFrame:
    """(u, v, m): every pair with m, the smallest of u and all its partners.

    The minimum is pre-aggregated before its shuffle; only the join back meets a hub's
    rows, and that is a sort-merge join, which adaptive execution splits when skewed.
    """
    low = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return pairs.join(low, "u")


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) of every node in links(a, b), root the smallest node it reaches.

    Self links and repeats are allowed; an empty table gives an empty table. Each round is
    checkpointed in the shared folder, so a lost executor repeats one round at most.
    """
    edges = checkpointed(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        narrow=True,
    )
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _stars(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _stars(large)
        new = small.select("u", F.col("m").alias("v")).unionByName(
            small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        )
        edges = checkpointed(new.where("u <> v").distinct(), narrow=True)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
