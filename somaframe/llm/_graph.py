"""Connected components of undirected links, for the near-duplicate operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from somaframe.llm._common import checkpoint

MOST_ROUNDS = 60


def _lowest(links: DataFrame) -> DataFrame:
    """Each node's lowest neighbour below it; a sum by key, so a hub's links are combined before the shuffle."""
    return links.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("low"))


def components(links: DataFrame) -> DataFrame:
    """node, component (its lowest node) for every node in `links` (a, b: long); alternating large and small stars.

    A round joins links with each node's lowest neighbour (aggregated first, so only the join sees a hub, and
    adaptive execution splits that). Rounds grow with the logarithm of the number of links. Each round is
    checkpointed, so a lost executor costs one round."""
    links = checkpoint(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    known = None
    for _ in range(MOST_ROUNDS):
        # a is always above b, so a node's lowest neighbour is found from one side; if it has none below, it is the lowest itself
        low = _lowest(links)
        # large star: a node hands its larger neighbours its lowest
        large = links.join(low, F.col("b") == F.col("u"), "left").select("a", F.coalesce("low", "b").alias("b")).distinct()
        # small star: a node hands its smaller neighbours, and itself, the lowest of them
        low = _lowest(large)
        small = large.join(low, F.col("a") == F.col("u")).select("a", "b", "low")
        links = checkpoint(small.select(F.explode(F.array("a", "b")).alias("a"), F.col("low").alias("b")).where("a <> b").distinct())
        now = links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(20,0)"))).first()
        if now == known:
            break
        known = now
    else:
        raise RuntimeError("components did not settle")
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
