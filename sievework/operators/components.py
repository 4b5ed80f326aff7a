"""Connected components by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.session import cut, discard, shuffled


def min_label_components(vertices: DataFrame, edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(id, component): component is the smallest id; edges are read as undirected.

    Alternates large-star and small-star steps (Kiveris et al. 2014). Neighbour minima are
    aggregated before any join, and each round keeps at most the edges of the one before.
    """
    pairs = cut(
        edges.filter("src <> dst")
        .select(F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi")).distinct()
    )
    mark = None
    for _ in range(max_rounds):
        # Large star: every larger neighbour of a node points at the node's minimum.
        both = pairs.select(F.col("lo").alias("u"), F.col("hi").alias("v")).unionByName(
            pairs.select(F.col("hi").alias("u"), F.col("lo").alias("v"))
        )
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            both.filter("v > u").join(shuffled(low), "u").filter("v <> m")
            .select(F.col("m").alias("lo"), F.col("v").alias("hi")).distinct()
        )
        # Small star: a node and its smaller neighbours point at the smallest of them.
        small_low = large.groupBy(F.col("hi").alias("u")).agg(F.min("lo").alias("m"))
        moved = large.join(shuffled(small_low), F.col("hi") == F.col("u")).select("lo", "m").filter("lo <> m").select(
            F.col("m").alias("lo"), F.col("lo").alias("hi")
        )
        kept = small_low.select(F.col("m").alias("lo"), F.col("u").alias("hi"))
        before, pairs = pairs, cut(moved.unionByName(kept).distinct())
        discard(before)
        now = pairs.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("lo", "hi")).alias("x")).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    return vertices.select("id").join(shuffled(pairs), F.col("id") == F.col("hi"), "left").select(
        "id", F.coalesce("lo", "id").alias("component")
    )
