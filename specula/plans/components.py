"""Connected components by min-label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specula.session import settle_round


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component): the smallest reachable node. Isolated nodes come as self edges.

    Every round keeps stars (node -> smallest known), so long paths shrink by halves; each
    round is checkpointed and the loop ends when no label moves.
    """
    pairs = edges.select(F.col(src).alias("u"), F.col(dst).alias("v"))
    both = settle_round(pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = settle_round(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("label")))
    while True:
        near = (both.join(labels.select(F.col("u").alias("v"), "label"), "v")
                .groupBy("u").agg(F.min("label").alias("near")))
        step = labels.join(near, "u").select("u", F.least("label", "near").alias("label"))
        jump = labels.select(F.col("u").alias("label"), F.col("label").alias("further"))
        nxt = settle_round(step.join(jump, "label", "left")
                     .select("u", F.least("label", F.coalesce("further", "label")).alias("label")))
        moved = nxt.join(labels.withColumnRenamed("label", "old"), "u").filter("label <> old").limit(1).count()
        labels = nxt
        if not moved:
            return labels.select(F.col("u").alias("node"), F.col("label").alias("component"))
