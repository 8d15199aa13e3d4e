"""Connected components of links in few shuffles a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specula.session import settle


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the smallest node that each node of ``edges`` reaches.

    Each round takes the least label of all neighbours and then that label's own label, so paths shrink by
    halves. Every round is checkpointed; the loop ends when no label moved.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
    both = settle(pairs.union(pairs.select("v", "u")).distinct())
    labels = settle(both.groupBy("u").agg(F.min("v").alias("label")).select("u", F.least("u", "label").alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("u", "v"), "v").select("u", "label", F.lit(None).alias("own"))
        step = near.union(labels.select("u", "label", F.col("label").alias("own"))).groupBy("u").agg(F.min("label").alias("label"), F.max("own").alias("own"))
        further = step.select(F.col("u").alias("label"), F.col("label").alias("further"))
        labels = settle(step.join(further, "label", "left").select("u", F.coalesce("further", "label").alias("label"), "own"))
        if not labels.filter("label <> own").limit(1).count():
            return labels.select(F.col("u").alias("node"), F.col("label").alias("component"))
        labels = labels.drop("own")
