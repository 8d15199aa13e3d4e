"""Positions and lags along an order, without one task per group.

Rows of a key are spread over buckets of the order column, numbered inside their bucket, and
shifted by the rows of earlier buckets. Lags then run over blocks of consecutive positions,
each carrying the last few rows of the block before it.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specula.plans.ordered import bucket_count, bucket_of, cut_points, slices_for

BLOCK = 100_000


def order_buckets(df: DataFrame, order: str, tie: str | None = None) -> Column:
    """An ascending bucket number for (order, tie), both numeric.

    Where one order value repeats among the cut points it holds a large share of the rows;
    its rows are spread further over buckets of the tie column.
    """
    n = bucket_count(df)
    row = df.sample(0.1, seed=7).agg(F.percentile_approx(F.col(order).cast("double"), [i / n for i in range(1, n)], 20 * n).alias("c")).first()
    seen = Counter(row["c"] or [])
    bounds = sorted(seen)
    hot = [v for v, k in seen.items() if k > 1]
    bucket = bucket_of(F.col(order), bounds, slices_for(df))
    if tie is None or not hot:
        return bucket
    ties = cut_points(df.filter(F.col(order).isin(hot)), [tie])[tie]
    width = len(ties) + 2
    sub = F.when(F.col(order).isin(hot), bucket_of(F.col(tie), ties)).otherwise(F.lit(width - 1))
    return bucket * width + sub


def with_position(df: DataFrame, keys: list[str], order: str, tie: str, name: str = "_pos") -> DataFrame:
    """Add the 0-based position of each row along (order, tie) within its key."""
    marked = df.withColumn("_bucket", order_buckets(df, order, tie))
    sizes = marked.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_k"))
    upto = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    starts = sizes.select(*keys, "_bucket", (F.sum("_k").over(upto) - F.col("_k")).alias("_start"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(order, tie)
    numbered = marked.withColumn("_in", F.row_number().over(inside) - 1)
    return (numbered.join(starts, [*keys, "_bucket"])
            .withColumn(name, (F.col("_start") + F.col("_in")).cast("long")).drop("_bucket", "_start", "_in"))


def with_lags(positioned: DataFrame, keys: list[str], shifts: dict[str, tuple[str, int]], position: str = "_pos",
              block: int = BLOCK) -> DataFrame:
    """Add columns holding a value some positions earlier: {name: (column, lag)}; lags are positive."""
    reach = max(lag for _, lag in shifts.values())
    block = max(block, 2 * reach)
    here = F.floor(F.col(position) / block)
    homes = F.when(F.col(position) % block >= block - reach, F.array(here, here + 1)).otherwise(F.array(here))
    spread = positioned.withColumn("_block", F.explode(homes))
    w = Window.partitionBy(*keys, "_block").orderBy(position)
    for name, (column, lag) in shifts.items():
        spread = spread.withColumn(name, F.lag(column, lag).over(w))
    return spread.filter(F.col("_block") == here).drop("_block")
