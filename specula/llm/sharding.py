"""Shards of bounded size by extendible hashing.

A row's hash is 60 bits of the MD5 digest of its key. A shard is a hash prefix; only prefixes with more bytes than
the limit split on another bit. All levels are decided from sums: bytes are summed once per cell of
the finest level looked at, cells are summed up to their ancestors, and shards are the shortest
prefixes within the limit. Cells that are still too large are looked at again with more bits, and only
their rows. What is shuffled is ids, hashes and sizes, never texts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specula.llm.bpe import _q
from specula.session import settle

BITS, AHEAD = 60, 6


def hash_bits(key: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("bigint")


def shards(df: DataFrame, key: str, size: Column, limit: int) -> DataFrame:
    """(key, bytes, shard, depth, shard_bytes, oversized): the shard of each row.

    ``shard`` is the prefix as zeros and ones, empty if one shard holds everything; ``depth`` its length. Null sizes count
    0 bytes, null keys hash as empty ones. Rows of one hash stay together: a shard of one hash alone may exceed the limit, and
    then ``oversized`` is true; no other shard does. An empty table has no shards.
    """
    rows = settle(df.select(_q(key).alias("key"), F.coalesce(size, F.lit(0)).cast("bigint").alias("bytes"), hash_bits(_q(key)).alias("hash")))
    total = rows.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("n")).first()["n"]
    start, depth = 0, min(BITS, max(0, math.ceil(math.log2(max(total, 1) / limit))) + AHEAD)
    left, found = rows, None
    while True:
        cell = F.shiftright("hash", BITS - depth)
        cells = settle(left.groupBy(cell.alias("cell")).agg(F.sum("bytes").alias("bytes"), F.min("hash").alias("low"), F.max("hash").alias("high")))
        nodes = settle(cells.withColumn("depth", F.explode(F.sequence(F.lit(start), F.lit(depth))))
                       .groupBy("depth", F.expr(f"shiftright(cell, {depth} - depth)").alias("prefix"))
                       .agg(F.sum("bytes").alias("bytes"), F.min("low").alias("low"), F.max("high").alias("high"))
                       .withColumn("done", (F.col("bytes") <= limit) | (F.col("low") == F.col("high")) | (F.col("depth") == BITS)))
        above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("up"), F.col("done").alias("up_done"))
        leaves = (nodes.filter("done").withColumn("up", F.shiftright("prefix", 1)).join(above, ["depth", "up"], "left")
                  .filter(~F.coalesce("up_done", F.lit(False))).select("depth", "prefix", F.col("bytes").alias("shard_bytes")))
        # a shard's cells: the range of numbers under its prefix, kept to those that have rows
        spread = leaves.withColumn("cell", F.explode(F.expr(f"sequence(shiftleft(prefix, {depth} - depth), shiftleft(prefix + 1, {depth} - depth) - 1)")))
        spread = settle(spread)
        part = left.withColumn("cell", cell).join(spread, "cell").select("key", "bytes", "depth", "prefix", "shard_bytes")
        found = part if found is None else found.unionByName(part)
        open_cells = settle(nodes.filter(~F.col("done") & (F.col("depth") == depth)).select(F.col("prefix").alias("cell")))
        if not open_cells.limit(1).count():
            break
        left = settle(left.withColumn("cell", cell).join(open_cells, "cell", "left_semi").drop("cell"))
        start, depth = depth + 1, min(BITS, depth + 2 * AHEAD)
    bits = F.when(F.col("depth") == 0, "").otherwise(F.expr("lpad(conv(prefix, 10, 2), depth, '0')"))
    return found.select("key", "bytes", bits.alias("shard"), "depth", "shard_bytes", (F.col("shard_bytes") > limit).alias("oversized"))
