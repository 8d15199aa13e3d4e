"""Repeatable samples, side labels and order-free digests."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def draw_key(row_id: list[str], seed: int) -> Column:
    """A pseudo-random but repeatable order over row ids."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in row_id]))


def seeded_sample(df: DataFrame, row_id: list[str], n: int, seed: int = 7) -> DataFrame:
    """Exactly n rows in hash order; each task keeps its own n first (top-k, no full sort)."""
    return df.orderBy(draw_key(row_id, seed), *row_id).limit(n)


def subsample_above(df: DataFrame, row_id: list[str], cap: int | None = None, seed: int = 7) -> DataFrame:
    """The whole table unless the caller asks for a cap."""
    return df if cap is None else seeded_sample(df, row_id, cap, seed)


def explorer_extract(df: DataFrame, types: dict[str, str], row_id: list[str], n: int, seed: int = 7) -> DataFrame:
    """A sample for plotting: text columns left out, instants as dates."""
    s = seeded_sample(df, row_id, n, seed)
    return s.select(*[F.date_format(c, "yyyy-MM-dd").alias(c) if k == "datetime" else F.col(c)
                      for c, k in types.items() if k != "text"])


def attach_labels(df: DataFrame, labels: DataFrame, row_id: str) -> DataFrame:
    """Side labels joined by row id; rows without one keep null."""
    return df.join(labels, row_id, "left")


def _quoted(column: str) -> Column:
    return F.col("`" + column.replace("`", "``") + "`")


def row_digest(df: DataFrame) -> DataFrame:
    """Row count with order-free sums of row hashes: equal exactly when two runs agree (up to collisions)."""
    # hashes skip nulls, so a mask of them is hashed too
    mask = F.concat(*[F.when(_quoted(c).isNull(), "n").otherwise("v") for c in df.columns])
    h = F.xxhash64(*[_quoted(c) for c in df.columns], mask)
    return df.agg(F.count(F.lit(1)).alias("rows"), F.bit_xor(h).alias("xor_digest"),
                  F.sum(F.pmod(h, F.lit(1 << 31))).alias("sum_digest"))


def text_digest(df: DataFrame) -> DataFrame:
    """The same idea over md5 of the row's text, which other engines can repeat.

    The sum of 48-bit hashes is exact and given modulo 2**63, so tables of any size have one.
    """
    text = F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("v"), _quoted(c).cast("string")), F.lit("n")) for c in df.columns])
    return df.agg(F.count(F.lit(1)).alias("rows"),
                  (F.sum(F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("decimal(28,0)")) % F.lit(Decimal(1 << 63))).cast("long").alias("digest"))
