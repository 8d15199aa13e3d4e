"""Unpivoted tables: one row per (column, value), so one job serves every column or pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NULL_LEVEL = "<null>"


def rnd(expr: Column, digits: int = 6) -> Column:
    """Round, and turn negative zero into zero."""
    return F.round(expr, digits) + F.lit(0.0)


def level(name: str) -> Column:
    """The column as a category: null is a level of its own."""
    return F.coalesce(F.col(name).cast("string"), F.lit(NULL_LEVEL))


def numeric_long(df: DataFrame, columns: list[str], ids: list[str] | None = None) -> DataFrame:
    """(ids, column, value double) with nulls and NaN left out."""
    ids = ids or []
    wide = df.select(*ids, *[F.col(c).cast("double").alias(c) for c in columns])
    return (wide.unpivot(ids, columns, "column", "value")
            .filter(F.col("value").isNotNull() & ~F.isnan("value")))


def text_long(df: DataFrame, columns: list[str], ids: list[str] | None = None,
              keep_null: bool = False) -> DataFrame:
    """(ids, column, value string)."""
    ids = ids or []
    wide = df.select(*ids, *[(level(c) if keep_null else F.col(c).cast("string")).alias(c)
                             for c in columns])
    return wide.unpivot(ids, columns, "column", "value")


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, n) over every column in one shuffle; null keeps its own row."""
    return text_long(df, columns).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def contingency(df: DataFrame, pairs: list[tuple[str, str]], levels: dict[str, Column] | None = None,
                extra: list[str] | None = None) -> DataFrame:
    """(a, b, level_a, level_b, n) for every pair of columns in one shuffle.

    ``levels`` gives another category expression for a column (bins, months);
    ``extra`` columns are carried as further grouping keys.
    """
    levels, extra = levels or {}, extra or []
    cells = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"),
                               levels.get(a, level(a)).alias("level_a"),
                               levels.get(b, level(b)).alias("level_b")) for a, b in pairs])
    return (df.select(*extra, F.inline(cells))
            .groupBy("a", "b", *extra, "level_a", "level_b").agg(F.count(F.lit(1)).alias("n")))
