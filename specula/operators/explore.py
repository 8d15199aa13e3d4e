"""Selections and summaries behind an interactive view, on the whole table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specula.operators.typing import level_counts, top_values


def rectangle(df: DataFrame, box: dict[str, tuple]) -> DataFrame:
    """Rows inside the box; plain comparisons that reach the scan."""
    tests = [F.col(c).between(F.lit(lo).cast(df.schema[c].dataType), F.lit(hi).cast(df.schema[c].dataType)) for c, (lo, hi) in box.items()]
    return df.filter(reduce(lambda a, b: a & b, tests))


def selection_summary(selected: DataFrame, numeric: list[str], nominal: list[str], k: int = 5) -> DataFrame:
    """Extremes of numeric columns and the k most frequent values of the others."""
    ends = selected.agg(*[x for i, c in enumerate(numeric) for x in (
        F.count(c).alias(f"n{i}"), F.min(F.col(c).cast("double")).alias(f"l{i}"), F.max(F.col(c).cast("double")).alias(f"h{i}"))])
    rows = ends.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(None).cast("string").alias("value"),
                                                   F.col(f"n{i}").alias("n"), F.col(f"l{i}").alias("low"), F.col(f"h{i}").alias("high"))
                                          for i, c in enumerate(numeric)])))
    tops = top_values(selected, nominal, k).select("column", "value", "n", F.lit(None).cast("double").alias("low"),
                                                   F.lit(None).cast("double").alias("high"))
    return rows.union(tops)


def label_distribution(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def axis_codes(df: DataFrame, axes: dict[str, tuple[str, str]], keep: list[str]) -> DataFrame:
    """Numbers as they are, instants as epoch milliseconds, categories as their sorted index.

    Categories on an axis are few: their sorted list is a plan parameter.
    """
    out = []
    for name, (c, kind) in axes.items():
        if kind == "numeric":
            out.append(F.col(c).cast("double").alias(name))
        elif kind == "datetime":
            out.append((F.unix_micros(F.col(c).cast("timestamp")) / 1000).cast("double").alias(name))
        else:
            names = [r["value"] for r in level_counts(df, [c]).filter("value IS NOT NULL").select("value").orderBy("value").collect()]
            index = F.array_position(F.array(*[F.lit(v) for v in names]), F.col(c).cast("string"))
            out.append((index - 1).cast("double").alias(name))
    return df.select(*keep, *out)
