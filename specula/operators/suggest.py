"""Which transform would straighten a skewed column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specula.operators.profile import moments
from specula.operators.shaping.values import as_numbers, best_lambda


def transform_suggestions(df: DataFrame, columns: list[str], least: float = 1.0) -> DataFrame:
    """(column, kind, skew, lambda, skew_after) for columns whose population skew exceeds ``least``."""
    facts = {r["column"]: r for r in moments(df, columns).collect()}
    skewed = [c for c in columns if c in facts and abs(facts[c]["skew_pop"] or 0) > least]
    positive = [c for c in skewed if facts[c]["min"] > 0]
    numbers = as_numbers(df, columns)
    lam = best_lambda(numbers, positive, "box-cox") if positive else {}
    after = numbers.agg(*[F.skewness(F.log1p(F.col(c) - facts[c]["min"])).alias(c) for c in positive]).first() if positive else {}
    rows = [(c, "box-cox" if c in positive else "log1p" if facts[c]["min"] >= 0 else "yeo-johnson", facts[c]["skew_pop"],
             lam.get(c), after[c] if c in positive else None) for c in skewed]
    return df.sparkSession.createDataFrame(rows, "column string, kind string, skew double, lambda double, skew_after double")
