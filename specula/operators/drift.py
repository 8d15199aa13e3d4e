"""How a first part differs from all the rest, column by column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specula.functions.effects import benjamini_hochberg
from specula.operators import hypothesis
from specula.plans.longform import contingency


def _sides(df: DataFrame, first: Column) -> tuple[DataFrame, dict[str, list[str]]]:
    return df.withColumn("_side", F.when(first, "first").otherwise("rest")), {"_side": ["first", "rest"]}


def numeric_drift(df: DataFrame, columns: list[str], first: Column, least: int = 10) -> DataFrame:
    """KS distance, its p, PSI and Wasserstein distance per numeric column, from one value-count table."""
    marked, levels = _sides(df, first)
    ranked = hypothesis.ranked_sides(marked, levels, columns)
    ks = hypothesis.ks_from_ranked(ranked).filter((F.col("n1") >= least) & (F.col("n2") >= least))
    return (ks.join(hypothesis.psi_numeric(ranked), hypothesis.PAIR, "left")
            .select(F.col("value_col").alias("column"), "n1", "n2", "ks_d", "p", "wasserstein", "psi"))


def nominal_drift(df: DataFrame, columns: list[str], first: Column) -> DataFrame:
    """Chi-square, bias-corrected V and PSI per category column."""
    marked, _ = _sides(df, first)
    table = hypothesis.chi_square_from_cells(contingency(marked, [("_side", c) for c in columns]))
    return (table.withColumnRenamed("b", "column").join(F.broadcast(hypothesis.psi_categorical(df, columns, first)), "column")
            .select("column", "n", "chi2", F.col("chi2_p").alias("p"), F.col("v").alias("cramers_v"), "min_expected", "psi"))


def drift_report(df: DataFrame, numeric: list[str], nominal: list[str], first: Column, limit: float = 0.25) -> DataFrame:
    """One verdict per column, adjusted over the family; compared sides are first and rest."""
    num = numeric_drift(df, numeric, first).select("column", F.lit("ks+psi").alias("measure"), F.col("ks_d").alias("statistic"), "p", "psi")
    nom = nominal_drift(df, nominal, first).select("column", F.lit("chi2+psi").alias("measure"), F.col("chi2").alias("statistic"), "p", "psi")
    out = num.union(nom).withColumn("drifted", F.coalesce(F.col("psi") > limit, F.lit(False)))
    return benjamini_hochberg(out, order=["column"])


def label_rate_drift(df: DataFrame, label: str, first: Column) -> DataFrame:
    return hypothesis.two_proportions(df, label, first).select(
        F.col("rate1").alias("first_rate"), F.col("rate2").alias("rest_rate"), "difference", "ci_low", "ci_high")
