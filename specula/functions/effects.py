"""Effect sizes and multiple-test corrections as column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hedges_g(m1: Column, v1: Column, n1: Column, m2: Column, v2: Column, n2: Column) -> dict[str, Column]:
    """Standardised mean difference with the small-sample correction and a 95% interval."""
    pooled = F.sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2))
    d = F.when(pooled > 0, (m1 - m2) / pooled).otherwise(F.lit(0.0))
    g = d * (1 - 3 / (4 * (n1 + n2) - 9))
    se = F.when(pooled > 0, F.sqrt((n1 + n2) / (n1 * n2) + d * d / (2 * (n1 + n2))))
    return {"g": g, "ci_low": g - 1.96 * se, "ci_high": g + 1.96 * se}


def rank_biserial(u: Column, n1: Column, n2: Column) -> Column:
    return 2 * u / (n1 * n2) - 1


def epsilon_squared(h: Column, n: Column, k: Column) -> Column:
    return F.when(n > k, F.greatest(F.lit(0.0), (h - k + 1) / (n - k)))


def fisher_z_interval(r: Column, n: Column) -> tuple[Column, Column]:
    z = F.atanh(r)
    half = 1.96 / F.sqrt(n - 3)
    usable = (F.abs(r) < 1) & (n > 4)
    return F.when(usable, F.tanh(z - half)), F.when(usable, F.tanh(z + half))


def benjamini_hochberg(df: DataFrame, p: str = "p", family: list[str] | None = None,
                       order: list[str] | None = None, out: str = "p_adj") -> DataFrame:
    """Step-up false-discovery adjustment within each family of tests (a small table)."""
    return _adjust(df, p, family, order, out, step_up=True)


def holm(df: DataFrame, p: str = "p", family: list[str] | None = None,
         order: list[str] | None = None, out: str = "p_holm") -> DataFrame:
    """Step-down family-wise adjustment within each family of tests (a small table)."""
    return _adjust(df, p, family, order, out, step_up=False)


def _adjust(df, p, family, order, out, step_up):
    family = family or []
    keys = [F.col(c) for c in family] or [F.lit(0)]
    by = Window.partitionBy(*keys)
    known = F.coalesce(F.nanvl(F.col(p), F.lit(1.0)), F.lit(1.0))
    ranked = df.withColumn("_p", known)
    asc = by.orderBy(F.col("_p"), *[F.col(c) for c in (order or [])])
    ranked = (ranked.withColumn("_i", F.row_number().over(asc))
              .withColumn("_m", F.count(F.lit(1)).over(by)))
    if step_up:
        raw = F.col("_p") * F.col("_m") / F.col("_i")
        adjusted = F.min(raw).over(by.orderBy(F.col("_i").desc()))
    else:
        raw = F.col("_p") * (F.col("_m") - F.col("_i") + 1)
        adjusted = F.max(raw).over(by.orderBy("_i"))
    return ranked.withColumn(out, F.least(F.lit(1.0), F.greatest(F.lit(0.0), adjusted))).drop("_p", "_i", "_m")
