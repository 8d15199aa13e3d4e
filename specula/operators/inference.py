"""Which groups differ and which categories go together, with assumptions checked first."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from specula.functions.effects import benjamini_hochberg, holm
from specula.operators import hypothesis
from specula.operators.hypothesis import PAIR
from specula.operators.typing import level_counts
from specula.plans.longform import contingency


def eligible(df: DataFrame, groups: list[str], values: list[str], most_levels: int = 12,
             least_values: int = 5) -> tuple[list[str], list[str]]:
    """Group columns of 2 to 12 levels and value columns of more than 5 distinct values.

    The limits are far from the estimate's error, which is a few percent.
    """
    row = df.agg(*[F.approx_count_distinct(c, 0.01).alias(c) for c in dict.fromkeys([*groups, *values])]).first()
    return [g for g in groups if 2 <= row[g] <= most_levels], [v for v in values if row[v] > least_values]


def _kept_levels(df: DataFrame, groups: list[str], values: list[str], least: int, least_rows: int) -> DataFrame:
    moments = hypothesis.group_moments(df, groups, values).filter(F.col("n") >= least)
    per = Window.partitionBy(*PAIR)  # levels of small category columns only
    return (moments.withColumn("_k", F.count(F.lit(1)).over(per)).withColumn("_n", F.sum("n").over(per))
            .filter((F.col("_k") >= 2) & (F.col("_n") >= least_rows)).drop("_k", "_n"))


def normal_enough(df: DataFrame, kept: DataFrame, groups: list[str], values: list[str], alpha: float = 0.05) -> DataFrame:
    """(group_col, value_col, norm_ok): every level has 30 rows or passes Shapiro-Wilk.

    Only levels below 30 rows are ever handed to the test.
    """
    few = kept.filter("n >= 8 AND n < 30 AND v > 0").select(*PAIR, "level")
    rows = hypothesis.group_values(df, groups, values).join(F.broadcast(few), [*PAIR, "level"], "left_semi")
    bad = (rows.groupBy(*PAIR, "level").applyInPandas(
        hypothesis._shapiro_frame, "group_col string, value_col string, level string, n long, test string, statistic double, p double")
        .filter(F.col("p") <= alpha).select(*PAIR).distinct().withColumn("bad", F.lit(True)))
    return (kept.select(*PAIR).distinct().join(F.broadcast(bad), PAIR, "left")
            .select(*PAIR, F.col("bad").isNull().alias("norm_ok")))


def numeric_by_nominal(df: DataFrame, groups: list[str], values: list[str], alpha: float = 0.05, keep: int | None = None) -> DataFrame:
    """One assumption-checked test per group and value column, adjusted over the whole family.

    Two levels: Welch's t, or Mann-Whitney when a small level is not normal. More levels:
    Welch's ANOVA, or Kruskal-Wallis.
    """
    groups, values = eligible(df, groups, values)
    levels = hypothesis.levels_of(df, groups)
    kept = _kept_levels(df, groups, values, 5, 20)
    ok = normal_enough(df, kept, groups, values, alpha)
    ranked = hypothesis.ranked_sides(df, levels, values, kept.select(*PAIR, "level"))
    cells = hypothesis.rank_cells(df, levels, values, kept, pairs=True)
    sums = hypothesis.rank_sums(cells, levels)
    shape = lambda t, test, stat, p, effect, name: t.select(
        *PAIR, F.lit(test).alias("test"), F.col(stat).alias("statistic"), F.col(p).alias("p"),
        F.lit(name).alias("effect_name"), F.col(effect).alias("effect"))
    sizes = kept.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), (F.min("n") < 30).alias("small_groups"))
    two = sizes.filter("k = 2").select(*PAIR)
    many = sizes.filter("k > 2").select(*PAIR)
    some = lambda t, which: t.join(F.broadcast(which), PAIR, "left_semi")
    parametric = (shape(some(hypothesis.welch_t(kept), two), "welch-t", "t", "p", "hedges_g", "hedges_g")
                  .union(shape(some(hypothesis.one_way(kept), many), "welch-anova", "welch_f", "welch_p", "omega2", "omega_squared")))
    by_rank = (shape(some(hypothesis.mann_whitney_pairs(cells, levels), two), "mann-whitney", "u", "p", "rank_biserial", "rank_biserial")
               .union(shape(some(hypothesis.kruskal(sums), many), "kruskal-wallis", "h", "p", "epsilon2", "epsilon_squared")))
    chosen = (parametric.withColumn("wants", F.lit(True)).union(by_rank.withColumn("wants", F.lit(False)))
              .join(F.broadcast(ok), PAIR).filter(F.col("wants") == F.col("norm_ok")).drop("wants"))
    spread = hypothesis.levene(ranked, levels).select(*PAIR, "levene_p")
    out = chosen.join(F.broadcast(sizes), PAIR).join(F.broadcast(spread), PAIR, "left")
    out = benjamini_hochberg(out, order=PAIR).orderBy("p_adj", *PAIR)
    return out.limit(keep) if keep else out


def contrasts(df: DataFrame, groups: list[str], values: list[str], alpha: float = 0.05, keep: int = 12) -> DataFrame:
    """Pairwise level comparisons: Games-Howell, or Dunn when normality fails; Holm on top of either."""
    groups, values = eligible(df, groups, values)
    levels = hypothesis.levels_of(df, groups)
    kept = _kept_levels(df, groups, values, 5, 20)
    ok = normal_enough(df, kept, groups, values, alpha)
    cells = hypothesis.rank_cells(df, levels, values, kept, pairs=True)
    gh = hypothesis.games_howell(kept).select(*PAIR, "a", "b", F.lit("games-howell").alias("test"), F.col("t").alias("statistic"),
                                         "p", F.col("hedges_g").alias("effect"))
    ranks = hypothesis.mann_whitney_pairs(cells, levels).select(*PAIR, "a", "b", F.col("rank_biserial").alias("effect"))
    dn = (hypothesis.dunn(hypothesis.rank_sums(cells, levels)).select(*PAIR, "a", "b", F.lit("dunn").alias("test"),
                                                             F.col("z").alias("statistic"), "p")
          .join(ranks, [*PAIR, "a", "b"]))
    both = gh.withColumn("wants", F.lit(True)).unionByName(dn.withColumn("wants", F.lit(False)))
    rows = both.join(F.broadcast(ok), PAIR).filter(F.col("wants") == F.col("norm_ok")).drop("wants", "norm_ok")
    adjusted = holm(rows, family=PAIR, order=["a", "b"])
    first = F.row_number().over(Window.partitionBy(*PAIR).orderBy("p_holm", "a", "b"))
    return adjusted.withColumn("_r", first).filter(F.col("_r") <= keep).drop("_r")


def nominal_by_nominal(df: DataFrame, columns: list[str], keep: int | None = None) -> DataFrame:
    """Chi-square, or Fisher for small 2x2 tables, over all pairs; adjusted over the family."""
    table = hypothesis.chi_square_from_cells(contingency(df, list(combinations(columns, 2))))
    out = benjamini_hochberg(table, order=["a", "b"]).orderBy("p_adj", "a", "b")
    return out.limit(keep) if keep else out


def label_balance(df: DataFrame, label: str, top: int = 12) -> DataFrame:
    """(value, n, share, minority_share, baseline_accuracy): the most frequent label values."""
    counts = level_counts(df, [label]).filter("value IS NOT NULL").select("value", "n")
    totals = counts.agg(F.sum("n").alias("t"), F.min("n").alias("lo"), F.max("n").alias("hi"), F.count(F.lit(1)).alias("k"))
    return (counts.join(F.broadcast(totals), F.lit(True)).orderBy(F.col("n").desc(), "value").limit(top)
            .select("value", "n", (F.col("n") / F.col("t")).alias("share"),
                    F.when(F.col("k") > 1, F.col("lo") / F.col("t")).alias("minority_share"),
                    (F.col("hi") / F.col("t")).alias("baseline_accuracy")))
