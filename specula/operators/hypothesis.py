"""Hypothesis tests and effect sizes, all from small tables.

``group_moments`` holds count, mean and variance per (group column, level, value column).
``side_counts`` holds, per (group column, value column, value), one count per level; its
running totals give ranks, medians and cumulative distributions at once. Rank sums and U statistics
come from ``rank_cells``, which holds their parts per cell of the value range.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specula.functions import tails
from specula.functions.effects import epsilon_squared, hedges_g, rank_biserial
from specula.functions.probability import shapiro_wilk
from specula.plans.ordered import range_cells, running_totals
from specula.plans.packed import cell_counts, packed_counts
from specula.plans.resample import coin_sums, poisson_sums
from specula.session import settle

PAIR = ["group_col", "value_col"]


def group_values(df: DataFrame, groups: list[str], values: list[str]) -> DataFrame:
    """(group_col, level, value_col, value) for every group and value column."""
    cells = F.array(*[F.struct(F.lit(g).alias("group_col"), F.col(g).cast("string").alias("level"),
                               F.lit(y).alias("value_col"), F.col(y).cast("double").alias("value"))
                      for g in groups for y in values])
    return df.select(F.inline(cells)).filter(F.col("level").isNotNull() & F.col("value").isNotNull())


def group_moments(df: DataFrame, groups: list[str], values: list[str]) -> DataFrame:
    v = F.col("value")
    return group_values(df, groups, values).groupBy(*PAIR, "level").agg(
        F.count(v).alias("n"), F.avg(v).alias("m"), F.var_samp(v).alias("v"),
        F.skewness(v).alias("skew"), F.kurtosis(v).alias("kurt"))


def pairwise(moments: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """All pairs of levels (a < b) of the same group and value column, side by side."""
    keys = keys or PAIR
    rest = [c for c in moments.columns if c not in keys and c != "level"]
    left = moments.select(*keys, F.col("level").alias("a"), *[F.col(c).alias(f"{c}1") for c in rest])
    right = moments.select(*keys, F.col("level").alias("b"), *[F.col(c).alias(f"{c}2") for c in rest])
    return left.join(right, keys).filter("a < b")


def welch_t(moments: DataFrame) -> DataFrame:
    """Unequal-variance t test with Hedges g for every pair of levels."""
    q1, q2 = F.col("v1") / F.col("n1"), F.col("v2") / F.col("n2")
    t = (F.col("m1") - F.col("m2")) / F.sqrt(q1 + q2)
    df = (q1 + q2) ** 2 / (q1 * q1 / (F.col("n1") - 1) + q2 * q2 / (F.col("n2") - 1))
    g = hedges_g(*[F.col(c) for c in ("m1", "v1", "n1", "m2", "v2", "n2")])
    return (pairwise(moments).filter("n1 >= 2 AND n2 >= 2 AND v1 + v2 > 0")
            .select(*PAIR, "a", "b", "n1", "n2", t.alias("t"), df.alias("df"), g["g"].alias("hedges_g"),
                    g["ci_low"].alias("ci_low"), g["ci_high"].alias("ci_high"))
            .withColumn("p", tails.p_t("t", "df")))


def one_way(moments: DataFrame) -> DataFrame:
    """Classic F and Welch's F per group and value column, with eta and omega squared."""
    n, m, v = F.col("n").cast("double"), F.col("m"), F.col("v")
    w = F.when(v > 0, n / v).otherwise(0.0)
    centre = moments.groupBy(*PAIR).agg((F.sum(n * m) / F.sum(n)).alias("grand"), F.sum(w).alias("sw"),
                                        (F.sum(w * m) / F.sum(w)).alias("wm"))
    share = 1 - w / F.col("sw")
    sums = (moments.join(F.broadcast(centre), PAIR).groupBy(*PAIR)
            .agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"),
                 F.sum(n * (m - F.col("grand")) ** 2).alias("ssb"), F.sum((n - 1) * v).alias("ssw"),
                 F.sum(w * (m - F.col("wm")) ** 2).alias("wss"), F.sum(share * share / (n - 1)).alias("lam")))
    k, total = F.col("k"), F.col("n")
    msw = F.col("ssw") / (total - k)
    sst = F.col("ssb") + F.col("ssw")
    den = 1 + 2 * (k - 2) / (k * k - 1) * F.col("lam")
    return (sums.filter("k > 1 AND n > k")
            .select(*PAIR, "k", "n", (F.col("ssb") / (k - 1) / msw).alias("classic_f"),
                    (F.col("wss") / (k - 1) / den).alias("welch_f"), ((k * k - 1) / (3 * F.col("lam"))).alias("df2"),
                    (F.col("ssb") / sst).alias("eta2"),
                    F.greatest(F.lit(0.0), (F.col("ssb") - (k - 1) * msw) / (sst + msw)).alias("omega2"))
            .withColumn("classic_p", tails.p_f("classic_f", F.col("k") - 1, F.col("n") - F.col("k")))
            .withColumn("welch_p", tails.p_f("welch_f", F.col("k") - 1, "df2")))


def games_howell(moments: DataFrame) -> DataFrame:
    """Pairwise comparisons under unequal variances, studentised-range p, Hedges g."""
    sizes = moments.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("k"))
    rows = welch_t(moments).drop("p").join(F.broadcast(sizes), PAIR)
    return rows.withColumn("p", tails.p_studentized_range(F.abs("t") * math.sqrt(2), F.col("k").cast("double"), "df"))


def levels_of(df: DataFrame, groups: list[str], most: int = 64) -> dict[str, list[str]]:
    """The levels of small category columns, as plan parameters; wider columns are refused."""
    from specula.operators.typing import level_counts
    rows = level_counts(df, groups).filter(F.col("value").isNotNull()).select("column", "value")
    sizes = {r["column"]: r["n"] for r in rows.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}
    wide = [g for g in groups if sizes.get(g, 0) > most]
    if wide:
        raise ValueError(f"{wide} have more than {most} levels")
    out: dict[str, list[str]] = {g: [] for g in groups}
    for r in rows.orderBy("column", "value").collect():
        out[r["column"]].append(r["value"])
    return out


def side_counts(df: DataFrame, levels: dict[str, list[str]], values: list[str],
                kept: DataFrame | None = None) -> DataFrame:
    """(group_col, value_col, bucket, value, n0, n1, ...): one count column per level index.

    ``kept`` (group_col, value_col, level) leaves other levels out; it is as small as the levels.
    """
    width = max(len(v) for v in levels.values())
    index = lambda g: F.coalesce(F.lit(None).cast("int"), *[F.when(F.col(g).cast("string") == name, F.lit(j)) for j, name in enumerate(levels[g])])
    wide = df.select(*[index(g).alias(f"_{i}") for i, g in enumerate(levels)], *[F.col(y).cast("double").alias(f"_{y}") for y in values])
    sides = [f"_{i}" for i in range(len(levels))]
    long = (wide.unpivot(sides, [f"_{y}" for y in values], "value_col", "value").filter(F.col("value").isNotNull())
            .unpivot(["value_col", "value"], sides, "group_col", "i").filter(F.col("i").isNotNull()))
    names = F.create_map(*[F.lit(x) for pair in zip(sides, levels) for x in pair])
    long = long.select(names[F.col("group_col")].alias("group_col"), F.substring("value_col", 2, 10**9).alias("value_col"), "value", "i")
    if kept is not None:
        mine = kept.join(_level_table(df, levels), ["group_col", "level"]).select(*PAIR, "i")
        long = long.join(F.broadcast(mine), [*PAIR, "i"], "left_semi")
    counts = long.groupBy(*PAIR, "value").agg(*[F.sum((F.col("i") == j).cast("long")).alias(f"n{j}") for j in range(width)])
    return range_cells(counts, [*PAIR, "value"], df.count() * len(levels) * len(values))


def ranked_sides(df: DataFrame, levels: dict[str, list[str]], values: list[str],
                 kept: DataFrame | None = None) -> DataFrame:
    """Side counts with running totals per level and the average rank over all levels."""
    width = max(len(v) for v in levels.values())
    names = [f"n{j}" for j in range(width)]
    run = running_totals(side_counts(df, levels, values, kept), PAIR, "value", names, few_keys=True)
    add = lambda prefix: sum((F.col(f"{prefix}{c}") for c in names[1:]), F.col(f"{prefix}{names[0]}"))
    return (run.withColumn("n", add("")).withColumn("rank", add("before_") + (F.col("n") + 1) / 2.0)
            .withColumn("total", add("total_")))


def _level_table(df: DataFrame, levels: dict[str, list[str]]) -> DataFrame:
    rows = [(g, i, name) for g, names in levels.items() for i, name in enumerate(names)]
    return F.broadcast(df.sparkSession.createDataFrame(rows, "group_col string, i int, level string"))


def rank_cells(df: DataFrame, levels: dict[str, list[str]], values: list[str], kept: DataFrame | None = None, pairs: bool = False) -> DataFrame:
    """(group_col, value_col, bucket, n, r, ties, size, start): sizes and rank sums per level inside cells of the value range.

    Ranks count from the cell's first value; ``start`` rows lie in earlier cells. ``pairs`` adds ``u`` and ``t``, a row per level: U
    inside the cell and mixed terms of the ties against each level. ``kept`` is as in ``side_counts``.
    """
    width = max(len(v) for v in levels.values())
    wide = df.select(*[F.col(g).cast("string").alias(f"_g{i}") for i, g in enumerate(levels)], *[F.col(y).cast("double").alias(f"_v{i}") for i, y in enumerate(values)])
    numbers = [F.coalesce(F.lit(None).cast("int"), *[F.when(F.col(f"_g{i}") == name, F.lit(j)) for j, name in enumerate(names)]) for i, names in enumerate(levels.values())]
    places = None
    if kept is not None:
        at = {(g, name): (i, j) for i, (g, names) in enumerate(levels.items()) for j, name in enumerate(names)}
        places = {(at[g, name][0], values.index(y), at[g, name][1]) for g, y, name in kept.select(*PAIR, "level").collect() if (g, name) in at}
    counts = packed_counts(wide, [f"_v{i}" for i in range(len(values))], numbers, width, places)

    def sums(key, table):
        import pyarrow as pa
        n, r, ties, u, t = _rank_parts(*cell_counts(table, width), width, pairs)
        rows = {"g": [key[0].as_py()], "v": [key[1].as_py()], "bucket": [key[2].as_py()], "n": [n.astype(np.int64)], "r": [r], "ties": [ties], "u": [u], "t": [t]}
        kinds = [pa.int32()] * 3 + [pa.list_(pa.int64()), pa.list_(pa.float64()), pa.float64()] + [pa.list_(pa.list_(pa.float64()))] * 2
        return pa.table([pa.array([x.tolist() if isinstance(x, np.ndarray) else x for x in c], k) for c, k in zip(rows.values(), kinds)], names=list(rows))
    cells = counts.groupBy("g", "v", "bucket").applyInArrow(
        sums, "g int, v int, bucket int, n array<bigint>, r array<double>, ties double, u array<array<double>>, t array<array<double>>")
    named = lambda names, i: F.get(F.array(*[F.lit(x) for x in names]), F.col(i))
    size = F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x)
    cells = settle(cells.select(named(levels, "g").alias("group_col"), named(values, "v").alias("value_col"), "bucket", "n", "r", "ties", size.alias("size"), "u", "t"))
    return cells.withColumn("start", _earlier(F.col("size")))


def _rank_parts(run: np.ndarray, level: np.ndarray, n: np.ndarray, width: int, pairs: bool) -> tuple[np.ndarray, np.ndarray, float, np.ndarray, np.ndarray]:
    """Of a cell's counts: sizes, rank sums and, with ``pairs``, U and mixed terms of the ties of level i against level j."""
    by_level = lambda x: np.bincount(level, weights=x, minlength=width)
    size = np.bincount(run, weights=n)
    rank = np.cumsum(size) - size + (size + 1) / 2
    u, t = np.zeros((2, width, width if pairs else 0))
    for j in range(u.shape[1]):
        own = np.bincount(run, weights=np.where(level == j, n, 0))
        u[:, j] = by_level(n * (np.cumsum(own) - own / 2)[run])
        t[:, j] = by_level(3 * n * own[run] * (n + own[run]))
        t[j, j] = (own ** 3 - own).sum()
    return by_level(n), by_level(n * rank[run]), float((size ** 3 - size).sum()), u, t


def _earlier(x: Column) -> Column:
    """The sum of ``x`` over the earlier cells of a pair; there is a row per cell only."""
    return F.coalesce(F.sum(x).over(Window.partitionBy(*PAIR).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def rank_sums(cells: DataFrame, levels: dict[str, list[str]]) -> DataFrame:
    """(group_col, value_col, level, n, r): size and rank sum per level, with pair-wide n and ties, from ``rank_cells``."""
    width = max(len(v) for v in levels.values())
    n, r = F.col("n"), F.col("r")
    wide = cells.groupBy(*PAIR).agg(
        F.sum("size").alias("total"), F.sum("ties").alias("ties"),
        *[x for j in range(width) for x in (F.sum(n[j]).alias(f"n{j}"), F.sum(r[j] + F.col("start") * n[j]).alias(f"r{j}"))])
    parts = F.array(*[F.struct(F.lit(j).alias("i"), F.col(f"n{j}").alias("n"), F.col(f"r{j}").alias("r")) for j in range(width)])
    return (wide.select(*PAIR, "total", "ties", F.inline(parts)).filter("n > 0")
            .join(_level_table(cells, levels), ["group_col", "i"]).drop("i"))


def mann_whitney_pairs(cells: DataFrame, levels: dict[str, list[str]]) -> DataFrame:
    """U, z, p and rank-biserial of every pair of levels, each from its own two-sample counts, from ``rank_cells`` with ``pairs``."""
    width = max(len(v) for v in levels.values())
    pairs = list(combinations(range(width), 2))
    n, u, t = F.col("n"), F.col("u"), F.col("t")
    placed = cells.select("*", *[_earlier(n[j]).alias(f"start{j}") for j in range(width)])
    terms = []
    for i, j in pairs:
        terms += [F.sum(u[i][j] + n[i] * F.col(f"start{j}")).alias(f"u{i}_{j}"),
                  F.sum(t[i][i] + t[j][j] + t[i][j]).alias(f"t{i}_{j}")]
    wide = placed.groupBy(*PAIR).agg(*[F.sum(n[j]).alias(f"n{j}") for j in range(width)], *terms)
    rows_of = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"n{i}").alias("n1"), F.col(f"n{j}").alias("n2"),
                                 F.col(f"u{i}_{j}").alias("u"), F.col(f"t{i}_{j}").alias("ties")) for i, j in pairs])
    table = _level_table(cells, levels)
    rows = (wide.select(*PAIR, F.inline(rows_of)).filter("n1 > 0 AND n2 > 0")
            .join(table.withColumnRenamed("level", "a"), ["group_col", "i"])
            .join(table.withColumnRenamed("level", "b").withColumnRenamed("i", "j"), ["group_col", "j"]))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    spread = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    z = F.greatest(F.lit(0.0), (F.greatest(F.col("u"), n1 * n2 - F.col("u")) - n1 * n2 / 2 - 0.5) / spread)
    return (rows.select(*PAIR, "a", "b", "n1", "n2", "u", z.alias("z"), rank_biserial(F.col("u"), n1, n2).alias("rank_biserial"))
            .withColumn("p", F.least(F.lit(1.0), tails.p_normal("z"))))


def kruskal(sums: DataFrame) -> DataFrame:
    """Tie-corrected H, p and epsilon squared per group and value column."""
    n = F.max("total").cast("double")
    h = 12 / (n * (n + 1)) * F.sum(F.col("r") * F.col("r") / F.col("n")) - 3 * (n + 1)
    rows = sums.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("k"), F.max("total").alias("n"),
                                   (h / (1 - F.max("ties") / (n * n * n - n))).alias("h")).filter("k > 1")
    return (rows.withColumn("epsilon2", epsilon_squared(F.col("h"), F.col("n"), F.col("k")))
            .withColumn("p", tails.p_chi2("h", F.col("k") - 1)))


def dunn(sums: DataFrame) -> DataFrame:
    """Pairwise z on mean ranks with tie correction."""
    n = F.col("total1").cast("double")
    spread = n * (n + 1) / 12 - F.col("ties1") / (12 * (n - 1))
    z = (F.col("r1") / F.col("n1") - F.col("r2") / F.col("n2")) / F.sqrt(spread * (1 / F.col("n1") + 1 / F.col("n2")))
    return (pairwise(sums).filter(spread > 0).select(*PAIR, "a", "b", "n1", "n2", z.alias("z"))
            .withColumn("p", tails.p_normal("z")))


def level_medians(ranked: DataFrame, levels: dict[str, list[str]]) -> DataFrame:
    """(group_col, value_col, level, median) from the running totals of each level."""
    width = max(len(v) for v in levels.values())
    aggs = []
    for j in range(width):
        last, spot = F.col(f"before_n{j}") + F.col(f"n{j}"), F.lit(0.5) * (F.col(f"total_n{j}") - 1)
        here = F.col(f"n{j}") > 0
        aggs.append(((F.min(F.when(here & (last > F.floor(spot)), F.col("value")))
                      + F.min(F.when(here & (last > F.ceil(spot)), F.col("value")))) / 2).alias(f"m{j}"))
    cells = F.array(*[F.struct(F.lit(j).alias("i"), F.col(f"m{j}").alias("median")) for j in range(width)])
    return (ranked.groupBy(*PAIR).agg(*aggs).select(*PAIR, F.inline(cells)).filter("median IS NOT NULL")
            .join(_level_table(ranked, levels), ["group_col", "i"]).drop("i"))


def levene(ranked: DataFrame, levels: dict[str, list[str]]) -> DataFrame:
    """Brown-Forsythe: one-way F on distances to the level's median, from the value counts."""
    width = max(len(v) for v in levels.values())
    cells = F.array(*[F.struct(F.lit(j).alias("i"), F.col(f"n{j}").alias("w")) for j in range(width)])
    long = (ranked.select(*PAIR, "value", F.inline(cells)).filter("w > 0")
            .join(_level_table(ranked, levels), ["group_col", "i"])
            .join(F.broadcast(level_medians(ranked, levels)), [*PAIR, "level"])
            .withColumn("d", F.abs(F.col("value") - F.col("median"))))
    d, w = F.col("d"), F.col("w")
    table = long.groupBy(*PAIR, "level").agg(
        F.sum("w").alias("n"), (F.sum(w * d) / F.sum("w")).alias("m"),
        ((F.sum(w * d * d) - F.sum(w * d) * F.sum(w * d) / F.sum("w")) / (F.sum("w") - 1)).alias("v"))
    return one_way(table).select(*PAIR, "k", "n", F.col("classic_f").alias("levene_f"), F.col("classic_p").alias("levene_p"))


def chi_square_from_cells(cells: DataFrame, exact: bool = False) -> DataFrame:
    """Per pair (a, b): chi-square, p, bias-corrected V, least expected count; Fisher for small 2x2, with ``exact`` for any 2x2."""
    pair = ["a", "b"]
    rows = cells.groupBy(*pair, "level_a").agg(F.sum("n").alias("na"))
    cols = cells.groupBy(*pair, "level_b").agg(F.sum("n").alias("nb"))
    side_a = rows.groupBy(*pair).agg(F.count(F.lit(1)).alias("rows"), F.sum("na").alias("n"), F.min("na").alias("least_a"))
    side_b = cols.groupBy(*pair).agg(F.count(F.lit(1)).alias("columns"), F.min("nb").alias("least_b"))
    first = rows.groupBy(*pair).agg(F.min("level_a").alias("ra")).join(cols.groupBy(*pair).agg(F.min("level_b").alias("cb")), pair)
    inner = (cells.withColumnRenamed("n", "k").join(rows, [*pair, "level_a"]).join(cols, [*pair, "level_b"])
             .join(F.broadcast(first), pair).groupBy(*pair)
             .agg(F.sum(F.col("k").cast("double") * F.col("k") / (F.col("na").cast("double") * F.col("nb"))).alias("q"),
                  F.sum(F.when((F.col("level_a") == F.col("ra")) & (F.col("level_b") == F.col("cb")), F.col("k")).otherwise(0)).alias("c11"),
                  F.max(F.when(F.col("level_a") == F.col("ra"), F.col("na"))).alias("r1"),
                  F.max(F.when(F.col("level_b") == F.col("cb"), F.col("nb"))).alias("c1")))
    n, r, c = F.col("n").cast("double"), F.col("rows").cast("double"), F.col("columns").cast("double")
    chi2 = F.greatest(F.lit(0.0), n * (F.col("q") - 1))
    phi = F.greatest(F.lit(0.0), chi2 / n - (r - 1) * (c - 1) / (n - 1))
    rc, cc = r - (r - 1) * (r - 1) / (n - 1), c - (c - 1) * (c - 1) / (n - 1)
    v = F.least(F.lit(1.0), F.sqrt(phi / F.greatest(F.lit(1e-12), F.least(rc, cc) - 1)))
    table = (side_a.join(side_b, pair).join(inner, pair).filter("rows > 1 AND columns > 1")
             .select(*pair, "rows", "columns", "n", chi2.alias("chi2"), v.alias("v"),
                     (F.col("least_a") * F.col("least_b") / n).alias("min_expected"), "c11", "r1", "c1"))
    small = (F.lit(exact) | (F.col("min_expected") < 5)) & (F.col("rows") == 2) & (F.col("columns") == 2)
    other = lambda e: F.when(small, e.cast("double"))
    table = (table.withColumn("used", F.when(small, "fisher").otherwise("chi-square"))
             .withColumn("chi2_p", tails.p_chi2("chi2", (F.col("rows") - 1) * (F.col("columns") - 1)))
             .withColumn("fisher_p", tails.p_fisher(other(F.col("c11")), other(F.col("r1") - F.col("c11")),
                                                    other(F.col("c1") - F.col("c11")),
                                                    other(F.col("n") - F.col("r1") - F.col("c1") + F.col("c11")))))
    return table.withColumn("p", F.coalesce("fisher_p", "chi2_p"))


def ks_from_ranked(ranked: DataFrame) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov, 1-D Wasserstein distance and U of level 0 against level 1."""
    f0 = (F.col("before_n0") + F.col("n0")) / F.col("total_n0")
    f1 = (F.col("before_n1") + F.col("n1")) / F.col("total_n1")
    gaps = next_value(ranked.filter("total_n0 > 0 AND total_n1 > 0"))
    rows = gaps.groupBy(*PAIR).agg(F.max("total_n0").alias("n1"), F.max("total_n1").alias("n2"),
                                   F.max(F.abs(f0 - f1)).alias("ks_d"),
                                   F.sum(F.abs(f0 - f1) * (F.coalesce("next_value", "value") - F.col("value"))).alias("wasserstein"))
    return rows.withColumn("p", tails.p_ks("ks_d", F.col("n1").cast("double"), F.col("n2").cast("double")))


def next_value(ranked: DataFrame) -> DataFrame:
    """Add ``next_value``: the next larger value of the same pair, across bucket borders."""
    heads = ranked.groupBy(*PAIR, "bucket").agg(F.min("value").alias("_head"))
    ends = heads.withColumn("_edge", F.lead("_head").over(Window.partitionBy(*PAIR).orderBy("bucket"))).drop("_head")
    inside = Window.partitionBy(*PAIR, "bucket").orderBy("value")
    return (ranked.join(ends, [*PAIR, "bucket"])
            .withColumn("next_value", F.coalesce(F.lead("value").over(inside), F.col("_edge"))).drop("_edge"))


def psi_numeric(ranked: DataFrame, bins: int = 10) -> DataFrame:
    """Population stability index of level 1 against the quantile bins of level 0."""
    probs = [i / bins for i in range(1, bins)]
    last, here = F.col("before_n0") + F.col("n0"), F.col("n0") > 0
    edges = []
    for i, q in enumerate([0.0, *probs, 1.0]):
        spot = F.lit(q) * (F.col("total_n0") - 1)
        low = F.min(F.when(here & (last > F.floor(spot)), F.col("value")))
        high = F.min(F.when(here & (last > F.ceil(spot)), F.col("value")))
        edges.append((low + F.max(spot - F.floor(spot)) * (high - low)).alias(f"e{i}"))
    table = ranked.groupBy(*PAIR).agg(*edges).select(
        *PAIR, F.array_sort(F.array_distinct(F.array(*[F.col(f"e{i}") for i in range(bins + 1)]))).alias("edges"))
    inner = F.slice("edges", 2, F.greatest(F.size("edges") - 2, F.lit(0)))
    last_bin = F.size("edges") - 2
    bin_of = F.size(F.filter(inner, lambda e: e <= F.col("value")))
    counts = (ranked.filter("total_n0 >= 10 AND total_n1 >= 10").join(F.broadcast(table.filter(F.size("edges") >= 3)), PAIR)
              .groupBy(*PAIR, F.least(bin_of, last_bin).alias("bin"))
              .agg((F.sum("n0") / F.max("total_n0")).alias("e"), (F.sum("n1") / F.max("total_n1")).alias("a"),
                   F.max(last_bin + 1).alias("bins")))
    e, a = F.greatest(F.col("e"), F.lit(1e-6)), F.greatest(F.col("a"), F.lit(1e-6))
    return counts.groupBy(*PAIR).agg(F.sum((a - e) * F.log(a / e)).alias("psi"))


def psi_categorical(df: DataFrame, columns: list[str], expected: Column) -> DataFrame:
    """(column, psi) of the rows outside ``expected`` against those inside, null as a level."""
    from specula.plans.longform import text_long
    marked = df.withColumn("_e", expected.cast("int"))
    counts = (text_long(marked, columns, ["_e"], keep_null=True).groupBy("column", "value")
              .agg(F.sum("_e").alias("e"), F.sum(1 - F.col("_e")).alias("a")))
    totals = counts.groupBy("column").agg(F.sum("e").alias("te"), F.sum("a").alias("ta"))
    e = F.greatest(F.col("e") / F.col("te"), F.lit(1e-6))
    a = F.greatest(F.col("a") / F.col("ta"), F.lit(1e-6))
    return (counts.join(F.broadcast(totals), "column").groupBy("column").agg(F.sum((a - e) * F.log(a / e)).alias("psi")))


def two_proportions(df: DataFrame, label: str, first: Column, min_side: int = 10) -> DataFrame:
    """Difference of two 0/1 rates with a 95% interval, z and odds ratio."""
    y = F.col(label).cast("double")
    row = df.filter(y.isNotNull()).agg(
        F.sum(first.cast("long")).alias("n1"), F.sum((~first).cast("long")).alias("n2"),
        F.sum(F.when(first, y).otherwise(0.0)).alias("x1"), F.sum(F.when(~first, y).otherwise(0.0)).alias("x2"),
        F.bool_and(y.isin(0.0, 1.0)).alias("binary"))
    p1, p2 = F.col("x1") / F.col("n1"), F.col("x2") / F.col("n2")
    se = F.sqrt(p1 * (1 - p1) / F.col("n1") + p2 * (1 - p2) / F.col("n2"))
    pool = (F.col("x1") + F.col("x2")) / (F.col("n1") + F.col("n2"))
    z = (p1 - p2) / F.sqrt(pool * (1 - pool) * (1 / F.col("n1") + 1 / F.col("n2")))
    odds = (F.col("x1") * (F.col("n2") - F.col("x2"))) / (F.col("x2") * (F.col("n1") - F.col("x1")))
    half = 1.96 * F.sqrt(1 / F.col("x1") + 1 / (F.col("n1") - F.col("x1")) + 1 / F.col("x2") + 1 / (F.col("n2") - F.col("x2")))
    return (row.filter(F.col("binary") & (F.col("n1") > min_side) & (F.col("n2") > min_side))
            .select("n1", "n2", p1.alias("rate1"), p2.alias("rate2"), (p1 - p2).alias("difference"),
                    (p1 - p2 - 1.96 * se).alias("ci_low"), (p1 - p2 + 1.96 * se).alias("ci_high"), z.alias("z"),
                    odds.alias("odds_ratio"), F.exp(F.log(odds) - half).alias("or_low"), F.exp(F.log(odds) + half).alias("or_high"))
            .withColumn("p", tails.p_normal("z")))


def normality(df: DataFrame, groups: list[str], values: list[str], small: int = 5000) -> DataFrame:
    """Shapiro-Wilk for levels of at most ``small`` rows, D'Agostino's K-squared above."""
    moments = group_moments(df, groups, values).filter("n >= 8 AND v > 0")
    n = F.col("n").cast("double")
    # skewness test
    y = F.col("skew") * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    beta = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = -1 + F.sqrt(2 * (beta - 1))
    scaled = y / F.sqrt(2 / (w2 - 1))
    z1 = F.log(scaled + F.sqrt(scaled * scaled + 1)) / F.sqrt(0.5 * F.log(w2))
    # kurtosis test
    e = 3 * (n - 1) / (n + 1)
    var = 24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    x = (F.col("kurt") + 3 - e) / F.sqrt(var)
    root = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / root * (2 / root + F.sqrt(1 + 4 / (root * root)))
    den = 1 + x * F.sqrt(2 / (a - 4))
    cube = F.signum(den) * F.pow((1 - 2 / a) / F.abs(den), F.lit(1 / 3))
    z2 = (1 - 2 / (9 * a) - cube) / F.sqrt(2 / (9 * a))
    large = (moments.filter(F.col("n") > small)
             .select(*PAIR, "level", "n", F.lit("dagostino").alias("test"), (z1 * z1 + z2 * z2).alias("statistic"))
             .withColumn("p", tails.p_chi2("statistic", F.lit(2.0))))
    few = moments.filter(F.col("n") <= small).select(*PAIR, "level")
    rows = group_values(df, groups, values).join(F.broadcast(few), [*PAIR, "level"])
    shapiro = rows.groupBy(*PAIR, "level").applyInPandas(
        _shapiro_frame, "group_col string, value_col string, level string, n long, test string, statistic double, p double")
    return large.unionByName(shapiro)


def _shapiro_frame(pdf: pd.DataFrame) -> pd.DataFrame:
    w, p = shapiro_wilk(pdf["value"].to_numpy(dtype=float))
    head = pdf.iloc[0]
    return pd.DataFrame([{"group_col": head["group_col"], "value_col": head["value_col"], "level": head["level"],
                          "n": len(pdf), "test": "shapiro", "statistic": w, "p": p}])


def paired_t(df: DataFrame, a: str, b: str) -> DataFrame:
    """Paired t with d_z and the moments of the differences, for two columns of one row."""
    d = F.col(a).cast("double") - F.col(b).cast("double")
    row = df.select(d.alias("d")).dropna().agg(F.count("d").alias("n"), F.avg("d").alias("mean"), F.stddev_samp("d").alias("sd"),
                                               F.skewness("d").alias("skew"), F.kurtosis("d").alias("kurt"))
    return (row.select("n", "mean", "sd", (F.col("mean") / (F.col("sd") / F.sqrt(F.col("n").cast("double")))).alias("t"),
                       (F.col("mean") / F.col("sd")).alias("dz"), "skew", "kurt")
            .withColumn("p", tails.p_t("t", (F.col("n") - 1).cast("double"))))


def wilcoxon_signed_rank(df: DataFrame, a: str, b: str) -> DataFrame:
    """Signed-rank test of paired columns: zero differences dropped, ties averaged."""
    d = df.select((F.col(a).cast("double") - F.col(b).cast("double")).alias("d")).filter("d <> 0")
    sides = d.select(F.lit("d").alias("g"), (F.col("d") > 0).cast("string").alias("side"), F.abs("d").alias("size"))
    levels = {"side": ["false", "true"]}
    ranked = ranked_sides(sides, levels, ["size"])
    sums = ranked.agg(F.sum(F.col("n1") * F.col("rank")).alias("w_plus"), F.sum(F.col("n0") * F.col("rank")).alias("w_minus"),
                      F.sum("n").alias("n"), F.sum(F.col("n").cast("double") * F.col("n") * F.col("n") - F.col("n")).alias("ties"))
    n = F.col("n").cast("double")
    spread = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48)
    z = (F.least("w_plus", "w_minus") - n * (n + 1) / 4) / spread
    return sums.select("n", "w_plus", "w_minus", z.alias("z")).withColumn("p", tails.p_normal("z"))


def permutation_test(df: DataFrame, value: str, group: Column, row_id: str, reps: int = 200, seed: int = 7) -> DataFrame:
    """Difference of two group means against seeded relabelings.

    Each repetition relabels every row by a coin that keeps the group's expected share
    (``resample.draws``); a task folds its rows into one row of sums per repetition, the first of
    which (0) has the labels as they are. Rows without a value or a side are left out; a side
    without rows in a repetition gives that repetition no difference.
    """
    base = df.select(F.col(row_id).alias("id"), F.col(value).cast("double").alias("y"), group.cast("int").alias("g")).dropna()
    share = base.agg(F.avg("g")).first()[0]
    sums = coin_sums(base, "id", "y", "g", 0.0 if share is None else share, reps, seed)
    side = lambda s, n: F.when(F.col(n) > 0, F.col(s) / F.col(n))
    drawn = sums.select("rep", (side("s1", "n1") - side("s0", "n0")).alias("d"))
    seen = drawn.agg(F.max(F.when(F.col("rep") == 0, F.col("d"))).alias("observed"))
    return (drawn.filter("rep > 0").join(F.broadcast(seen), F.lit(True))
            .agg(F.max("observed").alias("observed"), F.count("d").alias("reps"),
                 ((1 + F.sum((F.abs("d") >= F.abs("observed")).cast("long"))) / (1 + F.count("d"))).alias("p")))


def conditional_mutual_information(df: DataFrame, x: str, y: str, z: str) -> DataFrame:
    """I(x; y | z) in nats over categories, null as a level."""
    from specula.plans.longform import level
    cells = df.groupBy(level(x).alias("x"), level(y).alias("y"), level(z).alias("z")).agg(F.count(F.lit(1)).alias("n"))
    plogp = lambda t, keys: t.groupBy(*keys).agg(F.sum("n").alias("n")).agg(
        F.sum(F.col("n") * F.log(F.col("n").cast("double"))).alias("s"), F.sum("n").alias("t"))
    parts = [plogp(cells, k) for k in (["x", "y", "z"], ["z"], ["x", "z"], ["y", "z"])]
    named = [p.select(F.col("s").alias(f"s{i}"), F.col("t").alias(f"t{i}")) for i, p in enumerate(parts)]
    joined = named[0]
    for p in named[1:]:
        joined = joined.join(p, F.lit(True))
    return joined.select(F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(z).alias("z"), F.col("t0").alias("n"),
                         F.greatest(F.lit(0.0), (F.col("s0") + F.col("s1") - F.col("s2") - F.col("s3")) / F.col("t0")).alias("cmi"))


def bootstrap_interval(df: DataFrame, value: str, row_id: str, reps: int = 2000, seed: int = 7) -> DataFrame:
    """Percentile interval of the mean by the Poisson bootstrap.

    A row's weight in a repetition follows from its draw (``resample.draws``), so the result
    repeats; a task folds its rows into one row of sums per repetition. Rows without a value are
    left out; without rows there are no repetitions and the interval is null.
    """
    base = df.select(F.col(row_id).alias("id"), F.col(value).cast("double").alias("y")).dropna()
    drawn = poisson_sums(base, "id", "y", reps, seed).filter("n > 0").select((F.col("s") / F.col("n")).alias("stat"))
    ends = F.percentile("stat", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975))).alias("q")  # reps rows only
    return (drawn.agg(F.count("stat").alias("reps"), ends)
            .select(F.lit(value).alias("column"), "reps", F.col("q")[0].alias("ci_low"), F.col("q")[1].alias("centre"),
                    F.col("q")[2].alias("ci_high")))
