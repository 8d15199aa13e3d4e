"""Association between columns of any types, over all pairs in shared jobs."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specula.functions import tails
from specula.functions.effects import benjamini_hochberg, fisher_z_interval
from specula.plans.gram import gram
from specula.plans.longform import contingency, level, numeric_long
from specula.session import settle
from specula.plans.ordered import (average_rank, bucket_of, cut_points, exact_quantiles, ranked_counts,
                                   running_totals, slices_for, spread_lookup)

NUMERIC = ("numeric", "ordinal", "boolean")
CELL = 100_000    # rows of one value from which kendall gives it a cell of its own; other cells have less than twice as many
MOST_CELLS = 5000  # cells per column; beyond that times CELL rows, cells grow with the table


def bin_edges(df: DataFrame, columns: list[str], bins: int = 10) -> dict[str, list[float]]:
    """Exact quantile edges with repeats dropped."""
    probs = [i / bins for i in range(bins + 1)]
    return {c: sorted({q for q in qs if q is not None}) for c, qs in exact_quantiles(df, columns, probs).items()}


def right_closed_bin(value: Column, edges: list[float]) -> Column:
    """Index of the right-closed interval, counting inner edges strictly below the value."""
    index = F.lit(0)
    for e in edges[1:-1]:
        index = index + (value > F.lit(float(e))).cast("int")
    return F.when(value.isNotNull(), index)


def discrete_levels(df: DataFrame, types: dict[str, str], bins: int = 10) -> dict[str, Column]:
    """The category each column contributes to contingency tables: bins, months or text."""
    edges = bin_edges(df, [c for c, t in types.items() if t == "numeric"], bins) if "numeric" in types.values() else {}
    out = {}
    for c, t in types.items():
        if t == "numeric":
            out[c] = F.coalesce(right_closed_bin(F.col(c).cast("double"), edges[c]).cast("string"), F.lit("<null>"))
        elif t == "datetime":
            out[c] = F.coalesce(F.date_format(F.col(c), "yyyy-MM"), F.lit("<null>"))
        else:
            out[c] = level(c)
    return out


def pair_cells(df: DataFrame, types: dict[str, str], bins: int = 10) -> DataFrame:
    """(a, b, level_a, level_b, n) for all pairs of typed columns."""
    return contingency(df, list(combinations(types, 2)), discrete_levels(df, types, bins))


def cell_measures(cells: DataFrame) -> DataFrame:
    """Normalised mutual information, chi-square and Cramer's V per pair from its cells."""
    pair = ["a", "b"]
    rows = cells.groupBy(*pair, "level_a").agg(F.sum("n").alias("na"))
    cols = cells.groupBy(*pair, "level_b").agg(F.sum("n").alias("nb"))
    na, nb = F.col("na").cast("double"), F.col("nb").cast("double")
    side_a = rows.groupBy(*pair).agg(F.count(F.lit(1)).alias("rows"), F.sum("na").alias("n"), F.sum(na * F.log(na)).alias("la"))
    side_b = cols.groupBy(*pair).agg(F.count(F.lit(1)).alias("columns"), F.sum(nb * F.log(nb)).alias("lb"))
    n = F.col("n").cast("double")
    inner = (cells.withColumnRenamed("n", "k").join(rows, [*pair, "level_a"]).join(cols, [*pair, "level_b"])
             .groupBy(*pair).agg(F.sum(F.col("k") * F.col("k") / (na * nb)).alias("q"),
                                 F.sum(F.col("k") * F.log(F.col("k").cast("double"))).alias("lk")))
    ha, hb = F.log(n) - F.col("la") / n, F.log(n) - F.col("lb") / n
    joint = F.log(n) - F.col("lk") / n
    least = F.least("rows", "columns")
    chi2 = n * (F.col("q") - 1)
    return (side_a.join(side_b, pair).join(inner, pair)
            .select(*pair, F.col("n"), "rows", "columns",
                    F.when((ha > 1e-12) & (hb > 1e-12), (ha + hb - joint) / F.sqrt(ha * hb)).otherwise(0.0).alias("nmi"),
                    F.greatest(chi2, F.lit(0.0)).alias("chi2"),
                    F.when(least > 1, F.sqrt(F.greatest(chi2, F.lit(0.0)) / (n * (least - 1)))).otherwise(0.0).alias("cramers_v")))


def pearson_pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, pearson) on the rows where both are known."""
    pairs = list(combinations(columns, 2))
    x = {c: F.col(c).cast("double") for c in columns}
    row = df.agg(*[F.corr(x[a], x[b]).alias(f"p{i}") for i, (a, b) in enumerate(pairs)])
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"p{i}").alias("pearson")) for i, (a, b) in enumerate(pairs)])))


def rank_columns(df: DataFrame, columns: list[str], keep: list[str] | None = None) -> DataFrame:
    """The rows with every listed column replaced by its average rank; others in ``keep``.

    Ranks come from value counts and return to the rows column by column: those of few values by
    broadcast, the others by a lookup that spreads hot values and whose tasks stay small.
    """
    keep = keep or []
    table = settle(ranked_counts(df, columns).select("column", "value", "n", "total_n", average_rank().alias("rank")))
    rows = df.select(*keep, *[F.col(c).cast("double").alias(c) for c in columns])
    for c in columns:
        mine = table.filter(F.col("column") == c).select(F.col("value").alias(c), "n", "total_n", F.col("rank").alias(f"_rank_{c}"))
        rows = spread_lookup(rows, mine, [c], [f"_rank_{c}"], "n")
    return rows.select(*keep, *[F.col(f"_rank_{c}").alias(c) for c in columns])


def spearman_pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, spearman) on pairwise complete rows.

    Columns without gaps share one rank table; a pair with gaps ranks its own complete rows.
    """
    gaps = df.agg(*[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in columns]).first()
    whole = [c for c in columns if not gaps[c]]
    out = None
    if len(whole) > 1:
        out = pearson_pairs(rank_columns(df, whole), whole)
    for a, b in combinations(columns, 2):
        if gaps[a] or gaps[b]:
            sub = df.select(a, b).dropna()
            one = pearson_pairs(rank_columns(sub, [a, b]), [a, b])
            out = one if out is None else out.union(one)
    return out.withColumnRenamed("pearson", "spearman")


def correlation_ratios(df: DataFrame, numeric: list[str], categories: dict[str, Column]) -> DataFrame:
    """(category, column, eta2): between-group over total sum of squares, null as a category."""
    cells = F.array(*[F.struct(F.lit(g).alias("category"), F.lit(y).alias("column"), e.alias("level"),
                               F.col(y).cast("double").alias("value")) for g, e in categories.items() for y in numeric])
    groups = (df.select(F.inline(cells)).filter(F.col("value").isNotNull())
              .groupBy("category", "column", "level")
              .agg(F.count("value").alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v")))
    totals = groups.groupBy("category", "column").agg(
        F.sum("n").alias("t"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("g"), F.count(F.lit(1)).alias("k"))
    between = F.sum(F.col("n") * (F.col("m") - F.col("g")) ** 2)
    within = F.sum(F.col("n") * F.col("v"))
    return (groups.join(F.broadcast(totals), ["category", "column"]).groupBy("category", "column")
            .agg(F.when(F.max("k") > 1, F.when(between + within > 0, between / (between + within))).alias("eta2"))
            .select("category", "column", F.coalesce("eta2", F.lit(0.0)).alias("eta2")))


def dependency_matrix(df: DataFrame, types: dict[str, str], bins: int = 10) -> DataFrame:
    """Every pair with the measures its types allow: nmi always, then r and rho, eta2, or V."""
    columns = {c: t for c, t in types.items() if t not in ("id", "constant", "text")}
    levels = discrete_levels(df, columns, bins)
    measures = cell_measures(contingency(df, list(combinations(columns, 2)), levels))
    numeric = [c for c, t in columns.items() if t in NUMERIC]
    other = [c for c in columns if c not in numeric]
    if len(numeric) > 1:
        both = pearson_pairs(df, numeric).join(spearman_pairs(df, numeric), ["a", "b"])
    else:
        both = df.sparkSession.createDataFrame([], "a string, b string, pearson double, spearman double")
    if numeric and other:
        ratios = correlation_ratios(df, numeric, {c: levels[c] for c in other})
        order = {c: i for i, c in enumerate(columns)}
        pos = F.create_map(*[F.lit(x) for kv in order.items() for x in kv])
        first = pos[F.col("category")] < pos[F.col("column")]
        ratios = ratios.select(F.when(first, F.col("category")).otherwise(F.col("column")).alias("a"),
                               F.when(first, F.col("column")).otherwise(F.col("category")).alias("b"), "eta2")
    else:
        ratios = df.sparkSession.createDataFrame([], "a string, b string, eta2 double")
    nominal = F.col("a").isin(other) & F.col("b").isin(other)
    return (measures.join(F.broadcast(both), ["a", "b"], "left").join(F.broadcast(ratios), ["a", "b"], "left")
            .select("a", "b", "nmi", "pearson", "spearman", "eta2", F.when(nominal, F.col("cramers_v")).alias("cramers_v")))


def strong_pairs(matrix: DataFrame) -> DataFrame:
    # The thresholds above which a pair counts as strongly dependent.
    return matrix.filter((F.col("nmi") >= 0.5) | (F.abs("pearson") >= 0.9) | (F.col("eta2") >= 0.8)
                         | (F.col("cramers_v") >= 0.8))


def concordance(points: DataFrame, keys: list[str], rank: str, value: str, bits: int,
                weight: str | None = None) -> DataFrame:
    """Concordant and discordant pairs per key, counted without forming pairs.

    ``rank`` is a whole number below 2**bits. Two rows with different ranks first part at one
    bit: there, one is in the left and one in the right half of the same node. So every row
    enters one node per bit, and per node a running count over the values gives how many
    left rows lie below or above each right row.
    """
    cuts = cut_points(points, [value])[value]
    collapsed = points.groupBy(*keys, rank, value).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("n"))
    placed = (collapsed.withColumn("bucket", bucket_of(F.col(value), cuts, slices_for(points)))
              .withColumn("bit", F.explode(F.sequence(F.lit(0), F.lit(bits - 1))))
              .withColumn("node", F.expr(f"shiftright({rank}, bit + 1)"))
              .withColumn("right", F.expr(f"shiftright({rank}, bit) & 1") == 1))
    counts = placed.groupBy(*keys, "bit", "node", "bucket", value).agg(
        F.sum(F.when(F.col("right"), 0).otherwise(F.col("n"))).alias("l"),
        F.sum(F.when(F.col("right"), F.col("n")).otherwise(0)).alias("r"))
    run = running_totals(counts, [*keys, "bit", "node"], value, ["l"])
    whole = lambda c: c.cast("decimal(19,0)")  # noqa: E731  pair counts pass 2**63 from some billions of rows on
    sums = [F.sum(whole(F.col("r")) * whole(F.col("before_l"))).alias("concordant"),
            F.sum(whole(F.col("r")) * whole(F.col("total_l") - F.col("before_l") - F.col("l"))).alias("discordant")]
    return run.groupBy(*keys).agg(*sums) if keys else run.agg(*sums)


def tie_sums(counts: DataFrame, column: str) -> DataFrame:
    """One row: n and the tie sums of a column's value counts, suffixed with its name."""
    n = F.col("n").cast("double")
    return counts.filter(F.col("column") == column).agg(
        F.sum("n").alias(f"n_{column}"), F.sum(n * (n - 1) / 2).alias(f"t_{column}"),
        F.sum(n * (n - 1) * (n - 2)).alias(f"t0_{column}"), F.sum(n * (n - 1) * (2 * n + 5)).alias(f"t1_{column}"))


def count_pairs(x: np.ndarray, y: np.ndarray) -> tuple[int, int]:
    """Concordant and discordant pairs of the rows of one cell, by merging sorted blocks."""
    m = len(x)
    order = np.lexsort((y, x))
    x, rank = x[order], np.unique(y[order], return_inverse=True)[1].astype(np.int64)
    base, at, crossed, width = m + 1, np.arange(m), 0, 1

    def tied(values: np.ndarray) -> int:
        k = np.unique(values, return_counts=True)[1]
        return int((k * (k - 1) // 2).sum())
    place = np.unique(x, return_inverse=True)[1].astype(np.int64)
    ties = tied(place) + tied(rank) - tied(place * base + rank)
    while width < m:
        start = at // (2 * width) * base
        right = at // width % 2 == 1
        key = start + rank
        crossed += int(np.searchsorted(key[right], key[~right]).sum()) - int(np.searchsorted(key[right], start[~right]).sum())
        rank = np.sort(key) - start
        width *= 2
    return m * (m - 1) // 2 - ties - crossed, crossed


def pairs_in_cells(points: DataFrame, cell: str, x: str, y: str) -> DataFrame:
    """(concordant, discordant) per cell; a cell with an odd number holds one value, so no pairs."""
    def count(key, rows):
        return pd.DataFrame([count_pairs(rows[x].to_numpy(), rows[y].to_numpy())], columns=["concordant", "discordant"])
    return points.filter(F.col(cell) % 2 == 0).select(cell, x, y).groupBy(cell).applyInPandas(count, "concordant long, discordant long")


def kendall(df: DataFrame, a: str, b: str) -> DataFrame:
    """Kendall's tau-b and its normal p-value over all complete rows, exact and without pairs.

    Each column is cut into cells of consecutive values with at most twice ``CELL`` rows; a value with
    more rows is a cell of its own. Two rows share a cell of x, or else a cell of y, or neither:
    the first two kinds are counted inside the cells, the third from the rows per pair of cells.
    """
    sub = df.select(F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")).dropna()
    counts = settle(ranked_counts(sub, ["x", "y"]).select("column", "value", "n", "before_n", "total_n"))
    rows = counts.filter("column = 'x'").agg(F.sum("n")).first()[0] or 0
    size = max(CELL, -(-rows // MOST_CELLS))
    cell = 2 * F.floor(F.col("before_n") / size) + (F.col("n") >= size).cast("long")
    points = sub
    for c in ("x", "y"):
        mine = counts.filter(F.col("column") == c).select(F.col("value").alias(c), "n", "total_n", cell.alias(f"c{c}"))
        points = spread_lookup(points, mine, [c], [f"c{c}"], "n")
    points = settle(points.select("x", "y", "cx", "cy"))
    grid = points.groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("n"))
    apart = concordance(grid, [], "cx", "cy", (2 * (rows // size) + 1).bit_length(), weight="n")
    parts = pairs_in_cells(points, "cx", "x", "y").union(pairs_in_cells(points, "cy", "cx", "y"))
    whole = [F.col(c).cast("decimal(38,0)").alias(c) for c in ("concordant", "discordant")]
    pairs = parts.select(*whole).union(apart.select(*whole)).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("concordant", "discordant")])
    both = pairs.join(tie_sums(counts, "x"), F.lit(True)).join(tie_sums(counts, "y"), F.lit(True))
    m = F.col("n_x").cast("double") * (F.col("n_x") - 1)
    s = (F.col("concordant") - F.col("discordant")).cast("double")
    tau = s / F.sqrt((m / 2 - F.col("t_x")) * (m / 2 - F.col("t_y")))
    spread = ((m * (2 * F.col("n_x") + 5) - F.col("t1_x") - F.col("t1_y")) / 18
              + 2 * F.col("t_x") * F.col("t_y") / m
              + F.col("t0_x") * F.col("t0_y") / (9 * m * (F.col("n_x") - 2)))
    return (both.select(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col("n_x").alias("n"), F.col("concordant").cast("double").alias("concordant"), F.col("discordant").cast("double").alias("discordant"),
                        tau.alias("kendall"), (s / F.sqrt(spread)).alias("z"))
            .withColumn("p", tails.p_normal("z")))


def spearman_family(df: DataFrame, columns: list[str]) -> DataFrame:
    """Spearman with Fisher-z interval, t-based p and false-discovery adjustment over all pairs."""
    sub = df.select(*columns).dropna()
    n = sub.count()
    rho, size = F.col("spearman"), F.lit(n)
    low, high = fisher_z_interval(rho, size)
    t = F.abs(rho) * F.sqrt((n - 2) / (1 - rho * rho))
    rows = pearson_pairs(rank_columns(sub, columns), columns).withColumnRenamed("pearson", "spearman").select(
        "a", "b", "spearman", low.alias("ci_low"), high.alias("ci_high"), F.lit(n).cast("long").alias("n"),
        tails.p_t(t, F.lit(float(n - 2))).alias("p"))
    return benjamini_hochberg(rows, order=["a", "b"])


def partial_spearman(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, partial_spearman) controlling for all other columns, from one rank matrix."""
    inverse = np.linalg.pinv(gram(rank_columns(df.select(*columns).dropna(), columns), columns).corr)
    d = np.sqrt(np.diag(inverse))
    rows = [(columns[i], columns[j], float(-inverse[i, j] / (d[i] * d[j]))) for i, j in combinations(range(len(columns)), 2)]
    return df.sparkSession.createDataFrame(rows, "a string, b string, partial_spearman double")


def variance_inflation(df: DataFrame, columns: list[str]) -> DataFrame:
    inverse = np.diag(np.linalg.pinv(gram(df, columns).corr))
    return df.sparkSession.createDataFrame([(c, float(v)) for c, v in zip(columns, inverse)], "column string, vif double")


def interactions(df: DataFrame, features: list[str], label: str, keep: int | None = None) -> DataFrame:
    """How much a product a*b adds to a linear model of the label, with its F test."""
    exprs = {c: F.col(c) for c in [*features, label]}
    pairs = list(combinations(features, 2))
    exprs.update({f"{a}*{b}": F.col(a) * F.col(b) for a, b in pairs})
    space = gram(df, exprs)
    rows = []
    for a, b in pairs:
        base, full = space.fit(label, [a, b])[0], space.fit(label, [a, b, f"{a}*{b}"])[0]
        left = max(1 - full, 0.0)
        rows.append((a, b, full - base, (full - base) / (left / (space.n - 4)) if left > 0 else None))
    out = df.sparkSession.createDataFrame(rows, "a string, b string, delta_r2 double, f double")
    out = out.withColumn("p", tails.p_f("f", F.lit(1.0), F.lit(float(space.n - 4))))
    out = benjamini_hochberg(out, order=["a", "b"]).orderBy(F.col("delta_r2").desc(), "a", "b")
    return out.limit(keep) if keep else out
