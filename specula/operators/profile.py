"""Statistics of numeric, datetime, text and nominal columns; outliers and modes."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from specula.operators.typing import census, level_counts
from specula.plans.longform import numeric_long
from specula.plans.ordered import bucket_of, cut_points, exact_quantiles, previous_value

QUANTILES = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]
FLAT = 1.4826  # scales the median absolute deviation to a standard deviation


def moments(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, mean, std (n-1), extremes, zeros, and skew and kurtosis in both conventions."""
    v = F.col("value")
    raw = numeric_long(df, columns).groupBy("column").agg(
        F.count("value").alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
        F.min(v).alias("min"), F.max(v).alias("max"), F.skewness(v).alias("skew_pop"),
        F.kurtosis(v).alias("kurt_pop"), F.sum((v == 0).cast("long")).alias("zeros"))
    n = F.col("n").cast("double")
    return raw.select("*",
                      (F.sqrt(n * (n - 1)) / (n - 2) * F.col("skew_pop")).alias("skew"),
                      ((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("kurt_pop") + 6)).alias("kurtosis"))


def fences(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float, list[float]]]:
    """Interquartile fences from exact quantiles: {column: (low, high, quantiles)}."""
    out = {}
    for c, q in exact_quantiles(df, columns, QUANTILES).items():
        if q[0] is not None:
            spread = 1.5 * (q[4] - q[2])
            out[c] = (q[2] - spread, q[4] + spread, q)
    return out


def numeric_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """Moments, exact quantiles, interquartile outliers and zero share, one row per column."""
    limits = fences(df, columns)
    names = ["p1", "p5", "q25", "median", "q75", "p95", "p99"]
    table = df.sparkSession.createDataFrame(
        [(c, lo, hi, *q) for c, (lo, hi, q) in limits.items()],
        "column string, fence_low double, fence_high double, " + ", ".join(f"{x} double" for x in names))
    outside = (numeric_long(df, columns).join(F.broadcast(table.select("column", "fence_low", "fence_high")), "column")
               .groupBy("column").agg(F.sum(((F.col("value") < F.col("fence_low")) | (F.col("value") > F.col("fence_high")))
                                            .cast("long")).alias("iqr_outliers")))
    return (moments(df, columns).join(F.broadcast(table), "column").join(outside, "column")
            .withColumn("zero_share", F.col("zeros") / F.col("n")))


def datetime_stats(df: DataFrame, columns: list[str], row_id: str) -> DataFrame:
    """First, last, span in days, and whether the column never falls along ``row_id`` (numeric)."""
    out = None
    for c in columns:
        base = df.select(F.col(row_id).cast("double").alias("at"), F.col(c).cast("timestamp").alias("t")).dropna()
        blocks = base.withColumn("bucket", bucket_of(F.col("at"), cut_points(base, ["at"])["at"]))
        inside = Window.partitionBy("bucket").orderBy("at")
        drops = (blocks.withColumn("p", F.lag("t").over(inside)).groupBy("bucket")
                 .agg(F.sum((F.col("t") < F.col("p")).cast("long")).alias("falls"),
                      F.min_by("t", "at").alias("head"), F.max_by("t", "at").alias("tail"),
                      F.min("t").alias("lo"), F.max("t").alias("hi"), F.count("t").alias("n")))
        chain = Window.partitionBy(F.lit(0)).orderBy("bucket")
        one = (drops.withColumn("edge", (F.col("head") < F.lag("tail").over(chain)).cast("long"))
               .agg(F.sum("n").alias("n"), F.min("lo").alias("first"), F.max("hi").alias("last"),
                    (F.sum(F.coalesce("falls", F.lit(0))) + F.sum(F.coalesce("edge", F.lit(0)))).alias("decreases"))
               .select(F.lit(c).alias("column"), "n", "first", "last",
                       F.floor((F.unix_micros("last") - F.unix_micros("first")) / 86400000000).alias("span_days"),
                       "decreases", (F.col("decreases") == 0).alias("monotonic")))
        out = one if out is None else out.union(one)
    return out


def text_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mean and maximal length and mean token count over whole texts, one pass, no shuffle of text."""
    tokens = lambda c: F.when(F.trim(c) == "", F.lit(0)).otherwise(F.size(F.split(F.trim(c), r"\s+")))
    measures = [x for c in columns for x in (
        F.avg(F.length(c)).alias(f"{c}:avg_len"), F.max(F.length(c)).alias(f"{c}:max_len"),
        F.avg(tokens(F.col(c))).alias(f"{c}:avg_tokens"))]
    row = df.agg(*measures)
    facts = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}:avg_len`").alias("avg_len"),
                               F.col(f"`{c}:max_len`").cast("long").alias("max_len"),
                               F.col(f"`{c}:avg_tokens`").alias("avg_tokens")) for c in columns])
    return row.select(F.inline(facts))


def nominal_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """Levels, top share, entropy, largest possible entropy and long-tail share per column."""
    counts = level_counts(df, columns).filter(F.col("value").isNotNull())
    totals = counts.groupBy("column").agg(F.sum("n").alias("total"))
    rare = F.col("n") < F.greatest(F.lit(2.0), 0.01 * F.col("total"))
    n = F.col("n").cast("double")
    return (counts.join(F.broadcast(totals), "column").groupBy("column")
            .agg(F.max("total").alias("n"), F.count(F.lit(1)).alias("levels"),
                 (F.max("n") / F.max("total")).alias("top_share"),
                 (F.log2(F.max("total").cast("double")) - F.sum(n * F.log2(n)) / F.max("total")).alias("entropy_bits"),
                 (F.sum(F.when(rare, F.col("n")).otherwise(0)) / F.max("total")).alias("long_tail_share"))
            .withColumn("max_entropy_bits", F.log2(F.col("levels").cast("double"))))


def mad_outliers(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows far from the median in units of the median absolute deviation, and the farthest."""
    med = {c: q[0] for c, q in exact_quantiles(df, columns, [0.5]).items() if q[0] is not None}
    away = df.select(*[F.abs(F.col(c).cast("double") - med[c]).alias(c) for c in med])
    mad = {c: q[0] for c, q in exact_quantiles(away, list(med), [0.5]).items()}
    table = df.sparkSession.createDataFrame([(c, med[c], mad[c]) for c in med], "column string, median double, mad double")
    z = F.when(F.col("mad") > 0, F.abs(F.col("value") - F.col("median")) / (FLAT * F.col("mad"))).otherwise(0.0)
    return (numeric_long(df, list(med)).join(F.broadcast(table), "column").withColumn("z", z)
            .groupBy("column").agg(F.max("median").alias("median"), F.max("mad").alias("mad"),
                                   F.sum((F.col("z") > 3.5).cast("long")).alias("mad_outliers"),
                                   F.max("z").alias("max_z")))


def _average_path(n: float) -> float:
    """Mean depth of an unsuccessful search in a binary tree of n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def isolation_steps(df: DataFrame, column: str, row_id: str, trees: int = 100, size: int = 256,
                    seed: int = 7) -> tuple[list[float], list[float]]:
    """Mean isolation depth as a step function of the value: (cut points, depth per piece).

    Every row may be drawn for any tree: hashed draws deal rows out to trees, and each tree keeps
    its first ``size``. Only some multiple of the rows that the forest needs is dealt out, whatever the
    table holds. A tree over one column only cuts the line, so the whole forest is one sorted list of cuts.
    """
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(row_id).cast("string")))
    held = df.select(F.col(column).cast("double").alias("x"), draw.alias("h")).filter(F.col("x").isNotNull() & ~F.isnan("x"))
    n, want = max(held.count(), 1), 4 * trees * size
    often = min(trees, math.ceil(want / n))  # trees that a row of a small table is dealt to
    pool = held.filter(F.pmod(F.xxhash64("h"), F.lit(1 << 30)) < int(min(1.0, want / n) * (1 << 30)))
    dealt = (F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(often - 1)), lambda j: F.pmod(F.xxhash64("h", j), F.lit(trees)).cast("int")))
             if often < trees else F.sequence(F.lit(0), F.lit(trees - 1)))
    mine = F.md5(F.concat_ws(":", F.col("tree").cast("string"), "h"))
    rank = F.row_number().over(Window.partitionBy("tree").orderBy("m"))
    picks = (pool.withColumn("tree", F.explode(dealt)).withColumn("m", mine)
             .withColumn("r", rank).filter(F.col("r") <= size).select("tree", "x"))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng(seed * 1000003 + int(pdf["tree"].iloc[0]))
        limit = math.ceil(math.log2(max(size, 2)))
        leaves, todo = [], [(np.sort(pdf["x"].to_numpy()), -math.inf, 0)]
        while todo:
            part, low, depth = todo.pop()
            if len(part) <= 1 or depth >= limit or part[0] == part[-1]:
                leaves.append((low, depth + _average_path(len(part))))
                continue
            cut = rng.uniform(part[0], part[-1])
            at = np.searchsorted(part, cut, side="right")
            todo += [(part[:at], low, depth + 1), (part[at:], cut, depth + 1)]
        return pd.DataFrame(leaves, columns=["low", "depth"]).assign(tree=pdf["tree"].iloc[0])

    pieces = picks.groupBy("tree").applyInPandas(grow, "low double, depth double, tree int").toPandas()
    cuts = np.unique(pieces["low"])
    total = np.zeros(len(cuts))
    count = pieces["tree"].nunique()
    for _, tree in pieces.groupby("tree"):
        tree = tree.sort_values("low")
        total += tree["depth"].to_numpy()[np.searchsorted(tree["low"].to_numpy(), cuts, side="right") - 1]
    return cuts.tolist(), (total / max(count, 1)).tolist()


def outlier_agreement(df: DataFrame, column: str, row_id: str, trees: int = 100, seed: int = 7) -> DataFrame:
    """Rows flagged by fences, by median deviation, by isolation depth, and by all three."""
    low, high, q = fences(df, [column])[column]
    away = df.select(F.abs(F.col(column).cast("double") - q[3]).alias("a"))
    mad = exact_quantiles(away, ["a"], [0.5])["a"][0]
    cuts, depth = isolation_steps(df, column, row_id, trees, seed=seed)
    norm = _average_path(256)

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        at = np.searchsorted(np.array(cuts), x.to_numpy(dtype=float), side="left") - 1
        return pd.Series(np.power(2.0, -np.array(depth)[np.clip(at, 0, len(depth) - 1)] / norm))

    x = F.col(column).cast("double")
    flags = (df.select(x.alias("x")).filter(F.col("x").isNotNull())
             .select(((F.col("x") < low) | (F.col("x") > high)).alias("iqr"),
                     (F.abs(F.col("x") - q[3]) / (FLAT * mad) > 3.5 if mad else F.lit(False)).alias("mad"),
                     (score("x") > 0.5).alias("iso")))
    count = lambda c: F.sum(c.cast("long"))
    return flags.agg(F.count(F.lit(1)).alias("n"), count(F.col("iqr")).alias("iqr"), count(F.col("mad")).alias("mad"),
                     count(F.col("iso")).alias("isolation"),
                     count(F.col("iqr") & F.col("mad") & F.col("iso")).alias("all_three")
                     ).select(F.lit(column).alias("column"), "*")


def density(df: DataFrame, column: str, grid: int = 256) -> DataFrame:
    """Gaussian kernel density of all rows at ``grid`` points: (i, x, y).

    Tasks add up their rows' kernels over the grid; only grid-sized sums are shuffled.
    """
    x = F.col(column).cast("double")
    head = df.agg(F.count(x).alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi"), F.stddev_samp(x).alias("sd")).first()
    n, lo, hi, sd = head["n"], head["lo"], head["hi"], head["sd"]
    width = sd * n ** -0.2
    step = (hi - lo) / (grid - 1)
    counts = df.select(x.alias("x")).dropna().groupBy("x").agg(F.count(F.lit(1)).alias("n"))

    def add(batches):
        points = lo + step * np.arange(grid)
        total = np.zeros(grid)
        for b in batches:
            xs, ns = b["x"].to_numpy(dtype=float), b["n"].to_numpy(dtype=float)
            for s in range(0, len(xs), 4096):
                z = (points[None, :] - xs[s:s + 4096, None]) / width
                total += ns[s:s + 4096] @ np.exp(-0.5 * z * z)
        yield pd.DataFrame({"i": np.arange(grid), "s": total})

    return (counts.mapInPandas(add, "i int, s double").groupBy("i").agg(F.sum("s").alias("s"))
            .select(F.col("i").cast("long").alias("i"), (F.lit(lo) + F.col("i") * F.lit(step)).alias("x"),
                    (F.col("s") / (n * width * math.sqrt(2 * math.pi))).alias("y")))


def modes(df: DataFrame, column: str, grid: int = 256) -> DataFrame:
    """Local maxima of the density above 5% of its peak, at most six, in order of value."""
    w = Window.partitionBy(F.lit(0)).orderBy("i")  # grid points only
    curve = density(df, column, grid).select("*", F.lag("y").over(w).alias("p"), F.lead("y").over(w).alias("f"),
                                             F.max("y").over(Window.partitionBy(F.lit(0))).alias("peak"))
    return (curve.filter((F.col("y") > F.col("p")) & (F.col("y") >= F.col("f")) & (F.col("y") > 0.05 * F.col("peak")))
            .withColumn("mode", F.row_number().over(w)).filter(F.col("mode") <= 6)
            .select(F.lit(column).alias("column"), "mode", "x", "y"))


def table_profile(df: DataFrame, numeric: list[str], nominal: list[str]) -> DataFrame:
    """What is in this table: the census joined with numeric statistics, one row per column."""
    counted = census(df, [*numeric, *nominal])
    stats = moments(df, numeric).select("column", "mean", "std", "min", "max", "skew", "kurtosis", "zeros")
    return (counted.select("column", "dtype", "rows", "missing", "nunique", "dominant_share", "entropy_bits")
            .join(F.broadcast(stats), "column", "left"))
