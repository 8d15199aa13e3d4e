"""Duplicates, missingness mechanisms, type coherence, category hygiene and range anomalies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specula.functions import tails
from specula.functions.effects import benjamini_hochberg, rank_biserial
from specula.operators.typing import SHORT, census, kind_of, level_counts
from specula.plans.longform import level, numeric_long
from specula.plans.ordered import average_rank, range_cells, running_totals

# Name parts that mark percentages and quantities that cannot be negative.
QUANTITY_PARTS = ("qty", "count", "quantity", "n_", "days", "age", "price", "amount", "weight")


def short_key(df: DataFrame, columns: list[str]) -> list[Column]:
    """Grouping keys equal exactly when the rows are equal; long text goes as a digest."""
    out = []
    for c in columns:
        col = F.col(f"`{c}`")
        if kind_of(df.schema[c]) == "string":
            col = F.when(F.length(col) > SHORT, F.sha2(col, 256)).otherwise(col)
        out.append(col.alias(f"k_{c}"))
    return out


def duplicates(df: DataFrame, key_sets: dict[str, list[str]]) -> DataFrame:
    """Rows beyond the first of each group of equal rows, per named set of columns."""
    out = None
    for name, columns in key_sets.items():
        groups = df.groupBy(*short_key(df, columns)).agg(F.count(F.lit(1)).alias("n"))
        one = groups.agg(F.lit(name).alias("keys"), F.sum("n").alias("rows"),
                         F.sum(F.col("n") - 1).alias("duplicates"))
        out = one if out is None else out.union(one)
    return out.select("keys", "rows", "duplicates", (F.col("duplicates") / F.col("rows")).alias("rate"))


def near_duplicates(df: DataFrame, tolerances: dict[str, float], row_id: str) -> DataFrame:
    """(row_id): rows with an earlier row whose listed columns all lie within the tolerances.

    Cells are one tolerance wide. A row that is not the earliest of its cell is near its
    cell's head at once; only heads are compared with the points of adjacent cells, so the
    work is rows x neighbouring cells and never all pairs of a crowded cell.
    """
    names = list(tolerances)
    cell = F.array(*[F.floor(F.col(c).cast("double") / t).cast("long") for c, t in tolerances.items()])
    rows = df.select(F.col(row_id).alias("row_id"), *[F.col(c).cast("double").alias(c) for c in names], cell.alias("cell")).dropna()
    points = rows.groupBy(*names, "cell").agg(F.min("row_id").alias("row_id"))
    heads = points.groupBy("cell").agg(F.min(F.struct("row_id", *names)).alias("head"))
    offsets = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    around = heads
    for i in range(len(names)):
        around = around.withColumn(f"d{i}", F.explode(offsets))
    moved = F.array(*[F.col("cell")[i] + F.col(f"d{i}") for i in range(len(names))])
    around = (around.filter(" OR ".join(f"d{i} <> 0" for i in range(len(names))))
              .select(moved.alias("cell"), "head"))
    near = F.col("row_id") < F.col("head.row_id")
    for c, t in tolerances.items():
        near = near & (F.abs(F.col(c) - F.col(f"head.{c}")) <= t)
    across = points.join(around, "cell").filter(near).select(F.col("head.row_id").alias("row_id")).distinct()
    first = heads.select("cell", F.col("head.row_id").alias("first_id"))
    inside = rows.join(first, "cell").filter(F.col("row_id") > F.col("first_id")).select("row_id")
    return inside.union(across)


def missingness_numeric(df: DataFrame, columns: list[str], others: list[str], min_missing: int = 10,
                        min_side: int = 8) -> DataFrame:
    """Mann-Whitney of every other numeric column between rows with and without a value.

    One value-count table carries the missing counts of all columns, so every pair is
    tested from the same ranks.
    """
    marked = df.select(*[F.col(o).cast("double").alias(o) for o in others],
                       *[F.col(c).isNull().cast("long").alias(f"miss_{i}") for i, c in enumerate(columns)])
    flags = [f"miss_{i}" for i in range(len(columns))]
    counts = numeric_long(marked, others, flags).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"), *[F.sum(f).alias(f) for f in flags])
    placed = range_cells(counts, ["column", "value"], df.count() * len(others))
    ranked = running_totals(placed, ["column"], "value", ["n"], few_keys=True).withColumn("rank", average_rank())
    sides = F.array(*[F.struct(F.lit(c).alias("missing_in"), F.col(f"miss_{i}").alias("m")) for i, c in enumerate(columns)])
    n = F.col("n").cast("double")
    grouped = (ranked.select("column", "rank", "n", F.inline(sides)).filter(F.col("column") != F.col("missing_in"))
               .groupBy("missing_in", F.col("column").alias("against"))
               .agg(F.sum("m").alias("n1"), F.sum(F.col("n") - F.col("m")).alias("n2"),
                    F.sum(F.col("m") * F.col("rank")).alias("r1"),
                    F.sum(n * n * n - n).alias("ties")))
    out = mann_whitney_from_ranks(grouped.filter((F.col("n1") >= max(min_side, min_missing)) & (F.col("n2") >= min_side)))
    return out.select("missing_in", "against", F.lit("mann-whitney").alias("test"), F.col("u").alias("statistic"),
                      "p", F.lit("rank-biserial").alias("effect_name"),
                      rank_biserial(F.col("u"), F.col("n1"), F.col("n2")).alias("effect"),
                      (F.col("n1") + F.col("n2")).alias("n"))


def mann_whitney_from_ranks(df: DataFrame) -> DataFrame:
    """Add u, z and p to rows holding n1, n2, the first group's rank sum r1, and the tie sum."""
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    u = F.col("r1") - n1 * (n1 + 1) / 2
    spread = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    z = (F.greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / spread
    return (df.withColumn("u", u).withColumn("z", z)
            .withColumn("p", F.least(F.lit(1.0), tails.p_normal(F.greatest(F.col("z"), F.lit(0.0))))))


def missingness_nominal(df: DataFrame, columns: list[str], others: list[str], min_missing: int = 10,
                        max_levels: int = 30) -> DataFrame:
    """Chi-square of every other category against missing or not; Fisher for small 2x2 tables."""
    from specula.operators.hypothesis import chi_square_from_cells
    cells = F.array(*[F.struct(F.lit(c).alias("a"), F.lit(o).alias("b"),
                               F.col(c).isNull().cast("string").alias("level_a"), level(o).alias("level_b"))
                      for c in columns for o in others if c != o])
    table = (df.select(F.inline(cells)).groupBy("a", "b", "level_a", "level_b").agg(F.count(F.lit(1)).alias("n")))
    out = chi_square_from_cells(table)
    return (out.filter((F.col("rows") == 2) & (F.col("columns") <= max_levels) & (F.col("columns") >= 2))
            .select(F.col("a").alias("missing_in"), F.col("b").alias("against"),
                    F.when(F.col("used") == "fisher", "fisher-exact").otherwise("chi-square").alias("test"),
                    F.col("chi2").alias("statistic"), "p", F.lit("cramers_v").alias("effect_name"),
                    F.col("v").alias("effect"), "n"))


def missingness_dependence(df: DataFrame, numeric: list[str], nominal: list[str], alpha: float = 0.05,
                           keep: int | None = None) -> DataFrame:
    """Which columns' gaps depend on which other columns, corrected over the whole family."""
    counts = df.agg(F.count(F.lit(1)).alias("n"),
                    *[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in [*numeric, *nominal]]).first()
    gappy = [c for c in [*numeric, *nominal] if 10 <= counts[c] < counts["n"]]
    both = (missingness_numeric(df, gappy, numeric)
            .unionByName(missingness_nominal(df, gappy, nominal)))
    adjusted = benjamini_hochberg(both, order=["missing_in", "against"])
    out = adjusted.filter(F.col("p_adj") < alpha).orderBy("p_adj", "missing_in", "against")
    return out.limit(keep) if keep else out


def stored_as_text(df: DataFrame, columns: list[str]) -> DataFrame:
    """String columns that parse as numbers or dates in more than 90% of their rows."""
    facts = census(df, columns)
    issues = F.array(F.struct(F.lit("numeric stored as text").alias("issue"), F.col("number_share").alias("share")),
                     F.struct(F.lit("date stored as text").alias("issue"), F.col("date_share").alias("share")))
    return facts.select("column", F.inline(issues)).filter(F.col("share") > 0.9)


def category_variants(df: DataFrame, columns: list[str]) -> DataFrame:
    """Levels that disappear once case and surrounding blanks are ignored."""
    counts = level_counts(df, columns).filter(F.col("value").isNotNull() & (F.col("length") <= SHORT))
    folded = counts.groupBy("column", F.lower(F.trim("value")).alias("folded")).agg(F.count(F.lit(1)).alias("n"))
    return (folded.groupBy("column").agg(F.sum("n").alias("levels"), F.sum(F.col("n") - 1).alias("levels_collapsed"))
            .filter("levels_collapsed > 0"))


def range_anomalies(df: DataFrame, columns: list[str]) -> DataFrame:
    """Percentage-named columns above 100 and quantity-named columns below 0."""
    checks = []
    for c in columns:
        name = c.lower()
        if name.endswith("_pct") or "percent" in name:
            checks.append((c, "percentage above 100", F.col(c) > 100))
        if any(k in name for k in QUANTITY_PARTS):
            checks.append((c, "negative value in a non-negative quantity", F.col(c) < 0))
    return _violations(df, checks)


def future_dates(df: DataFrame, columns: list[str], reference: Column) -> DataFrame:
    """How many instants of each column lie after the reference."""
    return _violations(df, [(c, "after the reference", F.col(c) > reference) for c in columns])


def _violations(df: DataFrame, checks: list[tuple[str, str, Column]]) -> DataFrame:
    counted = df.agg(*[F.sum(F.coalesce(test, F.lit(False)).cast("long")).alias(f"v{i}") for i, (_, _, test) in enumerate(checks)])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(issue).alias("issue"), F.col(f"v{i}").alias("n"))
                     for i, (c, issue, _) in enumerate(checks)])
    return counted.select(F.inline(rows)).filter("n > 0")
