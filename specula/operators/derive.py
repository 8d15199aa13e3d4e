"""Which columns follow from others: formulas, functional dependencies, basis and labels."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from specula.plans.gram import Gram, gram
from specula.plans.longform import level
from specula.session import settle

SCHEMA = "column string, kind string, r2 double, intercept double, terms map<string,double>, ambiguous boolean"


def derivable_columns(df: DataFrame, columns: list[str], r2: float = 0.999) -> DataFrame:
    """Linear, then degree-2, then multiplicative formulas that reproduce a column.

    Each family needs one aggregation of cross products; all targets are solved from it.
    """
    space = gram(df, columns)
    rows = linear_formulas(space, r2)
    found = {r[0] for r in rows}
    if len(columns) >= 3:
        rows += quadratic_formulas(df, columns, [c for c in columns if c not in found], r2)
        found = {r[0] for r in rows}
    positive = [c for c, low in zip(space.names, space.low) if low > 0]
    if len(positive) >= 3:
        rows += [r for r in multiplicative_formulas(df, positive, r2) if r[0] not in found]
    return df.sparkSession.createDataFrame(rows, SCHEMA)


def _reach(space: Gram, column: str) -> float:
    i = space.names.index(column)
    return max(1.0, abs(space.low[i]), abs(space.high[i]))


def linear_formulas(space: Gram, r2: float) -> list[tuple]:
    rows = []
    for target in space.names:
        share, coef, start = space.fit(target, [c for c in space.names if c != target])
        if share >= r2:
            terms = {c: k for c, k in coef.items() if abs(k) > 1e-8 * _reach(space, target)}
            rows.append((target, "linear", share, start, terms, False))
    return rows


def quadratic_formulas(df: DataFrame, columns: list[str], targets: list[str], r2: float) -> list[tuple]:
    exprs = {c: F.col(c) for c in columns}
    exprs.update({f"{a}*{b}": F.col(a) * F.col(b) for a, b in combinations(columns, 2)})
    space = gram(df, exprs)
    rows = []
    for target in targets:
        others = [c for c in space.names if target not in c.split("*")]
        if len(others) + 1 >= space.n:
            continue
        share, coef, start = space.fit(target, others)
        if share >= r2:
            eigen = np.linalg.eigvalsh(space.take(others))
            terms = {c: k for c, k in coef.items() if abs(k) > 1e-7 * _reach(space, target)}
            rows.append((target, "polynomial-2", share, start, terms, bool(eigen[0] <= 1e-12 * eigen[-1])))
    return rows


def multiplicative_formulas(df: DataFrame, positive: list[str], r2: float) -> list[tuple]:
    space = gram(df, {c: F.log(c) for c in positive})
    rows = []
    for target in positive:
        share, coef, start = space.fit(target, [c for c in positive if c != target])
        if share >= r2:
            rows.append((target, "multiplicative", share, start,
                         {c: k for c, k in coef.items() if abs(k) > 1e-6}, False))
    return rows


def _grouped(named: DataFrame, sides: list[tuple[int, ...]]) -> DataFrame:
    """Every row once for each side, with the side's number and the id of its group there: the product of its columns' ids."""
    spread = named.select("*", F.posexplode(F.lit([list(side) for side in sides])).alias("side", "at"))
    part = lambda ids: [F.get(ids, F.get("at", F.lit(i))) for i in range(len(sides[0]))]
    return spread.select("side", F.xxhash64(*part("a")).alias("ka"), F.xxhash64(F.lit("second"), *part("b")).alias("kb"), "a")


def _surviving(named: DataFrame, sides: list[tuple[int, ...]], limit: float) -> list[tuple[int, ...]]:
    """The sides that can have at most ``limit`` groups, by sketches of the number of groups: one pass in which only sketches are shuffled.

    A sketch is off by some 5%; only sides estimated half as many again as the limit go.
    """
    if not sides:
        return []
    sizes = _grouped(named, sides).groupBy("side").agg(F.approx_count_distinct("ka", 0.05).alias("n")).collect()
    return [sides[r["side"]] for r in sorted(sizes, key=lambda r: r["side"]) if r["n"] <= 1.5 * limit]


def _level(named: DataFrame, sides: list[tuple[int, ...]], wanted: dict[tuple, list[int]]) -> dict[tuple, Row]:
    """{side: number of groups and the share of them that determine each wanted column} in one pass."""
    if not sides:
        return {}
    asked = sorted({j for side in sides for j in wanted[side]})
    use = F.get(F.lit([[j in wanted[side] for j in asked] for side in sides]), F.col("side"))
    rows = _grouped(named, sides).select("side", "ka", "kb", *[F.when(F.get(use, F.lit(i)), F.get("a", F.lit(j))).alias(f"r{j}") for i, j in enumerate(asked)])
    groups = rows.groupBy("side", "ka", "kb").agg(F.lit(1).alias("one"), *[f(f"r{j}").alias(f"{name}{j}") for j in asked for name, f in (("lo", F.min), ("hi", F.max))])
    stats = groups.groupBy("side").agg(F.count(F.lit(1)).alias("groups"), *[F.avg((F.col(f"lo{j}") == F.col(f"hi{j}")).cast("int")).alias(f"d{j}") for j in asked])
    return {sides[r["side"]]: r for r in stats.collect()}


def functional_dependencies(df: DataFrame, columns: list[str], max_lhs: int = 2, near: float = 0.95,
                            near_key: float = 0.3) -> DataFrame:
    """(lhs, rhs, exact, determination_ratio, groups) over the whole table.

    Level by level over the size of left sides. A column's partition is a group id per row, the partition of more columns the
    product of these ids. A left side with more groups than ``near_key`` allows is almost a key; so are all that contain it, and
    none of them is ever grouped. A right side settled exactly by a subset is not looked at again. Each level is one pass: a group determines a
    column when the smallest and largest of its ids agree, which combines before the shuffle, so no group is gathered and
    only ids move, not values. Ids of groups have 128 bits and ids of right sides 64.
    """
    limit = near_key * df.count()
    named = df.select(F.array(*[F.xxhash64(level(c)) for c in columns]).alias("a"), F.array(*[F.xxhash64(F.lit("second"), level(c)) for c in columns]).alias("b"))
    sides, found = [(j,) for j in range(len(columns))], []
    for k in range(1, max_lhs + 1):
        settled = [(set(side), j) for side, j, exact, *_ in found if exact]
        wanted = {side: [j for j in range(len(columns)) if j not in side and not any(r == j and lhs < set(side) for lhs, r in settled)] for side in sides}
        # sides whose parts have few groups cannot have many themselves
        few = [side for side in sides if k > 1 and math.prod(singles[j] for j in side) <= limit]
        sides = sorted(few + _surviving(named, [side for side in sides if side not in set(few)], limit))
        groups = {side: row for side, row in _level(named, sides, wanted).items() if row["groups"] <= limit}
        found += [(side, j, groups[side][f"d{j}"] == 1.0, float(groups[side][f"d{j}"]), groups[side]["groups"])
                  for side in sides if side in groups for j in wanted[side] if groups[side][f"d{j}"] >= near]
        # what is almost a key makes all larger sides keys
        singles = {side[0]: row["groups"] for side, row in groups.items()} if k == 1 else singles
        sides = [side for side in combinations(sorted(singles), k + 1) if all(part in groups for part in combinations(side, k))]
        if not sides:
            break
    return df.sparkSession.createDataFrame(
        [([columns[i] for i in side], columns[j], *rest) for side, j, *rest in found],
        "lhs array<string>, rhs string, exact boolean, determination_ratio double, groups long")


def row_determination(df: DataFrame, lhs: list[str], rhs: str) -> DataFrame:
    """Share of rows (nulls dropped) in left-side groups that hold one right-side value."""
    groups = (df.dropna(subset=[*lhs, rhs]).groupBy(*lhs)
              .agg(F.min(rhs).alias("lo"), F.max(rhs).alias("hi"), F.count(F.lit(1)).alias("n")))
    fixed = F.sum(F.when(F.col("lo") == F.col("hi"), F.col("n")).otherwise(0))
    return groups.agg(F.lit(",".join(lhs)).alias("lhs"), F.lit(rhs).alias("rhs"), F.sum("n").alias("rows"),
                      (fixed / F.sum("n")).alias("determination"))


# Arithmetic signs that formulas may be written with.
SIGNS = {"×": "*", "·": "*", "÷": "/", "−": "-", "^": "**"}


def formula_check(df: DataFrame, formulas: dict[str, str], tolerance: float = 1e-6) -> DataFrame:
    """Rows on which ``head = formula`` holds within the tolerance; confirmed when all do."""
    exprs = []
    for head, text in formulas.items():
        for sign, plain in SIGNS.items():
            if sign != "^":
                text = text.replace(sign, plain)
        want = F.expr(text).cast("double")
        have = F.col(head).cast("double")
        usable = want.isNotNull() & have.isNotNull()
        agree = F.abs(have - want) <= tolerance * F.greatest(F.lit(1.0), F.abs(want))
        exprs += [F.sum(usable.cast("long")).alias(f"{head}:rows"),
                  F.sum((usable & agree).cast("long")).alias(f"{head}:agree")]
    counted = df.agg(*exprs)
    out = F.array(*[F.struct(F.lit(h).alias("column"), F.col(f"`{h}:rows`").alias("rows"),
                             F.col(f"`{h}:agree`").alias("agree")) for h in formulas])
    return counted.select(F.inline(out)).withColumn("confirmed", F.col("rows") == F.col("agree"))


def basis_columns(columns: DataFrame, heads: DataFrame) -> DataFrame:
    """Columns that head no active rule and are neither identity, key, degenerate nor constant."""
    fit = columns.filter(~F.col("role").isin("identity", "key", "degenerate", "constant"))
    return fit.join(heads.select(F.col("head").alias("column")).distinct(), "column", "left_anti")


def active_heads(rules: DataFrame, cycles: DataFrame, chosen: dict[str, str] | None = None) -> DataFrame:
    """(head): derived columns once every cycle has an orientation (the default unless chosen).

    ``rules`` holds (head); ``cycles`` holds (cycle, orientation, is_default, column, derived).
    """
    pick = F.create_map(*[F.lit(x) for kv in (chosen or {"": ""}).items() for x in kv])[F.col("cycle")]
    active = cycles.filter(F.when(pick.isNotNull(), F.col("orientation") == pick).otherwise(F.col("is_default")))
    free = active.filter("NOT derived").select(F.col("column").alias("head"))
    bound = active.filter("derived").select(F.col("column").alias("head"))
    return rules.select("head").join(free, "head", "left_anti").union(bound).distinct()


def label_candidates(rules: DataFrame, basis: list[str], types: DataFrame) -> DataFrame:
    """Determined columns whose determining columns are all basis: label, features, leakage, task.

    ``rules`` holds (lhs array, rhs, stated); stated candidates come first.
    """
    members = F.array(*[F.lit(c) for c in sorted(basis)])
    fit = rules.filter(F.size(F.array_except("lhs", members)) == 0)
    task = F.when(F.col("semantic_type").isin("boolean", "nominal", "ordinal"), "classification").otherwise("regression")
    best = Window.partitionBy("rhs").orderBy(F.col("stated").desc(), F.size("lhs"), F.col("lhs"))
    return (fit.withColumn("_r", F.row_number().over(best)).filter("_r = 1")
            .join(F.broadcast(types.select(F.col("column").alias("rhs"), "semantic_type")), "rhs")
            .select(F.col("rhs").alias("label"), "stated", task.alias("task"),
                    F.array_sort(F.array_except(F.array_except(members, "lhs"), F.array("rhs"))).alias("features"),
                    F.array_sort("lhs").alias("leakage"))
            .orderBy(F.col("stated").desc(), "label"))


def derivation_depth(rules: DataFrame) -> DataFrame:
    """(column, depth): the longest chain of rules below each column; rules hold (head, body)."""
    longest = settle(rules.select("head", "body", F.lit(1).cast("bigint").alias("n")).distinct())
    known = None
    while True:  # paths double in length each round, so a chain of d rules takes log2(d) rounds
        if longest.filter("head = body").limit(1).count():
            raise ValueError("columns derive from each other in a circle; they have no depth")
        state = longest.agg(F.count(F.lit(1)), F.sum("n")).first()
        if state == known:
            break
        known = state
        on = longest.select(F.col("head").alias("body"), F.col("body").alias("end"), F.col("n").alias("more"))
        longest = settle(longest.union(longest.join(on, "body").select("head", F.col("end").alias("body"), F.col("n") + F.col("more")))
                         .groupBy("head", "body").agg(F.max("n").alias("n")))
    return (rules.select(F.explode(F.array("head", "body")).alias("head")).distinct().join(longest, "head", "left")
            .groupBy(F.col("head").alias("column")).agg(F.coalesce(F.max("n"), F.lit(0).cast("bigint")).alias("depth")))
