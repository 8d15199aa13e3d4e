"""Phases 5 and 6: encoding, scaling, projection and selection."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from specula.operators.geometry import components
from specula.operators.depend import pearson_pairs
from specula.operators.shaping.recipe import Shaped, Step
from specula.operators.shaping.values import as_numbers, number
from specula.operators.typing import kind_of
from specula.plans.gram import gram
from specula.plans.longform import level, numeric_long
from specula.plans.ordered import exact_quantiles, running_totals, spread_lookup, text_cells


def category_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(level(column).alias("cat")).agg(F.count(F.lit(1)).alias("n"))


def _frequent(counts: DataFrame, total: int, least) -> DataFrame:
    if not least:
        return counts
    return counts.filter(F.col("n") >= (least if least >= 1 else least * total))


def _replace(state: Shaped, column: str, table: DataFrame, default, total: int) -> None:
    """Swap a category for its number from a table unique on ``cat``."""
    rows = state.df.withColumn("cat", level(column))
    got = spread_lookup(rows, table.withColumn("total_n", F.lit(total)), ["cat"], ["code"], "n")
    value = F.coalesce(F.col("code"), F.lit(default)) if default is not None else F.col("code")
    state.df = got.withColumn(column, value).drop("cat", "code")


def encode(state: Shaped, step: Step) -> dict:
    p = step.params
    strategy = p.get("strategy", "one-hot")
    columns = [c for c in step.columns if c != state.target]
    fit = state.fit_rows
    total = fit.count() if strategy != "hashing" else 0
    fitted: dict = {"strategy": strategy}
    for c in columns:
        if strategy == "hashing":
            buckets = int(p.get("buckets", 16))
            at = F.pmod(F.xxhash64(level(c)), F.lit(buckets))
            state.df = state.df.withColumns({f"{c}#{i}": (at == i).cast("tinyint") for i in range(buckets)}).drop(c)
            state.removed[c] = (step.id, "hashed into buckets")
            continue
        counts = _frequent(category_counts(fit, c), total, p.get("min_frequency") if strategy in ("one-hot", "ordinal") else None)
        if strategy == "one-hot":
            names = sorted(r["cat"] for r in counts.select("cat").collect())
            state.df = state.df.withColumns({f"{c}={v}": (level(c) == v).cast("tinyint") for v in names}).drop(c)
            state.removed[c] = (step.id, "expanded to one column per category")
            fitted[c] = names
        elif strategy == "ordinal" and p.get("order"):
            place = F.array_position(F.array(*[F.lit(str(v)) for v in p["order"]]), level(c))
            state.df = state.df.withColumn(c, F.when(place > 0, place - 1))
        elif strategy == "ordinal":
            placed = running_totals(text_cells(counts.select("cat", "n", F.lit(1).alias("one")), "cat"), [], "cat", ["one"]).select(
                "cat", "n", F.col("before_one").cast("long").alias("code"))
            _replace(state, c, placed, None, total)
        elif strategy == "frequency":
            _replace(state, c, counts.withColumn("code", F.col("n") / F.lit(total)), 0.0, total)
        elif strategy == "target":
            fitted[c] = _target(state, c, total, int(p.get("folds", 0)))
        else:
            raise ValueError(f"{step.id}: unknown strategy {strategy!r}")
    return fitted


def _target(state: Shaped, column: str, total: int, folds: int) -> dict:
    """Training means of the label per category; with ``folds``, a training row never sees its own fold."""
    y = number(state.label)
    fit = state.fit_rows.select(level(column).alias("cat"), y.alias("y"), F.col(state.row_id).alias("id")).filter("y IS NOT NULL")
    prior = fit.agg(F.avg("y")).first()[0]
    means = fit.groupBy("cat").agg(F.sum("y").alias("s"), F.count("y").alias("n"))
    if not folds:
        _replace(state, column, means.select("cat", "n", (F.col("s") / F.col("n")).alias("code")), float(prior), total)
        return {"prior": prior}
    fold = lambda key: F.pmod(F.xxhash64(key), F.lit(folds))
    own = (fit.groupBy("cat", fold(F.col("id")).alias("fold")).agg(F.sum("y").alias("fs"), F.count("y").alias("fn")))
    spots = (own.join(means, "cat").select(F.concat_ws("\x1f", "cat", F.col("fold").cast("string")).alias("cat"), F.col("fn").alias("n"),
                                           F.when(F.col("n") > F.col("fn"), (F.col("s") - F.col("fs")) / (F.col("n") - F.col("fn"))).alias("code"))
             .union(means.select(F.concat_ws("\x1f", "cat", F.lit("all")).alias("cat"), "n", F.col("s") / F.col("n"))))
    which = F.when(F.col("_part") == "train", fold(F.col(state.row_id)).cast("string")).otherwise(F.lit("all"))
    rows = state.df.withColumn("cat", F.concat_ws("\x1f", level(column), which))
    got = spread_lookup(rows, spots.withColumn("total_n", F.lit(total)), ["cat"], ["code"], "n")
    state.df = got.withColumn(column, F.coalesce(F.col("code"), F.lit(float(prior)))).drop("cat", "code")
    return {"prior": prior, "folds": folds}


def numeric_features(state: Shaped) -> list[str]:
    return [c for c in state.features if kind_of(state.df.schema[c]) in ("numeric",)]


def scale(state: Shaped, step: Step) -> dict:
    kind = step.params.get("kind", "standard")
    wanted = step.params.get("columns", "numeric")
    columns = numeric_features(state) if wanted == "numeric" else [c for c in (wanted or step.columns) if c in state.columns]
    if kind == "none" or not columns:
        return {"kind": "none"}
    numbers = as_numbers(state.fit_rows, columns)
    if kind == "robust":
        q = exact_quantiles(numbers, columns, [0.25, 0.5, 0.75])
        fitted = {c: (q[c][1], q[c][2] - q[c][0]) for c in columns}
    else:
        pair = (F.avg, F.stddev_pop) if kind == "standard" else (F.min, F.max)
        row = numbers.agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in zip("ab", pair)]).first()
        fitted = {c: (row[f"a{i}"], row[f"b{i}"] - (row[f"a{i}"] if kind == "minmax" else 0)) for i, c in enumerate(columns)}
    fitted = {c: (float(a or 0), float(b) or 1.0) for c, (a, b) in fitted.items() if b is not None}
    state.df = state.df.withColumns({c: (number(c) - a) / b for c, (a, b) in fitted.items()})
    return {"kind": kind, "fitted": fitted}


def project(state: Shaped, step: Step) -> dict:
    """Principal components of centred columns: k of them, or enough for a share of the variance."""
    p = step.params
    columns = p.get("columns") or step.columns or numeric_features(state)
    g = gram(as_numbers(state.fit_rows, columns), columns)
    loadings, shares = components(g.corr * np.outer(g.std, g.std), len(columns))
    k = int(p["k"]) if p.get("k") else int(np.searchsorted(np.cumsum(shares), float(p.get("variance", 0.95)) - 1e-12) + 1)
    centred = [F.coalesce(number(c), F.lit(float(m))) - float(m) for c, m in zip(columns, g.mean)]
    made = {f"pc{i + 1}": sum((float(w) * e for w, e in zip(row[1:], centred[1:])), float(row[0]) * centred[0])
            for i, row in enumerate(loadings[:k])}
    state.df = state.df.withColumns(made)
    if not p.get("keep_named", True):
        state.df = state.df.drop(*columns)
        for c in columns:
            state.removed[c] = (step.id, "replaced by components")
    return {"columns": columns, "mean": g.mean.tolist(), "loadings": loadings[:k].tolist(), "explained": shares[:k].tolist()}


def select_features(state: Shaped, step: Step) -> dict:
    p = step.params
    kind, limit = p.get("kind", "importance"), float(p.get("threshold", 0.0))
    safe = {*state.geometry.basis, state.target}
    if kind == "importance":
        scores = p.get("scores")
        if not scores:
            raise ValueError(f"{step.id}: selection by importance needs the scores of an importance run")
        gone = [c for c, v in scores.items() if (v or 0) <= limit and c in state.columns and c not in safe]
    elif kind == "variance":
        names = [c for c in numeric_features(state) if c not in safe]
        row = as_numbers(state.fit_rows, names).agg(*[F.var_pop(c).alias(c) for c in names]).first()
        gone = [c for c in names if (row[c] or 0) <= limit]
    elif kind == "correlation":
        gone = correlated(state, limit or 0.95, safe)
    else:
        raise ValueError(f"{step.id}: unknown kind {kind!r}")
    return state.drop(step, gone, f"{kind} at or below {limit}" if kind != "correlation" else f"correlated above {limit}")


def correlated(state: Shaped, limit: float, safe: set) -> list[str]:
    """Greedily one of every pair above the limit; basis columns and the label stay."""
    names = numeric_features(state)
    pairs = pearson_pairs(as_numbers(state.fit_rows, names), names).collect()
    gone: list[str] = []
    for r in sorted(pairs, key=lambda r: (-abs(r["pearson"] or 0), r["a"], r["b"])):
        if abs(r["pearson"] or 0) <= limit or r["a"] in gone or r["b"] in gone:
            continue
        victim = r["b"] if r["b"] not in safe else r["a"] if r["a"] not in safe else None
        if victim:
            gone.append(victim)
    return gone


OPERATIONS = {"encode": encode, "scale": scale, "project": project, "select_features": select_features}
