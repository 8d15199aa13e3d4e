"""Phase 4: gaps, bounds, transforms, bins, calendar parts and lags."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specula.operators.depend import right_closed_bin
from specula.operators.shaping.recipe import Shaped, Step
from specula.operators.typing import kind_of, level_counts
from specula.plans.longform import numeric_long
from specula.plans.ordered import exact_quantiles, quantile_columns, ranked_counts, spread_lookup
from specula.plans.sequence import with_lags, with_position


def number(column: str) -> Column:
    return F.expr(f"try_cast(`{column}` AS double)")


def as_numbers(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[number(c).alias(c) for c in columns])


def most_frequent(df: DataFrame, columns: list[str]) -> dict[str, str | None]:
    """The most frequent value per column, the smallest of ties (by value for numbers)."""
    counts = level_counts(df, columns).filter("value IS NOT NULL")
    numeric = [c for c in columns if kind_of(df.schema[c]) == "numeric"]
    place = F.when(F.col("column").isin(numeric), F.expr("try_cast(value AS double)"))
    best = counts.groupBy("column").agg(F.min_by("value", F.struct(-F.col("n"), place, "value")).alias("value"))
    return {r["column"]: r["value"] for r in best.collect()}


def impute(state: Shaped, step: Step) -> dict:
    p, columns = step.params, step.columns
    strategy, by = p.get("strategy", "median"), p.get("by", [])
    by = [by] if isinstance(by, str) else list(by)
    if state.target in columns:
        raise ValueError(f"{step.id}: the label {state.target!r} is never imputed")
    fit = state.fit_rows
    if p.get("indicator"):
        state.df = state.df.withColumns({f"{c}_missing": F.col(c).isNull().cast("tinyint") for c in columns})
    if strategy in ("median", "mean", "mode", "constant"):
        if strategy == "median":
            fill = {c: q[0] for c, q in exact_quantiles(as_numbers(fit, columns), columns, [0.5]).items()}
        elif strategy == "mean":
            row = fit.agg(*[F.avg(number(c)).alias(c) for c in columns]).first()
            fill = {c: row[c] for c in columns}
        elif strategy == "mode":
            fill = most_frequent(fit, columns)
        else:
            fill = {c: p.get("value") for c in columns}
        wider = lambda c: "double" if strategy in ("median", "mean") else state.df.schema[c].dataType
        state.df = state.df.withColumns({c: F.coalesce(F.col(c).cast(wider(c)), F.lit(fill.get(c)).cast(wider(c))) for c in columns})
        return {"fill": fill}
    if strategy == "group-median":
        return _group_median(state, columns, by)
    if strategy == "group-mode":
        return _group_mode(state, columns, by)
    raise ValueError(f"{step.id}: unknown strategy {strategy!r}")


def _group_key(by: list[str]) -> Column:
    return F.concat_ws("\x1f", *[F.coalesce(F.col(b).cast("string"), F.lit("<null>")) for b in by])


def _fill_from(state: Shaped, table: DataFrame, column: str, by: list[str], fallback) -> None:
    """Fill gaps from a table unique on the group; groups of any size share one lookup."""
    kind = "double" if table.schema["fill"].dataType.simpleString() == "double" else state.df.schema[column].dataType
    rows = state.df.withColumn("_group", _group_key(by))
    got = spread_lookup(rows, table, ["_group"], ["fill"], "n")
    value = F.coalesce(F.col(column).cast(kind), F.col("fill").cast(kind), F.lit(fallback).cast(kind))
    state.df = got.withColumn(column, value).drop("_group", "fill")


def _group_median(state: Shaped, columns: list[str], by: list[str]) -> dict:
    fit = state.fit_rows
    whole = {c: q[0] for c, q in exact_quantiles(as_numbers(fit, columns), columns, [0.5]).items()}
    keyed = fit.select(_group_key(by).alias("_group"), *[number(c).alias(c) for c in columns])
    sizes = keyed.groupBy("_group").agg(F.count(F.lit(1)).alias("n"))
    medians = (ranked_counts(keyed, columns, ["_group"]).groupBy("column", "_group")
               .agg(*quantile_columns([0.5], ["fill"])).join(sizes, "_group"))
    total = sizes.agg(F.sum("n").alias("total_n"))
    medians = medians.join(F.broadcast(total), F.lit(True))
    for c in columns:
        _fill_from(state, medians.filter(F.col("column") == c).drop("column"), c, by, whole[c])
    return {"by": by, "fallback": whole}


def _group_mode(state: Shaped, columns: list[str], by: list[str]) -> dict:
    fit = state.fit_rows
    whole = most_frequent(fit, columns)
    total = fit.agg(F.count(F.lit(1)).alias("total_n"))
    for c in columns:
        counts = fit.filter(F.col(c).isNotNull()).groupBy(_group_key(by).alias("_group"), F.col(c).alias("v")).agg(F.count(F.lit(1)).alias("k"))
        table = (counts.groupBy("_group").agg(F.min_by(F.col("v").cast("string"), F.struct(-F.col("k"), "v")).alias("fill"), F.sum("k").alias("n"))
                 .join(F.broadcast(total), F.lit(True)))
        _fill_from(state, table, c, by, whole[c])
    return {"by": by, "fallback": whole}


def bounded(value: Column, low, high) -> Column:
    """The value within its bounds; null stays null."""
    out = value
    if low is not None:
        out = F.when(out < F.lit(float(low)), F.lit(float(low))).otherwise(out)
    if high is not None:
        out = F.when(out > F.lit(float(high)), F.lit(float(high))).otherwise(out)
    return out


def clip(state: Shaped, step: Step) -> dict:
    low, high = step.params.get("lower"), step.params.get("upper")
    state.df = state.df.withColumns({c: bounded(number(c), low, high) for c in step.columns})
    return {"lower": low, "upper": high}


def winsorize(state: Shaped, step: Step) -> dict:
    probs = [float(step.params.get("lower_q", 0.01)), float(step.params.get("upper_q", 0.99))]
    ends = exact_quantiles(as_numbers(state.fit_rows, step.columns), step.columns, probs)
    state.df = state.df.withColumns({c: bounded(number(c), *ends[c]) for c in step.columns})
    return {"bounds": ends}


def box_cox(x: Column, lam: Column) -> Column:
    return F.when(F.abs(lam) < 1e-12, F.log(x)).otherwise((F.pow(x, lam) - 1) / lam)


def yeo_johnson(x: Column, lam: Column) -> Column:
    up = F.when(F.abs(lam) < 1e-12, F.log1p(x)).otherwise((F.pow(x + 1, lam) - 1) / lam)
    down = F.when(F.abs(lam - 2) < 1e-12, -F.log1p(-x)).otherwise(-(F.pow(1 - x, 2 - lam) - 1) / (2 - lam))
    return F.when(x >= 0, up).otherwise(down)


def best_lambda(df: DataFrame, columns: list[str], kind: str) -> dict[str, float]:
    """Maximum-likelihood exponents: five passes, each a finer grid for all columns at once."""
    head = df.agg(*[e.alias(f"{n}{i}") for i, c in enumerate(columns) for n, e in (
        ("lo", F.min(c)), ("n", F.count(c)), ("g", F.avg(F.log(F.when(F.col(c) > 0, F.col(c))))),
        ("s", F.sum(F.signum(F.col(c)) * F.log1p(F.abs(F.col(c))))))]).first()
    if kind == "box-cox":
        bad = [c for i, c in enumerate(columns) if head[f"lo{i}"] is not None and head[f"lo{i}"] <= 0]
        if bad:
            raise ValueError(f"box-cox needs strictly positive values, {bad} have others (yeo-johnson takes them)")
    centre, step = {c: 0.0 for c in columns}, 0.25
    scale = {c: math.exp(head[f"g{i}"]) if kind == "box-cox" else 1.0 for i, c in enumerate(columns)}
    long = numeric_long(df.select(*[(F.col(c) / scale[c]).alias(c) for c in columns]), columns)
    for _ in range(5):
        grid = {c: [centre[c] + step * (j - 20) for j in range(41)] for c in columns}
        tries = F.create_map(*[x for c in columns for x in (F.lit(c), F.array(*[F.lit(v) for v in grid[c]]))])
        spread = long.select("column", "value", F.posexplode(tries[F.col("column")]).alias("j", "lam"))
        made = box_cox(F.col("value"), F.col("lam")) if kind == "box-cox" else yeo_johnson(F.col("value"), F.col("lam"))
        found = {(r["column"], r["j"]): r["v"] for r in
                 spread.select("column", "j", made.alias("y")).groupBy("column", "j").agg(F.var_pop("y").alias("v")).collect()}
        for i, c in enumerate(columns):
            def likelihood(j):
                v = found.get((c, j))
                if v is None or not v > 0 or math.isinf(v):
                    return -math.inf
                extra = (grid[c][j] - 1) * head[f"s{i}"] if kind == "yeo-johnson" else 0.0
                return -head[f"n{i}"] / 2 * math.log(v) + extra
            centre[c] = grid[c][max(range(41), key=likelihood)]
        step /= 16
    return centre


def transform(state: Shaped, step: Step) -> dict:
    kind = step.params.get("kind", "log1p")
    plain = {"log1p": F.log1p, "log": F.log, "sqrt": F.sqrt, "reciprocal": lambda x: 1.0 / F.when(x != 0, x)}
    if kind in plain:
        state.df = state.df.withColumns({c: plain[kind](number(c)) for c in step.columns})
        return {"kind": kind}
    lam = best_lambda(as_numbers(state.fit_rows, step.columns), step.columns, kind)
    apply = box_cox if kind == "box-cox" else yeo_johnson
    state.df = state.df.withColumns({c: apply(number(c), F.lit(float(lam[c]))) for c in step.columns})
    return {"kind": kind, "lambda": lam}


def bin_values(state: Shaped, step: Step) -> dict:
    p = step.params
    kind, k = p.get("kind", "quantile"), int(p.get("k", 4))
    numbers = as_numbers(state.fit_rows, step.columns)
    if kind == "quantile":
        edges = {c: sorted(set(q)) for c, q in exact_quantiles(numbers, step.columns, [i / k for i in range(k + 1)]).items()}
    elif kind == "width":
        row = numbers.agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(step.columns) for n, f in (("lo", F.min), ("hi", F.max))]).first()
        edges = {c: [row[f"lo{i}"] + (row[f"hi{i}"] - row[f"lo{i}"]) * j / k for j in range(k + 1)] for i, c in enumerate(step.columns)}
    else:
        edges = {c: [float(e) for e in p["edges"]] for c in step.columns}
    for c in step.columns:
        if len(edges[c]) < 3:
            raise ValueError(f"{step.id}: {c!r} falls into fewer than two bins")
    state.df = state.df.withColumns({(c if p.get("replace") else f"{c}_bin"): right_closed_bin(number(c), edges[c]).cast("long")
                                     for c in step.columns})
    return {"edges": edges}


# Calendar parts and the length of their cycles.
CYCLES = {"month": 12, "dow": 7, "hour": 24}


def datetime_expand(state: Shaped, step: Step) -> dict:
    """Calendar parts (Monday is 0), optionally with sine and cosine of their cycle."""
    parts = step.params.get("parts", ["year", "month", "dow", "hour"])
    made = {}
    for c in step.columns:
        t = F.expr(f"try_cast(`{c}` AS timestamp)")
        whole = {"year": F.year(t), "month": F.month(t), "day": F.dayofmonth(t), "dow": F.weekday(t), "hour": F.hour(t),
                 "is_weekend": (F.weekday(t) >= 5).cast("int")}
        for part in parts:
            made[f"{c}_{part}"] = whole[part].cast("long")
        if step.params.get("cyclic"):
            for part, length in CYCLES.items():
                if part in parts:
                    angle = 2 * math.pi * whole[part].cast("double") / length
                    made[f"{c}_{part}_sin"], made[f"{c}_{part}_cos"] = F.sin(angle), F.cos(angle)
    state.df = state.df.withColumns(made)
    return {"added": list(made)}


def lag(state: Shaped, step: Step) -> dict:
    """Earlier values along time within each part (and group); no part sees another's rows."""
    p = step.params
    lags = [int(x) for x in p.get("lags", [1])]
    group = p.get("group_by")
    keys = ["_part"] + (["_lag_group"] if group else [])
    # rows without a time come last, as in a stable sort
    df = state.df.withColumn("_lag_at", F.coalesce(F.unix_micros(F.expr(f"try_cast(`{p['time_column']}` AS timestamp)")).cast("double"), F.lit(9.0e18))
                             if p.get("time_column") else F.col(state.row_id).cast("double"))
    if group:
        df = df.withColumn("_lag_group", F.coalesce(F.col(group).cast("string"), F.lit("<null>")))
    placed = with_position(df, keys, "_lag_at", state.row_id)
    shifts = {f"{c}_lag{k}": (c, k) for c in step.columns for k in lags}
    state.df = with_lags(placed, keys, shifts).drop("_pos", "_lag_at", "_lag_group")
    return {"lags": lags, "added": list(shifts)}


OPERATIONS = {"impute": impute, "clip": clip, "winsorize": winsorize, "transform": transform, "bin": bin_values,
              "datetime_expand": datetime_expand, "lag": lag}
