"""Checks of a shaped table against its input and its known derivations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from specula.operators import hypothesis
from specula.operators.derive import formula_check, row_determination
from specula.operators.shaping.columns import active_heads
from specula.operators.shaping.recipe import Shaped
from specula.operators.typing import kind_of

PARTS = ["train", "valid", "test"]


def structural(state: Shaped, kept: list[str] | None = None) -> DataFrame:
    """Label present, leakage gone, derived heads gone unless kept, basis intact: schema only."""
    columns = set(state.columns)
    part = state.geometry.partition(state.label)
    leaked = sorted(set(part.leakage if part else []) & columns)
    derived = sorted((set(active_heads(state)) - set(kept or []) - {state.label}) & columns)
    expanded = {c for c, (_, why) in state.removed.items()}
    lost = sorted(set(state.geometry.basis) - columns - expanded)
    rows = [("label present", state.label is None or state.label in columns, state.label or ""),
            ("leakage gone", not leaked, ",".join(leaked)), ("derived heads gone", not derived, ",".join(derived)),
            ("basis intact", not lost, ",".join(lost))]
    return state.df.sparkSession.createDataFrame(rows, "check string, passed boolean, detail string")


def surviving_derivations(state: Shaped, formulas: dict[str, str]) -> DataFrame:
    """Formulas whose columns all survive must still hold on the output rows."""
    live = {h: f for h, f in formulas.items() if h in state.columns
            and set(state.geometry.derivations.get(h, [])) <= set(state.columns)}
    return formula_check(state.df, live)


def still_determined(source: DataFrame, state: Shaped, head: str, body: list[str]) -> DataFrame:
    """Whether the input's head is still determined by the output's body, joined by row id."""
    joined = state.df.select(state.row_id, *body).join(source.select(state.row_id, F.col(head).alias(head)), state.row_id)
    return row_determination(joined, body, head).withColumn("holds", F.col("determination") >= 0.999)


def untouched_drift(source: DataFrame, state: Shaped, limit: float = 0.25, least: int = 20) -> DataFrame:
    """PSI of output against input for every column that no step names."""
    named = {c for c, _, action, _ in state.touched if action != "added"}
    same = [c for c in source.columns if c in state.columns and c not in named and c != state.row_id]
    both = (source.select(*same, F.lit(True).alias("_in"))
            .union(state.df.select(*[F.col(c).cast(source.schema[c].dataType) for c in same], F.lit(False))))
    numeric = [c for c in same if kind_of(source.schema[c]) == "numeric"]
    other = [c for c in same if c not in numeric]
    out = None
    if numeric:
        marked = both.withColumn("_side", F.when(F.col("_in"), "first").otherwise("rest"))
        ranked = hypothesis.ranked_sides(marked, {"_side": ["first", "rest"]}, numeric)
        out = hypothesis.psi_numeric(ranked.filter((F.col("total_n0") >= least) & (F.col("total_n1") >= least))).select(
            F.col("value_col").alias("column"), "psi")
    if other:
        nominal = hypothesis.psi_categorical(both, other, F.col("_in"))
        out = nominal if out is None else out.union(nominal)
    return out.withColumn("moved", F.col("psi") > limit)


def split_overlap(parts: DataFrame, row_id: str) -> DataFrame:
    """Rows that sit in more than one part (none, in a sound split)."""
    seen = parts.groupBy(row_id).agg(F.min("_part").alias("a"), F.max("_part").alias("b"))
    return seen.agg(F.count(F.lit(1)).alias("rows"), F.sum((F.col("a") != F.col("b")).cast("long")).alias("in_two_parts"))


def group_integrity(parts: DataFrame, key: str) -> DataFrame:
    """Keys that straddle parts."""
    seen = parts.groupBy(key).agg(F.min("_part").alias("a"), F.max("_part").alias("b"))
    return seen.agg(F.count(F.lit(1)).alias("keys"), F.sum((F.col("a") != F.col("b")).cast("long")).alias("straddling"))


def time_order(parts: DataFrame, column: str) -> DataFrame:
    """(part, first, last, in_order): no part starts before the one ahead of it ends."""
    rank = F.array_position(F.array(*[F.lit(p) for p in PARTS]), F.col("_part"))
    spans = parts.groupBy("_part").agg(F.min(column).alias("first"), F.max(column).alias("last")).withColumn("r", rank)
    before = F.lag("last").over(Window.partitionBy(F.lit(0)).orderBy("r"))  # one row per part
    return spans.select("_part", "first", "last", F.coalesce(before <= F.col("first"), F.lit(True)).alias("in_order"))


def label_rates(source: DataFrame, parts: DataFrame, label: str, tolerance: float = 0.15) -> DataFrame:
    """The label rate of every part against the whole input."""
    whole = source.agg(F.avg(F.col(label).cast("double")).alias("whole"))
    rates = parts.groupBy("_part").agg(F.avg(F.col(label).cast("double")).alias("rate"))
    return (rates.join(F.broadcast(whole), F.lit(True))
            .select("_part", "rate", "whole", (F.abs(F.col("rate") - F.col("whole")) <= tolerance).alias("within")))


def coordinate_bounds(state: Shaped) -> DataFrame:
    """Coordinates of the output inside their bounds, and a declared reference system."""
    la, lo = F.col(state.lat), F.col(state.lon)
    return state.df.agg(F.sum((~la.between(-90, 90)).cast("long")).alias("lat_out"), F.sum((~lo.between(-180, 180)).cast("long")).alias("lon_out")) \
        .select("lat_out", "lon_out", F.lit(state.crs is not None).alias("crs_declared"))
