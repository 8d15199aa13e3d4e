"""Steps, guards that run before the first job, and the runner with its manifest and lineage."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specula.operators.shaping.guards import Plan, faults

# The phase each operation belongs to; phases never go backwards.
PHASES = {
    "retype": 1, "drop_identity": 1, "drop_constant": 1, "dedupe": 1, "parse_datetime": 1, "parse_geometry": 1,
    "orient_cycle": 2, "drop_derived": 2, "select_partition": 2, "drop_leakage": 2, "keep_columns": 2,
    "split": 3,
    "impute": 4, "clip": 4, "winsorize": 4, "transform": 4, "bin": 4, "datetime_expand": 4, "lag": 4,
    "spatial_reproject": 4, "spatial_distance": 4, "spatial_join": 4, "spatial_grid": 4, "spatial_features": 4,
    "encode": 5, "scale": 5, "project": 5,
    "select_features": 6,
}
CHANGES_ROWS = {"dedupe", "split", "spatial_join", "custom"}


@dataclass
class Step:
    id: str
    op: str
    columns: list[str] = field(default_factory=list)
    params: dict[str, Any] = field(default_factory=dict)
    source: str = "default"
    why: str = ""


@dataclass
class Cycle:
    """Columns that determine each other: orientation -> the columns it derives."""
    id: str
    members: list[str]
    orientations: dict[str, list[str]]
    default: str


@dataclass
class Partition:
    label: str
    features: list[str] = field(default_factory=list)
    leakage: list[str] = field(default_factory=list)
    task: str = "classification"


@dataclass
class Geometry:
    """What is known about the columns: roles, basis, derivations, cycles, label candidates."""
    roles: dict[str, str] = field(default_factory=dict)
    basis: list[str] = field(default_factory=list)
    derivations: dict[str, list[str]] = field(default_factory=dict)
    cycles: list[Cycle] = field(default_factory=list)
    partitions: list[Partition] = field(default_factory=list)

    def partition(self, label: str | None) -> Partition | None:
        return next((p for p in self.partitions if p.label == label), None)


@dataclass
class Shaped:
    """The table so far, with everything later steps and reports need."""
    df: DataFrame
    row_id: str
    geometry: Geometry
    seed: int
    label: str | None = None
    planned_label: str | None = None
    split: str | None = None
    crs: str | None = None
    lat: str | None = None
    lon: str | None = None
    centre: tuple[float, float] | None = None
    levels: dict[str, list[str]] = field(default_factory=dict)
    orientation: dict[str, str] = field(default_factory=dict)
    fitted: dict[str, dict] = field(default_factory=dict)
    manifest: list[dict] = field(default_factory=list)
    removed: dict[str, tuple[str, str]] = field(default_factory=dict)
    touched: list[tuple[str, str, str, str]] = field(default_factory=list)

    @property
    def columns(self) -> list[str]:
        return [c for c in self.df.columns if c not in ("_part",)]

    @property
    def features(self) -> list[str]:
        return [c for c in self.columns if c not in (self.row_id, self.target)]

    @property
    def target(self) -> str | None:
        return self.label or self.planned_label

    @property
    def fit_rows(self) -> DataFrame:
        return self.df.filter(F.col("_part") == "train") if self.split else self.df

    @property
    def fit_part(self) -> str:
        return "train" if self.split else "all"

    def counts(self) -> dict[str, int]:
        return {r["_part"]: r["n"] for r in self.df.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}

    def drop(self, step: Step, columns: list[str], why: str) -> dict:
        """Drop columns; the label only goes when a user's own step names it."""
        gone = [c for c in columns if c in self.columns and c != self.row_id]
        if self.target in gone and not (step.source.startswith("user") and self.target in step.columns):
            gone.remove(self.target)
        self.df = self.df.drop(*gone)
        for c in gone:
            self.removed[c] = (step.id, why)
        return {"dropped": gone}

    def lineage(self) -> DataFrame:
        """(column, step_id, action, reason)."""
        rows = self.touched + [(c, s, "removed", why) for c, (s, why) in self.removed.items()]
        return self.df.sparkSession.createDataFrame(rows, "column string, step_id string, action string, reason string")

    def manifest_table(self) -> DataFrame:
        """One row per step: rows per part before and after, columns added and removed, fitted values."""
        import json
        rows = [(m["id"], m["op"], m["fit_on"], m["rows_before"], m["rows_after"], m["columns_added"], m["columns_removed"],
                 json.dumps(m["fitted"], default=str, sort_keys=True)) for m in self.manifest]
        return self.df.sparkSession.createDataFrame(rows, (
            "step_id string, op string, fit_on string, rows_before map<string,long>, rows_after map<string,long>, "
            "columns_added array<string>, columns_removed array<string>, fitted string"))

    def output_schema(self) -> DataFrame:
        """(column, dtype, origin, role) of the shaped table."""
        origin = {}
        for c, step, action, _ in self.touched:
            if action == "added":
                origin[c] = step
        rows = [(f.name, f.dataType.simpleString(), origin.get(f.name, "input"),
                 "label" if f.name == self.target else "row_id" if f.name == self.row_id else "feature")
                for f in self.df.schema.fields if f.name != "_part"]
        return self.df.sparkSession.createDataFrame(rows, "column string, dtype string, origin string, role string")


def fits(step: Step) -> bool:
    """Whether the step learns anything from rows."""
    if step.op in ("impute", "encode", "scale", "project", "winsorize", "spatial_reproject", "spatial_distance",
                   "spatial_features", "select_features"):
        return not (step.op == "impute" and step.params.get("strategy") == "constant") \
            and not (step.op == "encode" and step.params.get("strategy") == "hashing")
    if step.op == "bin":
        return step.params.get("kind", "quantile") != "custom"
    if step.op == "transform":
        return step.params.get("kind") in ("box-cox", "yeo-johnson")
    if step.op == "spatial_grid":
        return bool(step.params.get("aggregate"))
    return False


def check(steps: list[Step], geometry: Geometry | None = None) -> list[str]:
    """Every reason to refuse the recipe, found before any data is touched."""
    return faults(Plan(steps, geometry, PHASES, fits))


def operations() -> dict[str, Callable[[Shaped, Step], dict]]:
    from specula.operators.shaping import columns, features, rows, space, values
    out: dict[str, Callable] = {}
    for module in (columns, rows, values, features, space):
        out.update(module.OPERATIONS)
    return out


def run(df: DataFrame, steps: list[Step], row_id: str, geometry: Geometry | None = None, seed: int = 7) -> Shaped:
    """Apply the steps in order. Fitted values are small and come from the training part."""
    geometry = geometry or Geometry()
    errors = check(steps, geometry)
    if errors:
        raise ValueError("; ".join(errors))
    state = Shaped(df.withColumn("_part", F.lit("all")), row_id, geometry, seed)
    state.planned_label = next((s.params.get("label") for s in steps if s.op == "select_partition"), None)
    ops = operations()
    rows = state.counts()
    for step in steps:
        before, rows_before = state.columns, rows
        fitted = ops[step.op](state, step) or {}
        after = state.columns
        if step.op in CHANGES_ROWS:
            rows = state.counts()
        added = [c for c in after if c not in before]
        state.touched += [(c, step.id, "added", step.why or step.op) for c in added]
        state.touched += [(c, step.id, "changed", step.why or step.op) for c in step.columns if c in before and c in after]
        state.fitted[step.id] = fitted
        state.manifest.append({"id": step.id, "op": step.op, "fit_on": state.fit_part if fits(step) else None,
                               "rows_before": rows_before, "rows_after": rows, "columns_added": added,
                               "columns_removed": [c for c in before if c not in after], "fitted": fitted})
    return state


def preset(name: str, geometry: Geometry, types: dict[str, str], label: str | None = None,
           time_column: str | None = None, coordinates: tuple[str, str, str] | None = None, halves: str = "even") -> list[Step]:
    """Ready-made step lists by phase; ``coordinates`` is (lat, lon, crs), ``halves`` goes to the split."""
    identity = [c for c, r in geometry.roles.items() if r in ("identity", "key")]
    steps = []
    if coordinates and name in ("train-ready", "spatial-features"):
        lat, lon, crs = coordinates
        steps.append(Step("geometry", "parse_geometry", params={"crs": crs, "lat": lat, "lon": lon}))
    steps.append(Step("dedupe", "dedupe"))
    if name == "custom":
        return steps
    steps += [Step("identity", "drop_identity", identity), Step("constant", "drop_constant")]
    if name in ("train-ready", "basis-only"):
        steps.append(Step("derived", "drop_derived"))
    if name == "basis-only":
        return steps + [Step("basis", "keep_columns", params={"columns": geometry.basis})]
    if label:
        steps.append(Step("label", "select_partition", params={"label": label}))
        part = geometry.partition(label)
        if part and part.leakage:
            steps.append(Step("leakage", "drop_leakage"))
    if name == "clean":
        return steps
    kind = {"kind": "time", "time_column": time_column} if time_column else {"kind": "stratified", "by": label} if label else {"kind": "random"}
    steps.append(Step("split", "split", params={**kind, "test": 0.2, "valid": 0.1, "halves": halves}))
    gone = {*identity, *geometry.derivations, label, time_column, *((geometry.partition(label).leakage if label and geometry.partition(label) else []))}
    numeric = [c for c, t in types.items() if t == "numeric" and c not in gone]
    nominal = [c for c, t in types.items() if t in ("nominal", "boolean") and c not in gone]
    if numeric:
        steps.append(Step("gaps", "impute", numeric, {"strategy": "median", "indicator": False}))
    if time_column:
        steps.append(Step("calendar", "datetime_expand", [time_column], {"cyclic": True}))
    if coordinates and name in ("train-ready", "spatial-features"):
        steps.append(Step("metres", "spatial_reproject"))
        if name == "spatial-features":
            steps.append(Step("neighbours", "spatial_features", params={"radius_m": 500.0, "features": ["n_neighbours_within", "nearest_distance", "centroid_x", "centroid_y"]}))
    if name == "train-ready":
        if nominal:
            steps.append(Step("codes", "encode", nominal, {"strategy": "one-hot"}))
        steps.append(Step("scale", "scale", params={"kind": "standard", "columns": numeric}))
    return steps
