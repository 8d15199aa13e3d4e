"""Phases 1 and 2: typing, dropping and choosing columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from specula.operators.shaping.recipe import Shaped, Step
from specula.operators.typing import constant_columns


def retype(state: Shaped, step: Step) -> dict:
    to = step.params["to"]
    casts = {}
    for c in step.columns:
        if to == "numeric":
            casts[c] = F.expr(f"try_cast(`{c}` AS double)")
        elif to in ("nominal", "text"):
            casts[c] = F.col(c).cast("string")
        elif to == "ordinal":
            order = [str(x) for x in step.params.get("order", [])]
            state.levels[c] = order
            casts[c] = F.when(F.col(c).cast("string").isin(order), F.col(c).cast("string"))
        elif to == "boolean":
            casts[c] = F.expr(f"try_cast(`{c}` AS boolean)")
        elif to == "datetime":
            casts[c] = F.expr(f"try_cast(`{c}` AS timestamp)")
        else:
            raise ValueError(f"cannot retype to {to!r}")
    state.df = state.df.withColumns(casts)
    return {"to": to}


def drop_identity(state: Shaped, step: Step) -> dict:
    roles = [c for c, r in state.geometry.roles.items() if r in ("identity", "key")]
    return state.drop(step, step.columns or roles, "identity or key")


def drop_constant(state: Shaped, step: Step) -> dict:
    tolerance = float(step.params.get("tolerance", 0.0))
    names = step.columns
    if not names:
        found = constant_columns(state.fit_rows, tolerance, [c for c in state.columns if c != state.row_id])
        names = [r["column"] for r in found.collect()]
    return state.drop(step, sorted(names), f"constant within {tolerance}")


def parse_datetime(state: Shaped, step: Step) -> dict:
    form, errors = step.params.get("format"), step.params.get("errors", "coerce")
    parsed = {}
    for c in step.columns:
        s = F.col(c).cast("string")
        if form:
            parsed[c] = F.try_to_timestamp(s, F.lit(form)) if errors == "coerce" else F.to_timestamp(s, form)
        else:
            parsed[c] = F.expr(f"try_cast(`{c}` AS timestamp)") if errors == "coerce" else F.col(c).cast("timestamp")
    lost = state.fit_rows.agg(*[F.sum((F.col(c).isNotNull() & e.isNull()).cast("long")).alias(c) for c, e in parsed.items()]).first() \
        if errors == "coerce" else {c: 0 for c in parsed}
    state.df = state.df.withColumns(parsed)
    return {"lost": {c: int(lost[c] or 0) for c in parsed}}


def parse_geometry(state: Shaped, step: Step) -> dict:
    lat, lon = step.params["lat"], step.params["lon"]
    for c in (lat, lon):
        if c not in state.columns:
            raise ValueError(f"{step.id}: there is no column {c!r}")
    state.crs, state.lat, state.lon = step.params["crs"], lat, lon
    outside = ~(F.col(lat).between(-90, 90) & F.col(lon).between(-180, 180))
    bad = state.fit_rows.agg(F.sum(outside.cast("long"))).first()[0]
    return {"crs": state.crs, "out_of_bounds": int(bad or 0)}


def orient_cycle(state: Shaped, step: Step) -> dict:
    name = step.params["cycle"]
    cycle = next(c for c in state.geometry.cycles if c.id == name)
    state.orientation[name] = step.params.get("orientation") or cycle.default
    return {"cycle": name, "orientation": state.orientation[name]}


def active_heads(state: Shaped) -> list[str]:
    """Derived columns under the chosen orientation of every cycle."""
    heads = set(state.geometry.derivations)
    for cycle in state.geometry.cycles:
        derived = cycle.orientations[state.orientation.get(cycle.id, cycle.default)]
        heads -= set(cycle.members) - set(derived)
        heads |= set(derived)
    return sorted(heads)


def drop_derived(state: Shaped, step: Step) -> dict:
    keep = set(step.params.get("keep", []))
    return {**state.drop(step, [h for h in active_heads(state) if h not in keep], "follows from the basis"), "kept": sorted(keep)}


def select_partition(state: Shaped, step: Step) -> dict:
    label = step.params["label"]
    if label not in state.columns:
        raise ValueError(f"{step.id}: there is no column {label!r}")
    state.label = label
    return {"label": label}


def drop_leakage(state: Shaped, step: Step) -> dict:
    part = state.geometry.partition(state.label)
    return state.drop(step, step.columns or (part.leakage if part else []), f"gives {state.label!r} away")


def keep_columns(state: Shaped, step: Step) -> dict:
    wanted = set(step.params.get("columns") or step.columns) | {state.target, state.row_id, "_part"}
    gone = [c for c in state.columns if c not in wanted]
    state.df = state.df.select(*[c for c in state.df.columns if c in wanted])
    for c in gone:
        state.removed[c] = (step.id, "not among the kept columns")
    return {"dropped": gone}


def custom(state: Shaped, step: Step) -> dict:
    before = state.df.columns
    state.df = state.df.transform(lambda d: step.params["function"](d, {"label": state.label, "crs": state.crs, "seed": state.seed}))
    if "_part" not in state.df.columns:
        raise ValueError(f"{step.id}: a custom step keeps the _part column")
    for c in before:
        if c not in state.df.columns:
            state.removed[c] = (step.id, "removed by a custom step")
    return {"verified": False}


OPERATIONS = {"retype": retype, "drop_identity": drop_identity, "drop_constant": drop_constant,
              "parse_datetime": parse_datetime, "parse_geometry": parse_geometry, "orient_cycle": orient_cycle,
              "drop_derived": drop_derived, "select_partition": select_partition, "drop_leakage": drop_leakage,
              "keep_columns": keep_columns, "custom": custom}
