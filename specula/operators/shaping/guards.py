"""Rules that a recipe must keep, each one a guard over the planned steps."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from functools import cached_property
from itertools import accumulate, pairwise
from typing import Any

GUARDS: list[Callable[[Plan], Iterator[str]]] = []


class Plan:
    """The steps with what several guards ask about them."""

    def __init__(self, steps: list[Any], geometry: Any, phase_of: dict[str, int], learns: Callable[[Any], bool]):
        self.steps, self.geometry, self.learns = steps, geometry, learns
        self.phases = [s.params.get("phase") if s.op == "custom" else phase_of.get(s.op) for s in steps]

    def of(self, *ops: str) -> list[tuple[int, Any]]:
        return [(i, s) for i, s in enumerate(self.steps) if s.op in ops]

    @cached_property
    def split(self) -> tuple[int, Any] | None:
        return next(iter(self.of("split")), None)

    @cached_property
    def label(self) -> str | None:
        return next((s.params.get("label") for _, s in self.of("select_partition")), None)

    @cached_property
    def leaking(self) -> set[str]:
        """Columns that would give the chosen label away."""
        chosen = self.geometry.partition(self.label) if self.geometry else None
        return set(chosen.leakage) if chosen else set()

    @cached_property
    def held(self) -> set[str]:
        """Columns that some step is told to keep."""
        named = [c for _, s in self.of("drop_derived") for c in s.params.get("keep", [])]
        return {*named, *(c for _, s in self.of("keep_columns") for c in s.params.get("columns") or s.columns)}


def guard(rule: Callable[[Plan], Iterator[str]]):
    GUARDS.append(rule)
    return rule


def faults(plan: Plan) -> list[str]:
    return [said for rule in GUARDS for said in rule(plan)] if plan.steps else ["no steps"]


@guard
def names(plan: Plan):
    for name, n in Counter(s.id for s in plan.steps).items():
        if not name:
            yield f"{n} steps are without an id"
        elif n > 1:
            yield f"{n} steps are called {name}"


@guard
def known_operations(plan: Plan):
    yield from (f"{s.id}: no operation is called {s.op!r}" for s, phase in zip(plan.steps, plan.phases) if phase is None and s.op != "custom")


@guard
def custom_steps(plan: Plan):
    wanted = {"phase": ("a phase from 1 to 6", lambda s: s.params.get("phase") in range(1, 7)), "function": ("a function", lambda s: callable(s.params.get("function"))),
              "source": ("a user who asks for it", lambda s: s.source.startswith("user"))}
    yield from (f"{s.id}: a custom step needs {what}" for _, s in plan.of("custom") for what, ok in wanted.values() if not ok(s))


@guard
def phases_only_grow(plan: Plan):
    placed = [(s, p) for s, p in zip(plan.steps, plan.phases) if isinstance(p, int)]
    highest = accumulate((p for _, p in placed), max)
    for before, (s, p) in zip([0, *highest], placed):
        if p < before:
            yield f"{s.id}: phase {p} is over, phase {before} has begun"


@guard
def one_split(plan: Plan):
    yield from (f"{b.id}: {a.id} has split the rows already" for (_, a), (_, b) in pairwise(plan.of("split")))


@guard
def learning_after_the_split(plan: Plan):
    if plan.split:
        yield from (f"{s.id}: what {s.op} learns before {plan.split[1].id} comes from test rows too" for s in plan.steps[:plan.split[0]] if plan.learns(s))
    else:
        yield from (f"{s.id}: without a split, target means would come from the rows they describe" for _, s in plan.of("encode") if s.params.get("strategy") == "target")


@guard
def lags_see_their_neighbours(plan: Plan):
    kind = plan.split[1].params.get("kind", "random") if plan.split else None
    if kind in ("random", "stratified"):
        yield from (f"{s.id}: a {kind} split has scattered the rows that a lag looks back on" for i, s in plan.of("lag") if i > plan.split[0])


@guard
def places_have_a_reference(plan: Plan):
    yield from (f"{s.id}: crs is not declared" for _, s in plan.of("parse_geometry") if not s.params.get("crs"))
    first = min((i for i, _ in plan.of("parse_geometry")), default=len(plan.steps))
    yield from (f"{s.id}: no geometry has been parsed yet" for s in plan.steps[:first] if s.op.startswith("spatial_"))


@guard
def the_label_is_a_candidate(plan: Plan):
    if plan.geometry and plan.geometry.partitions and plan.label and plan.geometry.partition(plan.label) is None:
        yield f"{plan.label!r} is no label candidate"


@guard
def nothing_leaks(plan: Plan):
    if plan.leaking and not plan.of("drop_leakage"):
        yield f"{', '.join(sorted(plan.leaking))} tell {plan.label!r}; a drop_leakage step is missing"
    if kept := plan.leaking & plan.held:
        yield f"{', '.join(sorted(kept))} tell {plan.label!r} and are asked to stay"


@guard
def the_basis_stays(plan: Plan):
    basis = set(plan.geometry.basis) if plan.geometry else set()
    for _, s in plan.of("drop_identity", "drop_constant", "select_features"):
        if (lost := basis.intersection(s.columns)) and not s.source.startswith("user"):
            yield f"{s.id}: only a user may drop {', '.join(sorted(lost))} of the basis"


@guard
def derivations_stay_whole(plan: Plan):
    live = dict(plan.geometry.derivations) if plan.geometry else {}
    if plan.of("drop_derived"):
        live = {head: body for head, body in live.items() if head in plan.held}
    for _, s in plan.of("transform"):
        for head, body in live.items():
            inside = {head, *body} & set(s.columns)
            if inside and inside != {head, *body}:
                yield f"{s.id}: {head} would no longer follow from {', '.join(body)}"
