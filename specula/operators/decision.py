"""Decision tables over rows: rules become boolean columns, policies pick among the hits."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from itertools import combinations
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

POLICIES = ("U", "A", "P", "F", "C", "C+", "C<", "C>", "C#", "R", "O")


@dataclass
class Is:
    """A cell: equal to a value (None is null)."""
    value: Any
    negated: bool = False

    def test(self, c: Column) -> Column:
        hit = c.isNull() if self.value is None else F.coalesce(c == F.lit(self.value), F.lit(False))
        return ~hit if self.negated else hit


@dataclass
class Compare:
    """A cell: > >= < <= = != against a number or text."""
    op: str
    value: Any

    def test(self, c: Column) -> Column:
        ops = {">": c > self.value, ">=": c >= self.value, "<": c < self.value, "<=": c <= self.value, "=": c == self.value, "!=": c != self.value}
        return F.coalesce(ops[self.op], F.lit(False))


@dataclass
class Between:
    """A cell: an interval, each end open or closed, or unbounded (None)."""
    low: float | None
    high: float | None
    closed_low: bool = True
    closed_high: bool = False

    def test(self, c: Column) -> Column:
        hit = c.isNotNull()
        if self.low is not None:
            hit = hit & (c >= self.low if self.closed_low else c > self.low)
        if self.high is not None:
            hit = hit & (c <= self.high if self.closed_high else c < self.high)
        return F.coalesce(hit, F.lit(False))


ANY = None  # a cell that does not care


@dataclass
class Row:
    cells: list
    output: Any


@dataclass
class Table:
    name: str
    policy: str
    inputs: list[str]
    rows: list[Row]
    output: str
    priorities: list = field(default_factory=list)

    def hit(self, row: Row, columns: dict[str, str]) -> Column:
        tests = [cell.test(F.col(f"`{columns.get(c, c)}`")) for c, cell in zip(self.inputs, row.cells) if cell is not ANY]
        return reduce(lambda a, b: a & b, tests) if tests else F.lit(True)


def lint(tables: list[Table]) -> list[str]:
    """Faults that need no data: cell counts, policies, names, repeated tables, empty tables."""
    errors = []
    names = [t.name for t in tables]
    errors += [f"{n}: the name is used twice" for n in sorted({n for n in names if names.count(n) > 1})]
    for t in tables:
        if t.policy not in POLICIES:
            errors.append(f"{t.name}: unknown policy {t.policy!r}")
        if not t.rows:
            errors.append(f"{t.name}: no rules")
        for i, row in enumerate(t.rows):
            if len(row.cells) != len(t.inputs):
                errors.append(f"{t.name}: rule {i + 1} has {len(row.cells)} cells for {len(t.inputs)} inputs")
        if t.policy == "F" and len(t.inputs) == 1 and all(isinstance(r.cells[0], Is) and not r.cells[0].negated for r in t.rows if r.cells):
            errors.append(f"{t.name}: rules look disjoint, policy U says so")
    for a, b in combinations(tables, 2):
        if [(repr(r.cells), r.output) for r in a.rows] == [(repr(r.cells), r.output) for r in b.rows] and a.rows:
            errors.append(f"{a.name} and {b.name} repeat the same rules: share one table")
    return errors


def hits(table: Table, columns: dict[str, str] | None = None) -> Column:
    """The 1-based numbers of the rules that match, in rule order."""
    columns = columns or {}
    marks = [F.when(table.hit(r, columns), F.lit(i + 1)) for i, r in enumerate(table.rows)]
    return F.array_compact(F.array(*marks))


def decide(df: DataFrame, table: Table, columns: dict[str, str] | None = None, output: str | None = None) -> DataFrame:
    """Add the decision, and a struct ``<output>_trace`` with the rules that fired.

    U and A give null when several rules disagree (U: when several match at all).
    """
    errors = lint([table])
    if any("look disjoint" not in e for e in errors):
        raise ValueError("; ".join(errors))
    name = output or table.output
    outputs = F.array(*[F.lit(r.output) for r in table.rows])
    fired = F.col("_hits")
    values = F.transform(fired, lambda i: F.get(outputs, i - 1))
    first = F.get(outputs, F.get(fired, F.lit(0)) - 1)
    by_rank = None
    if table.policy in ("P", "O"):
        order = table.priorities or sorted({r.output for r in table.rows}, reverse=True)
        place = F.create_map(*[x for i, v in enumerate(order) for x in (F.lit(v), F.lit(i))])
        by_rank = F.transform(F.array_sort(F.transform(values, lambda v: F.struct(place[v].alias("r"), v.alias("v")))), lambda e: e["v"])
    number = F.transform(values, lambda v: v.cast("double"))
    result = {
        "U": lambda: F.when(F.size(fired) == 1, first), "A": lambda: F.when(F.size(F.array_distinct(values)) == 1, first),
        "F": lambda: first, "P": lambda: F.get(by_rank, F.lit(0)), "R": lambda: values, "C": lambda: values, "O": lambda: by_rank,
        "C+": lambda: F.aggregate(number, F.lit(0.0), lambda a, b: a + b), "C<": lambda: F.array_min(number),
        "C>": lambda: F.array_max(number), "C#": lambda: F.size(fired).cast("long"),
    }[table.policy]()
    out = df.withColumn("_hits", hits(table, columns))
    return out.withColumn(name, result).withColumn(
        f"{name}_trace", F.struct(fired.alias("rules"), F.col(name).cast("string").alias("value"))).drop("_hits")


@dataclass
class Invoke:
    """Run a table with other columns bound to its inputs, under another output name."""
    table: str
    bindings: dict[str, str]
    output: str


@dataclass
class Combine:
    """Combine other results: sum, max or min."""
    op: str
    operands: list[str]
    output: str


def decide_chain(df: DataFrame, tables: list[Table], nodes: list, lone: list[str] | None = None) -> DataFrame:
    """Run tables, invocations and combinations in dependency order, whatever order they come in.

    Tables that are only invoked are not run by themselves.
    """
    by_name = {t.name: t for t in tables}
    invoked = {n.table for n in nodes if isinstance(n, Invoke)}
    todo = [("table", t) for t in tables if t.name not in invoked or t.name in (lone or [])] + [("node", n) for n in nodes]
    while todo:
        ready = [x for x in todo if all(c in df.columns for c in _needs(x))]
        if not ready:
            raise ValueError(f"nothing provides {sorted({c for x in todo for c in _needs(x) if c not in df.columns})}")
        for kind, item in ready:
            if kind == "table":
                df = decide(df, item)
            elif isinstance(item, Invoke):
                df = decide(df, by_name[item.table], item.bindings, item.output)
            else:
                known = [F.col(f"`{c}`").cast("double") for c in item.operands]
                whole = {"sum": lambda: reduce(lambda a, b: a + b, known), "max": lambda: F.greatest(*known), "min": lambda: F.least(*known)}[item.op]()
                df = df.withColumn(item.output, whole)
        todo = [x for x in todo if x not in ready]
    return df


def _needs(entry) -> list[str]:
    kind, item = entry
    if kind == "table":
        return item.inputs
    return list(item.bindings.values()) if isinstance(item, Invoke) else item.operands


def coverage(df: DataFrame, table: Table) -> DataFrame:
    """(table, rows, unmatched, several): rows no rule matches and rows several rules match."""
    n = F.size(hits(table))
    return df.agg(F.lit(table.name).alias("table"), F.count(F.lit(1)).alias("rows"),
                  F.sum((n == 0).cast("long")).alias("unmatched"), F.sum((n > 1).cast("long")).alias("several"))


def rule_overlaps(df: DataFrame, table: Table) -> DataFrame:
    """(first, second, rows): how many rows each pair of rules shares."""
    tests = [table.hit(r, {}) for r in table.rows]
    pairs = list(combinations(range(len(tests)), 2))
    row = df.agg(*[F.sum((tests[i] & tests[j]).cast("long")).alias(f"p{i}_{j}") for i, j in pairs])
    return row.select(F.inline(F.array(*[F.struct(F.lit(i + 1).cast("long").alias("first"), F.lit(j + 1).cast("long").alias("second"), F.col(f"p{i}_{j}").alias("rows")) for i, j in pairs]))).filter("rows > 0")


def interval_gaps(spark: SparkSession, table: Table, column: str) -> DataFrame:
    """(low, high, issue): gaps between the intervals of one input, and end points shared by two."""
    at = table.inputs.index(column)
    cells = [r.cells[at] for r in table.rows if isinstance(r.cells[at], Between)]
    rows = [(float(c.low) if c.low is not None else float("-inf"), float(c.high) if c.high is not None else float("inf"), c.closed_low, c.closed_high) for c in cells]
    spans = spark.createDataFrame(rows, "low double, high double, closed_low boolean, closed_high boolean")
    w = Window.partitionBy(F.lit(0)).orderBy("low")  # one row per rule
    # an interval is compared with the furthest end so far, not with the end of the one before it
    reach = F.max(F.struct("high", F.col("closed_high").alias("closed"))).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    nxt = (spans.withColumn("reach", reach).withColumn("next", F.lead("low").over(w)).withColumn("next_closed", F.lead("closed_low").over(w))
           .withColumn("high", F.col("reach.high")).withColumn("closed_high", F.col("reach.closed")))
    issue = (F.when(F.col("next") > F.col("high"), "gap").when((F.col("next") == F.col("high")) & ~F.col("closed_high") & ~F.col("next_closed"), "point not covered")
             .when((F.col("next") == F.col("high")) & F.col("closed_high") & F.col("next_closed"), "point covered twice")
             .when(F.col("next") == F.col("high"), "shared end point").when(F.col("next") < F.col("high"), "overlap"))
    return nxt.filter("next IS NOT NULL").select(F.col("high").alias("low"), F.col("next").alias("high"), issue.alias("issue"))


def boundary_rows(spark: SparkSession, table: Table, step: float = 1.0) -> DataFrame:
    """Test rows at and around every interval end and literal of each input, in all combinations.

    Their number depends on the rules alone.
    """
    out = None
    for i, c in enumerate(table.inputs):
        values: set = set()
        for r in table.rows:
            cell = r.cells[i]
            if isinstance(cell, Between):
                values |= {v + d for v in (cell.low, cell.high) if v is not None for d in (-step, 0.0, step)}
            elif isinstance(cell, Compare):
                values |= {cell.value + d for d in (-step, 0.0, step)} if isinstance(cell.value, (int, float)) else {cell.value}
            elif isinstance(cell, Is) and cell.value is not None:
                values.add(cell.value)
        ordered = sorted(values)
        kind = "double" if all(isinstance(v, (int, float)) for v in ordered) else "string"
        choices = F.array(*[F.lit(v).cast(kind) for v in ordered], F.lit(None).cast(kind))
        out = spark.range(1).select(F.explode(choices).alias(c)) if out is None else out.withColumn(c, F.explode(choices))
    return out
