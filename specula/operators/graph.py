"""Inference over statements: closures, rules, contradictions and patterns as joins.

Facts are rows (s, p, o, kind); membership is p = 'type', kind = 'class'. A vocabulary is a
handful of DataFrames. Loops carry only what the last round added, checkpoint every round and
stop when a round adds nothing.
"""

from __future__ import annotations

from itertools import count

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from specula.session import dealt, settle

FACT = ["s", "p", "o", "kind"]
FEW = 10_000  # rows of a vocabulary that may be broadcast
TYPE = "type"


@dataclass
class Vocabulary:
    """What the statements mean: (child, parent) pairs, property traits and class pairs."""
    sub_class: DataFrame            # child, parent
    sub_property: DataFrame         # child, parent
    traits: DataFrame               # p, trait: symmetric | transitive | functional | inverse-functional
    inverse: DataFrame              # p, q
    disjoint: DataFrame             # a, b


def vocabulary(spark: SparkSession, sub_class=(), sub_property=(), traits=(), inverse=(), disjoint=(), equivalent=()) -> Vocabulary:
    """Build a vocabulary from Python pairs; equivalent classes are two sub-class edges."""
    both = [*equivalent, *[(b, a) for a, b in equivalent]]
    make = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    return Vocabulary(make([*sub_class, *both], "child string, parent string"), make(sub_property, "child string, parent string"),
                      make(traits, "p string, trait string"), make(inverse, "p string, q string"), make(disjoint, "a string, b string"))


def seed(statements: DataFrame) -> tuple[DataFrame, Vocabulary]:
    """Split statements about statements (subClassOf, equivalentClass, ...) from plain facts."""
    pick = lambda p, a, b: statements.filter(F.col("p") == p).select(F.col("s").alias(a), F.col("o").alias(b))
    equal = pick("equivalentClass", "child", "parent")
    sub = pick("subClassOf", "child", "parent").union(equal).union(equal.select(F.col("parent").alias("child"), F.col("child").alias("parent"))).distinct()
    schema = ["equivalentClass", "subClassOf", "subPropertyOf", "trait", "inverseOf", "disjointWith"]
    facts = statements.filter(~F.col("p").isin(schema))
    return facts, Vocabulary(sub, pick("subPropertyOf", "child", "parent"), pick("trait", "p", "trait"), pick("inverseOf", "p", "q"), pick("disjointWith", "a", "b"))


def few(table: DataFrame) -> DataFrame:
    """A vocabulary's table for a join with facts: few rows are broadcast, so that facts with one property or class stay where they are."""
    return F.broadcast(table) if table.limit(FEW + 1).count() <= FEW else table


# ------------------------------------------------------------------ closures

def transitive_closure(edges: DataFrame, keep_loops: bool = False) -> DataFrame:
    """All (child, parent) pairs; paths double each round, so depth d needs log2(d) rounds.

    Pairs know the steps of their shortest path. A round puts the paths of exactly 2**k steps before all paths of up to
    2**k, so a shortest path is cut in one place and not found again for every cut.
    """
    pairs = edges.select("child", "parent")
    known = settle(dealt(pairs, pairs.count(), "child", "parent").distinct().withColumn("steps", F.lit(1)))
    reach = 1
    while True:
        heads = known.filter(F.col("steps") == reach).select("child", F.col("parent").alias("mid"))
        tails = known.select(F.col("child").alias("mid"), "parent", "steps")
        per = lambda d, n: d.groupBy("mid").agg(F.count(F.lit(1)).alias(n))
        met = per(heads, "a").join(per(tails, "b"), "mid").agg(F.sum(F.col("a") * F.col("b"))).first()[0]
        if not met:
            break
        rows = known.count()
        grown = (dealt(heads, rows, "mid").join(dealt(tails, rows, "mid"), "mid")
                 .select("child", "parent", (F.col("steps") + reach).alias("steps")))
        first = dealt(grown, rows + met, "child", "parent").groupBy("child", "parent").agg(F.min("steps").alias("steps"))
        new = settle(first.join(dealt(known.select("child", "parent"), rows + met, "child", "parent"), ["child", "parent"], "left_anti"))
        known, reach = known.union(new), 2 * reach  # both sides are written already
    known = known.select("child", "parent")
    return known if keep_loops else known.filter("child <> parent")


def subclass_cycles(sub_class: DataFrame) -> DataFrame:
    """Classes that are, through others, their own super class."""
    return transitive_closure(sub_class, keep_loops=True).filter("child = parent").select(F.col("child").alias("class"))


def inherited_types(facts: DataFrame, closure: DataFrame) -> DataFrame:
    """Membership in every super class."""
    types = facts.filter(F.col("p") == TYPE)
    closure = few(closure)
    return (types.join(closure, types["o"] == closure["child"]).select("s", "p", F.col("parent").alias("o"), "kind")
            .distinct().join(types.select(*FACT), FACT, "left_anti"))


def propagate(delta: DataFrame, closure: DataFrame, traits: DataFrame, inverse: DataFrame) -> DataFrame:
    """Consequences of sub-properties, symmetry and inverses: (fact, rule, via)."""
    closure = few(closure)
    up = delta.join(closure, delta["p"] == closure["child"]).select("s", F.col("parent").alias("p"), "o", "kind", F.lit("sub-property").alias("rule"), delta["p"].alias("via"))
    objects = delta.filter("kind = 'object'")
    symmetric = traits.filter("trait = 'symmetric'").select("p")
    swap = objects.join(few(symmetric), "p").select(F.col("o").alias("s"), "p", F.col("s").alias("o"), "kind", F.lit("symmetric").alias("rule"), F.col("p").alias("via"))
    pairs = inverse.union(inverse.select(F.col("q").alias("p"), F.col("p").alias("q"))).distinct()
    turned = objects.join(few(pairs), "p").select(F.col("o").alias("s"), F.col("q").alias("p"), F.col("s").alias("o"), "kind", F.lit("inverse").alias("rule"), F.col("p").alias("via"))
    return up.union(swap).union(turned)


def chain(delta: DataFrame, known: DataFrame, traits: DataFrame) -> DataFrame:
    """New links of transitive properties, at least one leg from the last round."""
    transitive = few(traits.filter("trait = 'transitive'").select("p"))
    new, old = (d.filter("kind = 'object'").join(transitive, "p").select("s", "p", "o") for d in (delta, known))
    legs = lambda a, b: a.select("s", "p", F.col("o").alias("mid")).join(b.select(F.col("s").alias("mid"), "p", "o"), ["p", "mid"])
    return (legs(new, old).union(legs(old, new)).filter("s <> o")
            .select("s", "p", "o", F.lit("object").alias("kind"), F.lit("transitive").alias("rule"), F.col("p").alias("via")))


# ------------------------------------------------------------------ rules and patterns

@dataclass
class Atom:
    """(predicate, arguments): '?x' is a variable, anything else a constant."""
    predicate: str
    args: tuple
    negated: bool = False


@dataclass
class Test:
    """A built-in: > >= < <= = <> on two arguments, or + - * / with the result first."""
    op: str
    args: tuple


@dataclass
class Rule:
    name: str
    head: Atom
    body: list = field(default_factory=list)


def is_class(name: str, var: str) -> Atom:
    return Atom(f"class:{name}", (var,))


def has(prop: str, s: str, o) -> Atom:
    return Atom(f"property:{prop}", (s, o))


def fact_relation(facts: DataFrame):
    """How atoms over facts become tables: class:C is unary, property:p is binary."""
    def table(predicate: str) -> DataFrame:
        kind, name = predicate.split(":", 1)
        if kind == "class":
            return facts.filter((F.col("p") == TYPE) & (F.col("o") == name)).select(F.col("s").alias("a0"))
        return facts.filter((F.col("p") == name) & (F.col("kind") != "class")).select(F.col("s").alias("a0"), F.col("o").alias("a1"))
    return table


def _bind(table: DataFrame, args: tuple) -> DataFrame:
    """Constants and repeated variables filter; variables become columns."""
    seen: dict[str, str] = {}
    for i, a in enumerate(args):
        if isinstance(a, str) and a.startswith("?"):
            if a[1:] in seen:
                table = table.filter(F.col(f"a{i}") == F.col(seen[a[1:]]))
            else:
                seen[a[1:]] = f"a{i}"
        elif a is not None:
            table = table.filter(F.col(f"a{i}") == F.lit(a))
    return table.select(*[F.col(c).alias(v) for v, c in seen.items()])


def _value(arg) -> Column:
    return F.col(arg[1:]) if isinstance(arg, str) and arg.startswith("?") else F.lit(arg)


def _apply_test(rows: DataFrame, t: Test) -> DataFrame:
    num = lambda a: _value(a).try_cast("double") if isinstance(a, str) else F.lit(float(a))
    compare = {">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b}
    if t.op in compare:
        return rows.filter(compare[t.op](num(t.args[0]), num(t.args[1])))
    if t.op == "=":
        return rows.filter(_value(t.args[0]) == _value(t.args[1]))
    if t.op == "<>":
        return rows.filter(_value(t.args[0]) != _value(t.args[1]))
    combine = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": lambda a, b: a / F.when(b != 0, b)}[t.op]
    result = reduce(combine, [num(a) for a in t.args[1:]])
    out = t.args[0]
    if isinstance(out, str) and out.startswith("?") and out[1:] not in rows.columns:
        return rows.withColumn(out[1:], result).filter(F.col(out[1:]).isNotNull())
    return rows.filter(num(out) == result)


def match(body: list, table) -> DataFrame:
    """Bindings of the variables of a conjunction: one natural join per atom, absence by anti join.

    ``table`` maps a predicate name to its relation; tests run as soon as they are reached, so
    put them after the atoms that bind their variables.
    """
    rows = None
    for item in body:
        if isinstance(item, Test):
            rows = _apply_test(rows, item)
            continue
        found = _bind(table(item.predicate), item.args)
        if rows is None:
            rows = found
            continue
        shared = [c for c in found.columns if c in rows.columns]
        if item.negated:
            rows = rows.join(found.select(*shared).distinct(), shared, "left_anti")
        else:
            rows = rows.join(found, shared) if shared else rows.join(found, F.lit(True))
    return rows


def pattern_query(facts: DataFrame, patterns: list, select: list[str], distinct: bool = True) -> DataFrame:
    """A basic graph pattern: atoms and tests, then the chosen variables."""
    rows = match(patterns, fact_relation(facts)).select(*[v.lstrip("?") for v in select])
    return rows.distinct() if distinct else rows


def _conclude(rule: Rule, rows: DataFrame) -> DataFrame:
    kind, name = rule.head.predicate.split(":", 1)
    text = lambda a: _value(a).cast("string")
    if kind == "class":
        out = rows.select(text(rule.head.args[0]).alias("s"), F.lit(TYPE).alias("p"), F.lit(name).alias("o"), F.lit("class").alias("kind"))
    else:
        target = "object" if kind == "object" else "value"
        out = rows.select(text(rule.head.args[0]).alias("s"), F.lit(name).alias("p"), text(rule.head.args[1]).alias("o"), F.lit(target).alias("kind"))
    return out.select("*", F.lit("rule").alias("rule"), F.lit(rule.name).alias("via"))


def fire(rule: Rule, delta: DataFrame, known: DataFrame) -> DataFrame:
    """Conclusions whose body uses at least one fact of the last round; absence is asked of all known facts."""
    new, old = fact_relation(delta), fact_relation(known)
    out = None
    atoms = [i for i, b in enumerate(rule.body) if isinstance(b, Atom) and not b.negated]
    for fresh in atoms:
        body = [Atom(f"{i}@{b.predicate}", b.args, b.negated) if isinstance(b, Atom) else b for i, b in enumerate(rule.body)]

        def table(predicate: str, fresh=fresh) -> DataFrame:
            i, name = predicate.split("@", 1)
            return new(name) if int(i) == fresh else old(name)

        one = _conclude(rule, match(body, table))
        out = one if out is None else out.union(one)
    return out


def _strata(rules: list[Rule], words: Vocabulary, up: DataFrame) -> list[list[Rule]]:
    """Rules by stratum: what a rule asks the absence of is complete before the rule fires, axioms included.

    A conclusion feeds an atom if they name the same class or property, or if axioms lead from one to the other:
    sub-classes for classes, sub-properties and inverses for properties. Only pairs that rules name are looked up.
    Stratum 0 has the axioms and the rules that ask for no absence and need nothing of rules that do.
    """
    atoms = {id(r): [b for b in r.body if isinstance(b, Atom)] for r in rules}
    if not any(b.negated for body in atoms.values() for b in body):
        return [rules]

    def split(predicate: str) -> tuple[bool, str]:
        kind, name = predicate.split(":", 1)
        return kind == "class", name
    heads = {split(r.head.predicate) for r in rules}
    asked = {split(b.predicate) for body in atoms.values() for b in body}
    turned = words.inverse.select(F.col("p").alias("child"), F.col("q").alias("parent"))
    links = words.sub_property.select("child", "parent").union(turned).union(turned.select("parent", "child"))
    leads = set()
    for kind, pairs in ((True, up), (False, transitive_closure(links))):
        named = [[n for k, n in names if k == kind] for names in (heads, asked)]
        leads |= {(kind, r["child"], r["parent"]) for r in pairs.filter(F.col("child").isin(named[0]) & F.col("parent").isin(named[1])).collect()}

    def feeds(head: str, predicate: str) -> bool:
        (kind, a), (other, b) = split(head), split(predicate)
        return kind == other and (a == b or (kind, a, b) in leads)
    level = {id(r): int(any(b.negated for b in atoms[id(r)])) for r in rules}
    for _ in range(len(rules) + 1):
        before = dict(level)
        for r in rules:
            for b in atoms[id(r)]:
                level[id(r)] = max([level[id(r)], *(level[id(q)] + b.negated for q in rules if feeds(q.head.predicate, b.predicate))])
        if level == before:
            return [[r for r in rules if level[id(r)] == k] for k in range(max(level.values()) + 1)]
    raise ValueError("a rule asks for the absence of what follows, through rules or axioms, from its own conclusion")


def infer(facts: DataFrame, words: Vocabulary, rules: list[Rule] | None = None, max_rounds: int | None = None) -> DataFrame:
    """(s, p, o, kind, prov_kind, prov_rule, prov_via): everything that follows, each fact once.

    Rules that ask for absence fire in strata, after all that axioms and other rules say about what they ask for; an absence
    that depends on the rule's own conclusion is an error. Provenance is the first round that produced the fact; within a round
    the smallest rule name.
    """
    up = few(settle(transitive_closure(words.sub_class)))
    over = settle(transitive_closure(words.sub_property))
    said = facts.select(*FACT)
    known = settle(dealt(said, said.count(), "s", "o").distinct().select("*", F.lit("asserted").alias("prov_kind"), F.lit(None).cast("string").alias("prov_rule"),
                                                         F.lit(None).cast("string").alias("prov_via")))
    turns, active, known_rows = count(1), [], known.count()
    for stratum, firing in enumerate(_strata(rules or [], words, up)):
        # what is known has been through the axioms and earlier rules, so a later stratum begins with its own rules alone
        active, delta, axioms = active + firing, known.select(*FACT), stratum == 0
        delta_rows = known_rows
        while axioms or firing:
            turn = next(turns)
            steps = [fire(rule, delta, known.select(*FACT)) for rule in firing]
            if axioms:
                types = delta.filter(F.col("p") == TYPE)
                higher = types.join(up, types["o"] == up["child"]).select("s", "p", F.col("parent").alias("o"), "kind", F.lit("sub-class").alias("rule"), F.col("child").alias("via"))
                steps = [higher, propagate(delta, over, words.traits, words.inverse), chain(delta, known.select(*FACT), words.traits), *steps]
            rows = known_rows + len(steps) * delta_rows  # a step mostly says one thing of a fact, so about as many meet below
            # facts are apart by s, p and o: of two kinds in one round the smaller is kept
            first = dealt(reduce(DataFrame.union, steps), rows, *FACT[:3]).groupBy(*FACT[:3]).agg(F.min("kind").alias("kind"), F.min(F.struct("rule", "via")).alias("w"))
            new = settle(first.join(dealt(known.select(*FACT[:3]), rows, *FACT[:3]), FACT[:3], "left_anti")
                         .select(*FACT, F.lit("inferred").alias("prov_kind"), F.col("w.rule").alias("prov_rule"), F.col("w.via").alias("prov_via")))
            delta_rows = new.count()
            if not delta_rows:
                break
            if turn == max_rounds:
                raise RuntimeError(f"more follows after {max_rounds} rounds")
            known, delta = known.union(new), new.select(*FACT)  # both sides are written already
            known_rows += delta_rows
            firing, axioms = active, True
    return known


def horn(relations: dict[str, DataFrame], rules: list[Rule], max_rounds: int | None = None) -> dict[str, DataFrame]:
    """Relations derived by Horn rules of any arity, stratum by stratum.

    Relations have columns a0, a1, ...; a rule that negates a predicate runs after the
    predicate is complete.
    """
    level = {r.head.predicate: 0 for r in rules}
    for _ in range(len(level) + 1):
        for r in rules:
            for b in r.body:
                if isinstance(b, Atom) and b.predicate in level:
                    level[r.head.predicate] = max(level[r.head.predicate], level[b.predicate] + (1 if b.negated else 0))
    if any(v > len(level) for v in level.values()):
        raise ValueError("a predicate depends on its own absence")
    known = dict(relations)
    for stratum in sorted(set(level.values())):
        mine = [r for r in rules if level[r.head.predicate] == stratum]
        for name in dict.fromkeys(r.head.predicate for r in mine) if max_rounds is None else ():
            base = _closed([r for r in mine if r.head.predicate == name])
            if base and name not in known and base in relations and base not in level and {t for _, t in known[base].dtypes} == {"string"}:
                known[name] = transitive_closure(known[base].toDF("child", "parent"), keep_loops=True).toDF("a0", "a1")
                mine = [r for r in mine if r.head.predicate != name]
        last: dict[str, DataFrame] = {}  # what the last round added; the first round takes everything as new
        for turn in count(1):
            added: dict[str, DataFrame] = {}
            for name in dict.fromkeys(r.head.predicate for r in mine):
                out = None
                for r in (x for x in mine if x.head.predicate == name):
                    if all(not isinstance(b, Atom) or b.predicate in known or b.negated for b in r.body):
                        for fresh in [None] if turn == 1 else [i for i, b in enumerate(r.body) if isinstance(b, Atom) and not b.negated and b.predicate in last]:
                            body = [Atom(f"{i}@{b.predicate}", b.args, b.negated) if isinstance(b, Atom) else b for i, b in enumerate(r.body)]

                            def table(predicate: str, fresh=fresh) -> DataFrame:
                                i, p = predicate.split("@", 1)
                                return last[p] if int(i) == fresh else known[p]
                            rows = match(body, table)
                            one = rows.select(*[_value(a).cast("string").alias(f"a{i}") for i, a in enumerate(r.head.args)])
                            out = one if out is None else out.union(one)
                if out is None:
                    continue
                out = out.distinct()
                if name in known:
                    out = out.join(known[name], out.columns, "left_anti")
                out = settle(out)
                if out.limit(1).count():
                    known[name] = known[name].union(out) if name in known else out
                    added[name] = out
            if not added:
                break
            if turn == max_rounds:
                raise RuntimeError(f"more follows after {max_rounds} rounds")
            last = added
    return known


def _closed(rules: list[Rule]) -> str | None:
    """The predicate q if the rules of one head h say that h is q's transitive closure: h(x, y) from q(x, y); h(x, z) from h and q, or q and h, along y."""
    if sorted(len(r.body) for r in rules) != [1, 2] or any(not isinstance(b, Atom) or b.negated for r in rules for b in r.body):
        return None
    step, again = sorted(rules, key=lambda r: len(r.body))
    base, (one, two), head = step.body[0], again.body, again.head
    if any(len(a.args) != 2 for a in (base, one, two, head, step.head)):
        return None
    names = [head.args[0], one.args[1], head.args[1]]
    if any(not isinstance(v, str) or not v.startswith("?") for v in (*names, *base.args)) or len(set(names)) < 3 or base.args[0] == base.args[1]:
        return None
    along = step.head.args == base.args and one.args == (names[0], names[1]) and two.args == (names[1], names[2])
    return base.predicate if along and {one.predicate, two.predicate} == {head.predicate, base.predicate} and base.predicate != head.predicate else None


def cross_record(df: DataFrame, key: str, attribute: str, time: str, row_id: str, gap_seconds: float) -> DataFrame:
    """Rows with another row of the same key, another attribute, at most the gap away in time.

    Per key and stretch of time, the nearest row with a different attribute on either side
    comes from one ordered pass; stretches overlap by the gap, so a key of any size is spread
    and no pairs are formed.
    """
    span = gap_seconds * 64
    at = F.unix_micros(F.col(time).cast("timestamp")) / 1e6
    rows = df.select(F.col(row_id).alias("id"), F.col(key).alias("k"), F.col(attribute).alias("v"), at.alias("t")).dropna()
    home = F.floor(F.col("t") / span)
    homes = F.array_distinct(F.array(home, F.floor((F.col("t") - gap_seconds) / span), F.floor((F.col("t") + gap_seconds) / span)))
    spread = rows.withColumn("home", home).withColumn("block", F.explode(homes))
    w = Window.partitionBy("k", "block").orderBy("t", "v", "id")
    past, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    before = F.last(F.when(F.col("pv") != F.col("v"), F.col("pt")), ignorenulls=True).over(past)
    after = F.first(F.when(F.col("nv") != F.col("v"), F.col("nt")), ignorenulls=True).over(ahead)
    marked = (spread.withColumns({"pv": F.lag("v").over(w), "pt": F.lag("t").over(w), "nv": F.lead("v").over(w), "nt": F.lead("t").over(w)})
              .withColumns({"before": before, "after": after}).filter("home = block"))
    hit = (F.col("t") - F.col("before") <= gap_seconds) | (F.col("after") - F.col("t") <= gap_seconds)
    return marked.filter(hit).select("id", "k", "v")


# ------------------------------------------------------------------ contradictions and checks

def disjoint_members(types: DataFrame, disjoint: DataFrame, member: str = "s", group: str = "o") -> DataFrame:
    """(member, a, b): members of both classes of a disjoint pair, each pair once.

    Works on (individual, class) and, with the closure, on (class, super class).
    """
    pairs = disjoint.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    side = types.select(F.col(member).alias("member"), F.col(group).alias("c")).distinct()
    left = side.join(pairs, side["c"] == pairs["a"]).select("member", "a", "b")
    return left.join(side.select("member", F.col("c").alias("b")), ["member", "b"]).select("member", "a", "b")


def functional_conflicts(facts: DataFrame, traits: DataFrame) -> DataFrame:
    """(p, rule, holder, low, high): functional properties with two values, inverse-functional with two subjects."""
    def clash(trait: str, by: str, other: str) -> DataFrame:
        mine = few(traits.filter(F.col("trait") == trait).select("p"))
        return (facts.join(mine, "p").groupBy("p", by).agg(F.min(other).alias("low"), F.max(other).alias("high"))
                .filter("low <> high").select("p", F.lit(trait).alias("rule"), F.col(by).alias("holder"), "low", "high"))
    return clash("functional", "s", "o").union(clash("inverse-functional", "o", "s"))


def vocabulary_gaps(properties: DataFrame, classes: DataFrame, datatypes: list[str], components: DataFrame) -> DataFrame:
    """(subject, problem): domains and ranges that resolve to nothing, and classes of no component.

    ``properties`` is (p, kind, domain, range), ``classes`` (class), ``components`` (class, component).
    """
    known = classes.select(F.col("class").alias("name"))
    domain = properties.join(known, properties["domain"] == known["name"], "left_anti").select(F.col("p").alias("subject"), F.lit("domain is not a declared class").alias("problem"))
    objects = properties.filter("kind = 'object'")
    ranges = objects.join(known, objects["range"] == known["name"], "left_anti").select("p", F.lit("range is not a declared class"))
    data = properties.filter((F.col("kind") != "object") & ~F.coalesce(F.col("range").isin(datatypes), F.lit(False))).select("p", F.lit("range is not a datatype"))
    homeless = classes.join(components, "class", "left_anti").select("class", F.lit("class has no component"))
    return domain.union(ranges).union(data).union(homeless)


def component_extract(facts: DataFrame, properties: DataFrame, components: DataFrame, name: str) -> DataFrame:
    """(item, role): a component's classes, the properties that touch them, boundary classes, typed individuals."""
    mine = components.filter(F.col("component") == name).select("class")
    touching = (properties.join(mine, properties["domain"] == mine["class"], "left_semi")
                .union(properties.join(mine, properties["range"] == mine["class"], "left_semi")).distinct())
    ends = touching.select(F.col("domain").alias("class")).union(touching.filter("kind = 'object'").select("range")).distinct()
    people = facts.filter(F.col("p") == TYPE)
    people = people.join(mine, people["o"] == mine["class"], "left_semi").select("s").distinct()
    return (mine.select(F.col("class").alias("item"), F.lit("class").alias("role"))
            .union(touching.select("p", F.lit("property")).distinct())
            .union(ends.join(mine, "class", "left_anti").select("class", F.lit("boundary")))
            .union(people.select("s", F.lit("individual"))))


def empty_classes(classes: DataFrame, facts: DataFrame) -> DataFrame:
    used = facts.filter(F.col("p") == TYPE).select(F.col("o").alias("class")).distinct()
    return classes.join(used, "class", "left_anti")


def twin_agreement(facts: DataFrame, derived: DataFrame, stored: str, computed: str, tolerance: float = 1e-6) -> DataFrame:
    """How often a rule's computed value equals the stored one, per subject that has both."""
    a = facts.filter(F.col("p") == stored).select("s", F.expr("try_cast(o AS double)").alias("have"))
    b = derived.filter(F.col("p") == computed).select("s", F.expr("try_cast(o AS double)").alias("want"))
    agree = F.abs(F.col("have") - F.col("want")) <= tolerance * F.greatest(F.lit(1.0), F.abs("want"))
    return a.join(b, "s").agg(F.lit(stored).alias("p"), F.count(F.lit(1)).alias("rows"), F.sum(agree.cast("long")).alias("agree"))


def column_roles(typing: DataFrame, dependencies: DataFrame, links: dict[str, str]) -> DataFrame:
    """(column, becomes): what each column turns into when a table becomes a graph."""
    targets = F.create_map(*[F.lit(x) for kv in (links or {"": ""}).items() for x in kv])
    lookups = dependencies.filter("exact AND size(lhs) = 1").select(F.col("rhs").alias("column")).distinct().withColumn("fd", F.lit(True))
    return (typing.join(F.broadcast(lookups), "column", "left").select(
        "column", F.when(targets[F.col("column")].isNotNull(), "object property")
        .when(F.col("role") == "identity", "inverse-functional property").when(F.col("fd"), "functional property")
        .when(F.col("semantic_type") == "nominal", "individuals").when(F.col("role") == "constant", "nothing").otherwise("data property").alias("becomes")))


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(change, s, p, old, new): statements added, removed, or changed in value between snapshots.

    A subject and property with one value on each side counts as changed.
    """
    gone = before.select("s", "p", "o").exceptAll(after.select("s", "p", "o"))
    came = after.select("s", "p", "o").exceptAll(before.select("s", "p", "o"))
    one = lambda d, name: d.groupBy("s", "p").agg(F.count(F.lit(1)).alias(f"n_{name}"), F.min("o").alias(name), F.max("o").alias(f"last_{name}"))
    both = one(gone, "old").join(one(came, "new"), ["s", "p"], "full_outer")
    single = (F.col("n_old") == 1) & (F.col("n_new") == 1)
    moved = both.filter(single).select(F.lit("changed").alias("change"), "s", "p", "old", "new")
    pairs = both.filter(single).select("s", "p")
    lost = gone.join(pairs, ["s", "p"], "left_anti").select(F.lit("removed").alias("change"), "s", "p", F.col("o").alias("old"), F.lit(None).cast("string").alias("new"))
    found = came.join(pairs, ["s", "p"], "left_anti").select(F.lit("added").alias("change"), "s", "p", F.lit(None).cast("string").alias("old"), F.col("o").alias("new"))
    return moved.union(lost).union(found)
