"""Inference, patterns and contradictions over statements built from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from specula.catalog import query
from specula.operators import derive, graph, typing
from specula.operators.graph import Atom, Rule, Test, has, is_class

# Statements: customers are typed by segment and live in nations, nations in regions; orders are placed by customers.
FACTS_SQL = """(SELECT 'c' || c_custkey AS s, 'type' AS p, c_mktsegment AS o, 'class' AS kind FROM customer
UNION ALL SELECT 'c' || c_custkey, 'livesIn', 'n' || c_nationkey, 'object' FROM customer
UNION ALL SELECT 'c' || c_custkey, 'balance', CAST(CAST(round(c_acctbal) AS BIGINT) AS VARCHAR), 'value' FROM customer
UNION ALL SELECT 'n' || n_nationkey, 'partOf', 'r' || n_regionkey, 'object' FROM nation
UNION ALL SELECT 'n' || n_nationkey, 'type', 'Nation', 'class' FROM nation
UNION ALL SELECT 'r' || r_regionkey, 'partOf', 'world', 'object' FROM region
UNION ALL SELECT 'o' || o_orderkey, 'placedBy', 'c' || o_custkey, 'object' FROM orders
UNION ALL SELECT 'n' || n_nationkey, 'borders', 'n' || ((n_nationkey + 1) % 25), 'object' FROM nation)"""

SUB_CLASS = [("BUILDING", "Trade"), ("FURNITURE", "Household"), ("HOUSEHOLD", "Household"), ("Trade", "Company"), ("Household", "Person"),
             ("Company", "Party"), ("Person", "Party"), ("AUTOMOBILE", "Trade"), ("MACHINERY", "Trade")]
SUB_PROPERTY = [("livesIn", "locatedIn"), ("placedBy", "relatedTo"), ("locatedIn", "relatedTo")]


def facts(t):
    text = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    rows = lambda df, s, p, o, kind: df.select(s.alias("s"), F.lit(p).alias("p"), o.alias("o"), F.lit(kind).alias("kind"))
    c, n = t.customer, t.nation
    parts = [rows(c, text("c", "c_custkey"), "type", F.col("c_mktsegment"), "class"), rows(c, text("c", "c_custkey"), "livesIn", text("n", "c_nationkey"), "object"),
             rows(c, text("c", "c_custkey"), "balance", F.round("c_acctbal").cast("long").cast("string"), "value"),
             rows(n, text("n", "n_nationkey"), "partOf", text("r", "n_regionkey"), "object"), rows(n, text("n", "n_nationkey"), "type", F.lit("Nation"), "class"),
             rows(t.region, text("r", "r_regionkey"), "partOf", F.lit("world"), "object"),
             rows(t.orders, text("o", "o_orderkey"), "placedBy", text("c", "o_custkey"), "object"),
             rows(n, text("n", "n_nationkey"), "borders", F.concat(F.lit("n"), ((F.col("n_nationkey") + 1) % 25).cast("string")), "object")]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def words(t):
    return graph.vocabulary(t.spark, SUB_CLASS, SUB_PROPERTY, [("borders", "symmetric"), ("partOf", "transitive")], [("placedBy", "placed")],
                            [("Company", "Person")])


def values(pairs, names):
    return "(VALUES " + ", ".join("(" + ", ".join(f"'{x}'" for x in p) + ")" for p in pairs) + f") v({', '.join(names)})"


CLOSURE = f"""cc(child, parent) AS (SELECT * FROM {values(SUB_CLASS, ['child', 'parent'])} UNION SELECT cc.child, v.parent FROM cc JOIN {values(SUB_CLASS, ['child', 'parent'])} ON v.child = cc.parent),
pc(child, parent) AS (SELECT * FROM {values(SUB_PROPERTY, ['child', 'parent'])} UNION SELECT pc.child, v.parent FROM pc JOIN {values(SUB_PROPERTY, ['child', 'parent'])} ON v.child = pc.parent)"""


@query("membership_inheritance", f"WITH RECURSIVE {CLOSURE} SELECT s, parent AS o FROM {FACTS_SQL} f JOIN cc ON f.o = cc.child WHERE p = 'type'")
def membership(t):
    return graph.inherited_types(facts(t), graph.transitive_closure(words(t).sub_class)).select("s", "o")


@query("subclass_closure", f"WITH RECURSIVE {CLOSURE}, used AS (SELECT DISTINCT o FROM {FACTS_SQL} WHERE p = 'type') SELECT child, parent FROM cc WHERE child IN (SELECT o FROM used)")
def subclass_closure(t):
    used = facts(t).filter("p = 'type'").select(F.col("o").alias("child")).distinct()
    return graph.transitive_closure(words(t).sub_class).join(used, "child", "left_semi")


# a hierarchy as deep as the data: each customer key halves down to 1
TREE_SQL = "(SELECT CAST(c_custkey AS VARCHAR) AS child, CAST(c_custkey // 2 AS VARCHAR) AS parent FROM customer WHERE c_custkey > 0)"


@query("closure_over_rows", f"WITH RECURSIVE e AS {TREE_SQL}, c(child, parent) AS (SELECT * FROM e UNION SELECT c.child, e.parent FROM c JOIN e ON e.child = c.parent) SELECT child, parent FROM c")
def closure_over_rows(t):
    edges = t.customer.filter("c_custkey > 0").select(F.col("c_custkey").cast("string").alias("child"), F.floor(F.col("c_custkey") / 2).cast("string").alias("parent"))
    return graph.transitive_closure(edges)


@query("subclass_cycles", """WITH e AS (SELECT DISTINCT n_nationkey AS child, CASE WHEN n_nationkey % 5 = 4 THEN n_nationkey - 4 ELSE n_nationkey + 1 END AS parent FROM nation WHERE n_nationkey < 10
 UNION SELECT n_nationkey, n_nationkey + 1 FROM nation WHERE n_nationkey BETWEEN 10 AND 20) SELECT 'n' || child AS class FROM e WHERE child < 10""")
def subclass_cycles(t):
    k = F.col("n_nationkey")
    ring = t.nation.filter(k < 10).select(k.alias("c"), F.when(k % 5 == 4, k - 4).otherwise(k + 1).alias("p"))
    line = t.nation.filter(k.between(10, 20)).select(k, k + 1)
    edges = ring.union(line).select(F.concat(F.lit("n"), F.col("c").cast("string")).alias("child"), F.concat(F.lit("n"), F.col("p").cast("string")).alias("parent"))
    return graph.subclass_cycles(edges)


INFERRED = f"""WITH RECURSIVE f AS {FACTS_SQL}, {CLOSURE}, part(s, o) AS (SELECT s, o FROM f WHERE p = 'partOf' UNION SELECT part.s, f.o FROM part JOIN f ON f.p = 'partOf' AND f.s = part.o),
base AS (SELECT s, p, o, kind FROM f UNION SELECT s, 'type', parent, 'class' FROM f JOIN cc ON f.p = 'type' AND f.o = cc.child UNION SELECT s, 'partOf', o, 'object' FROM part
 UNION SELECT o, 'borders', s, 'object' FROM f WHERE p = 'borders' UNION SELECT o, 'placed', s, 'object' FROM f WHERE p = 'placedBy'),
allf AS (SELECT * FROM base UNION SELECT s, parent, o, kind FROM base JOIN pc ON base.p = pc.child)"""
RICH_SQL = """, rich AS (SELECT DISTINCT a.s FROM allf a JOIN allf b ON a.s = b.s WHERE a.p = 'type' AND a.o = 'Company' AND b.p = 'balance' AND TRY_CAST(b.o AS DOUBLE) >= 5000),
scored AS (SELECT rich.s, CAST(CAST(b.o AS DOUBLE) + 100 AS DOUBLE) AS v FROM rich JOIN allf b ON rich.s = b.s AND b.p = 'balance')"""
RULES = [Rule("rich", is_class("Rich", "?x"), [is_class("Company", "?x"), has("balance", "?x", "?b"), Test(">=", ("?b", 5000))]),
         Rule("score", has("score", "?x", "?v"), [is_class("Rich", "?x"), has("balance", "?x", "?b"), Test("+", ("?v", "?b", 100))])]


@query("inference_fixpoint", INFERRED + RICH_SQL + """ SELECT p, kind, CAST(count(*) AS BIGINT) AS n FROM (SELECT s, p, o, kind FROM allf UNION SELECT s, 'type', 'Rich', 'class' FROM rich UNION SELECT s, 'score', CAST(v AS VARCHAR), 'value' FROM scored) GROUP BY 1, 2""")
def inference_fixpoint(t):
    return graph.infer(facts(t), words(t), RULES).groupBy("p", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("inference_provenance", INFERRED + RICH_SQL + """ SELECT 'rule' AS prov_rule, 'rich' AS prov_via, count(*) AS n FROM rich UNION ALL SELECT 'rule', 'score', count(*) FROM scored
 UNION ALL SELECT 'symmetric', 'borders', count(*) FROM f WHERE p = 'borders' UNION ALL SELECT 'inverse', 'placedBy', count(*) FROM f WHERE p = 'placedBy' """)
def inference_provenance(t):
    known = graph.infer(facts(t), words(t), RULES)
    return known.filter("prov_kind = 'inferred' AND prov_rule IN ('rule', 'symmetric', 'inverse')").groupBy("prov_rule", "prov_via").agg(F.count(F.lit(1)).alias("n"))


# who is no company after all that the hierarchy says is a private party, and who is neither rich nor private is modest
ABSENT = [Rule("private", is_class("Private", "?x"), [has("livesIn", "?x", "?n"), Atom("class:Company", ("?x",), True)]),
          Rule("modest", is_class("Modest", "?x"), [has("livesIn", "?x", "?n"), Atom("class:Rich", ("?x",), True), Atom("class:Private", ("?x",), True)])]


@query("inference_with_absence", INFERRED + RICH_SQL + """, private AS (SELECT DISTINCT s FROM f WHERE p = 'livesIn' AND s NOT IN (SELECT s FROM allf WHERE p = 'type' AND o = 'Company')),
modest AS (SELECT DISTINCT s FROM f WHERE p = 'livesIn' AND s NOT IN (SELECT s FROM rich) AND s NOT IN (SELECT s FROM private))
SELECT s, 'Private' AS o FROM private UNION ALL SELECT s, 'Modest' FROM modest UNION ALL SELECT s, 'Rich' FROM rich""")
def inference_with_absence(t):
    known = graph.infer(facts(t), words(t), [*ABSENT, RULES[0]])
    return known.filter("p = 'type' AND o IN ('Private', 'Modest', 'Rich')").select("s", "o")


@query("property_propagation", f"""WITH RECURSIVE f AS {FACTS_SQL}, {CLOSURE} SELECT s, parent AS p, o, 'sub-property' AS rule FROM f JOIN pc ON f.p = pc.child
UNION ALL SELECT o, p, s, 'symmetric' FROM f WHERE p = 'borders' UNION ALL SELECT o, 'placed', s, 'inverse' FROM f WHERE p = 'placedBy'""")
def property_propagation(t):
    w = words(t)
    return graph.propagate(facts(t), graph.transitive_closure(w.sub_property), w.traits, w.inverse).select("s", "p", "o", "rule")


@query("transitive_property", f"WITH f AS {FACTS_SQL} SELECT a.s, b.o FROM f a JOIN f b ON a.p = 'partOf' AND b.p = 'partOf' AND a.o = b.s WHERE a.s <> b.o")
def transitive_property(t):
    f = facts(t)
    return graph.chain(f, f, words(t).traits).select("s", "o").distinct()


@query("rule_body", f"""WITH f AS {FACTS_SQL} SELECT a.s AS x, b.o AS n, c.o AS r FROM f a JOIN f b ON a.s = b.s AND b.p = 'livesIn' JOIN f c ON c.s = b.o AND c.p = 'partOf' JOIN f d ON d.s = a.s AND d.p = 'balance'
WHERE a.p = 'type' AND a.o = 'BUILDING' AND c.o = 'r1' AND TRY_CAST(d.o AS DOUBLE) * 2 > 9000""")
def rule_body(t):
    body = [is_class("BUILDING", "?x"), has("livesIn", "?x", "?n"), has("partOf", "?n", "?r"), Test("=", ("?r", "r1")), has("balance", "?x", "?b"),
            Test("*", ("?d", "?b", 2)), Test(">", ("?d", 9000))]
    return graph.match(body, graph.fact_relation(facts(t))).select("x", "n", "r")


@query("pattern_query", f"WITH f AS {FACTS_SQL} SELECT DISTINCT b.o AS nation, a.o AS segment FROM f a JOIN f b ON a.s = b.s WHERE a.p = 'type' AND b.p = 'livesIn'")
def pattern_query(t):
    f = facts(t)
    types = f.filter("p = 'type'").select("s", F.lit("isA").alias("p"), "o", F.lit("object").alias("kind"))
    return graph.pattern_query(f.union(types), [has("isA", "?x", "?segment"), has("livesIn", "?x", "?nation")], ["?nation", "?segment"])


@query("pattern_absence", f"WITH f AS {FACTS_SQL} SELECT DISTINCT s AS x FROM f WHERE p = 'livesIn' AND s NOT IN (SELECT s FROM f WHERE p = 'type' AND o = 'BUILDING')")
def pattern_absence(t):
    return graph.pattern_query(facts(t), [has("livesIn", "?x", "?n"), Atom("class:BUILDING", ("?x",), negated=True)], ["?x"])


@query("horn_rules", """WITH RECURSIVE p AS (SELECT c_custkey // 2 AS a, c_custkey AS b FROM customer WHERE c_custkey > 0), anc(a, b) AS (SELECT a, b FROM p UNION SELECT anc.a, p.b FROM anc JOIN p ON anc.b = p.a),
rich AS (SELECT c_custkey AS a FROM customer WHERE c_acctbal > 5000) SELECT CAST(a AS VARCHAR) AS a0, CAST(b AS VARCHAR) AS a1 FROM anc WHERE a IN (SELECT a FROM rich) AND b NOT IN (SELECT a FROM rich)""")
def horn_rules(t):
    c = t.customer
    relations = {"parent": c.filter("c_custkey > 0").select(F.floor(F.col("c_custkey") / 2).cast("string").alias("a0"), F.col("c_custkey").cast("string").alias("a1")),
                 "balance": c.select(F.col("c_custkey").cast("string").alias("a0"), F.col("c_acctbal").cast("string").alias("a1"))}
    rules = [Rule("a1", Atom("ancestor", ("?x", "?y")), [Atom("parent", ("?x", "?y"))]),
             Rule("a2", Atom("ancestor", ("?x", "?z")), [Atom("ancestor", ("?x", "?y")), Atom("parent", ("?y", "?z"))]),
             Rule("r", Atom("rich", ("?x",)), [Atom("balance", ("?x", "?b")), Test(">", ("?b", 5000))]),
             Rule("s", Atom("supports", ("?x", "?y")), [Atom("ancestor", ("?x", "?y")), Atom("rich", ("?x",)), Atom("rich", ("?y",), negated=True)])]
    return graph.horn(relations, rules)["supports"]


@query("cross_record", """SELECT a.event_id AS id, a.user_id AS k, a.event_type AS v FROM events a WHERE EXISTS (SELECT 1 FROM events b WHERE b.user_id = a.user_id AND b.event_type <> a.event_type AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 300000000)""")
def cross_record(t):
    return graph.cross_record(t.events, "user_id", "event_type", "ts", "event_id", 300)


# ----------------------------------------------------------------- contradictions and checks

CLASHING = f"""(SELECT s, o FROM {FACTS_SQL} WHERE p = 'type' UNION SELECT 'c' || o_custkey, 'FURNITURE' FROM orders WHERE o_totalprice > 495000)"""


@query("disjoint_individuals", f"""WITH RECURSIVE {CLOSURE}, m AS (SELECT s, o FROM {CLASHING} UNION SELECT s, parent FROM {CLASHING} f JOIN cc ON f.o = cc.child) SELECT x.s AS member, x.o AS a, y.o AS b FROM m x JOIN m y ON x.s = y.s WHERE x.o = 'Company' AND y.o = 'Person'""")
def disjoint_individuals(t):
    extra = t.orders.filter("o_totalprice > 495000").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("s"), F.lit("type").alias("p"), F.lit("FURNITURE").alias("o"), F.lit("class").alias("kind"))
    f = facts(t).filter("p = 'type'").union(extra).distinct()
    w = words(t)
    return graph.disjoint_members(f.union(graph.inherited_types(f, graph.transitive_closure(w.sub_class))), w.disjoint)


@query("disjoint_superclasses", """SELECT 'k' || c_custkey AS member, 'Company' AS a, 'Person' AS b FROM customer WHERE c_custkey % 50 = 0""")
def disjoint_superclasses(t):
    w = words(t)
    c = t.customer.select(F.concat(F.lit("k"), F.col("c_custkey").cast("string")).alias("child"), F.lit("BUILDING").alias("parent"), "c_custkey")
    both = c.filter("c_custkey % 50 = 0").select("child", F.lit("FURNITURE").alias("parent"))
    return graph.disjoint_members(graph.transitive_closure(w.sub_class.union(c.select("child", "parent")).union(both)), w.disjoint, "child", "parent")


@query("functional_conflicts", """SELECT 'handledBy' AS p, 'functional' AS rule, CAST(l_orderkey AS VARCHAR) AS holder, min(CAST(l_suppkey AS VARCHAR)) AS low, max(CAST(l_suppkey AS VARCHAR)) AS high FROM lineitem GROUP BY 3 HAVING count(DISTINCT l_suppkey) > 1
UNION ALL SELECT 'label', 'inverse-functional', p_name, min(CAST(p_partkey AS VARCHAR)), max(CAST(p_partkey AS VARCHAR)) FROM part GROUP BY 3 HAVING count(DISTINCT p_partkey) > 1""")
def functional_conflicts(t):
    a = t.lineitem.select(F.col("l_orderkey").cast("string").alias("s"), F.lit("handledBy").alias("p"), F.col("l_suppkey").cast("string").alias("o"), F.lit("object").alias("kind"))
    b = t.part.select(F.col("p_partkey").cast("string").alias("s"), F.lit("label").alias("p"), F.col("p_name").alias("o"), F.lit("value").alias("kind"))
    traits = t.spark.createDataFrame([("handledBy", "functional"), ("label", "inverse-functional")], "p string, trait string")
    return graph.functional_conflicts(a.union(b), traits)


def schema_tables(t):
    """Declarations derived from the tables: segments are classes, one property per nation points at a region's class."""
    classes = t.customer.select(F.col("c_mktsegment").alias("class")).distinct().union(t.region.select("r_name"))
    props = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_name").alias("p"), F.when(F.col("n_nationkey") % 2 == 0, "object").otherwise("data").alias("kind"), F.lit("BUILDING").alias("domain"),
        F.when(F.col("n_nationkey") % 2 == 1, "string").when(F.col("n_nationkey") % 6 == 0, "Nowhere").otherwise(F.col("r_name")).alias("range"))
    components = t.region.filter("r_regionkey < 3").select(F.col("r_name").alias("class"), F.lit("places").alias("component"))
    return classes, props, components


SCHEMA_SQL = """WITH classes AS (SELECT DISTINCT c_mktsegment AS class FROM customer UNION ALL SELECT r_name FROM region), props AS (SELECT n_name AS p, CASE WHEN n_nationkey % 2 = 0 THEN 'object' ELSE 'data' END AS kind, 'BUILDING' AS domain,
 CASE WHEN n_nationkey % 2 = 1 THEN 'string' WHEN n_nationkey % 6 = 0 THEN 'Nowhere' ELSE r_name END AS range FROM nation JOIN region ON n_regionkey = r_regionkey), components AS (SELECT r_name AS class FROM region WHERE r_regionkey < 3)"""


@query("vocabulary_gaps", SCHEMA_SQL + """ SELECT p AS subject, 'range is not a declared class' AS problem FROM props WHERE kind = 'object' AND range NOT IN (SELECT class FROM classes)
UNION ALL SELECT class, 'class has no component' FROM classes WHERE class NOT IN (SELECT class FROM components)""")
def vocabulary_gaps(t):
    classes, props, components = schema_tables(t)
    return graph.vocabulary_gaps(props, classes, ["string", "integer", "decimal"], components)


@query("component_extract", SCHEMA_SQL + f""", touching AS (SELECT * FROM props WHERE range IN (SELECT class FROM components)) SELECT class AS item, 'class' AS role FROM components UNION ALL SELECT DISTINCT p, 'property' FROM touching
UNION ALL SELECT DISTINCT domain, 'boundary' FROM touching UNION ALL SELECT DISTINCT 'n' || n_nationkey, 'individual' FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey < 3""")
def component_extract(t):
    _, props, components = schema_tables(t)
    typed = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("s"), F.lit("type").alias("p"), F.col("r_name").alias("o"), F.lit("class").alias("kind"))
    return graph.component_extract(typed, props, components, "places")


@query("empty_classes", f"WITH f AS {FACTS_SQL} SELECT n_name AS class FROM nation WHERE n_name NOT IN (SELECT o FROM f WHERE p = 'type')")
def empty_classes(t):
    return graph.empty_classes(t.nation.select(F.col("n_name").alias("class")), facts(t))


@query("twin_agreement", """SELECT 'net' AS p, count(*) AS rows, count(*) FILTER (abs(round(total * 0.8, 2) - total * 0.8) <= 1e-6 * greatest(1.0, abs(total * 0.8))) AS agree FROM (SELECT o_totalprice AS total FROM orders)""")
def twin_agreement(t):
    s = F.col("o_orderkey").cast("string")
    stored = t.orders.select(s.alias("s"), F.lit("net").alias("p"), F.round(F.col("o_totalprice") * 0.8, 2).cast("string").alias("o"), F.lit("value").alias("kind"))
    computed = t.orders.select(s.alias("s"), F.lit("netRule").alias("p"), (F.col("o_totalprice") * 0.8).cast("string").alias("o"), F.lit("value").alias("kind"))
    return graph.twin_agreement(stored, computed, "net", "netRule")


@query("column_roles", """SELECT 'nation' AS "column", 'object property' AS becomes UNION ALL SELECT 'key', CASE WHEN count(DISTINCT c_custkey) = count(*) THEN 'inverse-functional property' ELSE 'data property' END FROM customer
UNION ALL SELECT 'segment', 'individuals' UNION ALL SELECT 'balance', 'data property' UNION ALL SELECT 'place', 'functional property' """)
def column_roles(t):
    df = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("nation"), F.col("n_name").alias("place"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"))
    fds = derive.functional_dependencies(df, ["nation", "place", "segment"], max_lhs=1).filter("lhs[0] = 'nation'")
    return graph.column_roles(typing.semantic_types(df), fds, {"nation": "nations"})


@query("snapshot_diff", """SELECT 'changed' AS change, CAST(o_orderkey AS VARCHAR) AS s, 'status' AS p, o_orderstatus AS "old", 'X' AS "new" FROM orders WHERE o_orderkey % 10 = 0 AND o_orderkey % 50 <> 0
UNION ALL SELECT 'removed', CAST(o_orderkey AS VARCHAR), 'status', o_orderstatus, NULL FROM orders WHERE o_orderkey % 50 = 0 UNION ALL SELECT 'added', 'new' || o_orderkey, 'status', NULL, o_orderstatus FROM orders WHERE o_orderkey % 100 = 1""")
def snapshot_diff(t):
    k = F.col("o_orderkey")
    before = t.orders.select(k.cast("string").alias("s"), F.lit("status").alias("p"), F.col("o_orderstatus").alias("o"))
    after = (t.orders.filter(k % 50 != 0).select(k.cast("string").alias("s"), F.lit("status").alias("p"), F.when(k % 10 == 0, "X").otherwise(F.col("o_orderstatus")).alias("o"))
             .union(t.orders.filter(k % 100 == 1).select(F.concat(F.lit("new"), k.cast("string")), F.lit("status"), "o_orderstatus")))
    return graph.snapshot_diff(before, after)
