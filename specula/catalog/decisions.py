"""Decision tables over orders and customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from specula.catalog import query
from specula.operators import decision as d
from specula.operators.decision import ANY, Between, Combine, Compare, Invoke, Is, Row, Table

AMOUNT = Table("amount", "U", ["o_totalprice"], [Row([Between(300000, None)], 90), Row([Between(100000, 300000)], 30), Row([Between(5000, 100000)], 0)], "points")
AMOUNT_SQL = "CASE WHEN o_totalprice >= 300000 THEN 90 WHEN o_totalprice >= 100000 THEN 30 WHEN o_totalprice >= 5000 THEN 0 END"


@query("decision_unique", f"SELECT o_orderkey, {AMOUNT_SQL} AS points FROM orders")
def decision_unique(t):
    return d.decide(t.orders, AMOUNT).select("o_orderkey", "points")


OVER = [Row([Compare(">", 200000), ANY], 10), Row([ANY, Is("1-URGENT")], 20), Row([Between(100000, 400000), Is("5-LOW", negated=True)], 5)]
A, B, C = "o_totalprice > 200000", "o_orderpriority = '1-URGENT'", "(o_totalprice >= 100000 AND o_totalprice < 400000 AND o_orderpriority <> '5-LOW')"
SHOW = ["o_orderkey"]


def over(policy, **kw):
    return Table("over", policy, ["o_totalprice", "o_orderpriority"], OVER, "out", **kw)


@query("decision_first_and_priority", f"SELECT o_orderkey, CASE WHEN {A} THEN 10 WHEN {B} THEN 20 WHEN {C} THEN 5 END AS f, CASE WHEN {B} THEN 20 WHEN {A} THEN 10 WHEN {C} THEN 5 END AS p FROM orders")
def decision_first_and_priority(t):
    x = d.decide(t.orders, over("F"), output="f")
    return d.decide(x, over("P", priorities=[20, 10, 5]), output="p").select("o_orderkey", "f", "p")


HITS = f"(CASE WHEN {A} THEN 1 ELSE 0 END + CASE WHEN {B} THEN 1 ELSE 0 END + CASE WHEN {C} THEN 1 ELSE 0 END)"


@query("decision_any_and_unique", f"SELECT o_orderkey, CASE WHEN {HITS} = 1 THEN CASE WHEN {A} THEN 10 WHEN {B} THEN 20 ELSE 5 END END AS a, CASE WHEN {HITS} = 1 THEN CASE WHEN {A} THEN 10 WHEN {B} THEN 20 ELSE 5 END END AS u FROM orders")
def decision_any_and_unique(t):
    return d.decide(d.decide(t.orders, over("A"), output="a"), over("U"), output="u").select("o_orderkey", "a", "u")


LIST = f"list_filter([CASE WHEN {A} THEN 10 END, CASE WHEN {B} THEN 20 END, CASE WHEN {C} THEN 5 END], lambda x: x IS NOT NULL)"


@query("decision_collect", f"""SELECT o_orderkey, array_to_string({LIST}, ',') AS c, array_to_string(list_reverse_sort({LIST}), ',') AS o, CAST(coalesce(list_sum({LIST}), 0) AS DOUBLE) AS total, CAST(list_min({LIST}) AS DOUBLE) AS low, CAST(list_max({LIST}) AS DOUBLE) AS high, CAST(len({LIST}) AS BIGINT) AS k FROM orders""")
def decision_collect(t):
    x = t.orders
    for policy, name in (("C", "c"), ("O", "o"), ("C+", "total"), ("C<", "low"), ("C>", "high"), ("C#", "k")):
        x = d.decide(x, over(policy, priorities=[20, 10, 5]), output=name)
    text = lambda c: F.concat_ws(",", F.transform(c, lambda v: v.cast("string"))).alias(c)
    return x.select("o_orderkey", text("c"), text("o"), "total", "low", "high", "k")


ZONE = Table("zone", "F", ["place"], [Row([Is("A")], "home"), Row([Is("C")], "near"), Row([ANY], "far")], "zone")
RISK = Table("zone_risk", "U", ["zone"], [Row([Is("home")], 0), Row([Is("near")], 10), Row([Is("far")], 40)], "zone_points")


def chain(t):
    df = t.orders.withColumn("ship", F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("C")), (F.col("o_orderkey") % 3 + 1).cast("int"))).withColumn(
        "bill", F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("C")), (F.col("o_custkey") % 3 + 1).cast("int")))
    risk_bill = Invoke("zone_risk", {"zone": "bill zone"}, "bill points")
    nodes = [Combine("sum", ["points", "ship points", "bill points"], "risk"), risk_bill, Invoke("zone", {"place": "ship"}, "ship zone"), Invoke("zone", {"place": "bill"}, "bill zone"),
             Invoke("zone_risk", {"zone": "ship zone"}, "ship points"), Combine("max", ["ship points", "bill points"], "worst")]
    verdict = Table("verdict", "F", ["risk"], [Row([Compare(">=", 130)], "stop"), Row([Compare(">=", 60)], "check"), Row([Compare("<", 60)], "pass")], "verdict")
    return d.decide_chain(df, [AMOUNT, ZONE, RISK, verdict], nodes)


CHAIN = f"""(SELECT *, CASE o_orderkey % 3 WHEN 0 THEN 0 WHEN 2 THEN 10 ELSE 40 END AS sp, CASE o_custkey % 3 WHEN 0 THEN 0 WHEN 2 THEN 10 ELSE 40 END AS bp, {AMOUNT_SQL} AS ap FROM orders)"""


@query("decision_chain", f"""SELECT o_orderkey, CAST(ap + sp + bp AS DOUBLE) AS risk, CAST(greatest(sp, bp) AS DOUBLE) AS worst, CASE WHEN ap + sp + bp >= 130 THEN 'stop' WHEN ap + sp + bp >= 60 THEN 'check' WHEN ap + sp + bp < 60 THEN 'pass' END AS verdict FROM {CHAIN}""")
def decision_chain(t):
    return chain(t).select("o_orderkey", "risk", "worst", "verdict")


@query("decision_trace", f"""SELECT verdict, rule, count(*) AS n FROM (SELECT CASE WHEN r >= 130 THEN 'stop' WHEN r >= 60 THEN 'check' WHEN r < 60 THEN 'pass' END AS verdict, CAST(CASE WHEN r >= 130 THEN 1 WHEN r >= 60 THEN 2 WHEN r < 60 THEN 3 END AS BIGINT) AS rule FROM (SELECT ap + sp + bp AS r FROM {CHAIN})) GROUP BY 1, 2""")
def decision_trace(t):
    return chain(t).groupBy("verdict", F.get("verdict_trace.rules", F.lit(0)).cast("long").alias("rule")).agg(F.count(F.lit(1)).alias("n"))


@query("decision_coverage", f"""SELECT 'over' AS "table", count(*) AS rows, count(*) FILTER ({HITS} = 0) AS unmatched, count(*) FILTER ({HITS} > 1) AS several FROM orders
UNION ALL SELECT 'amount', count(*), count(*) FILTER (o_totalprice < 5000), 0 FROM orders""")
def decision_coverage(t):
    return d.coverage(t.orders, over("U")).union(d.coverage(t.orders, AMOUNT))


@query("decision_overlaps", f"""SELECT * FROM (SELECT CAST(1 AS BIGINT) AS first, CAST(2 AS BIGINT) AS second, count(*) FILTER ({A} AND {B}) AS rows FROM orders UNION ALL SELECT 1, 3, count(*) FILTER ({A} AND {C}) FROM orders UNION ALL SELECT 2, 3, count(*) FILTER ({B} AND {C}) FROM orders) WHERE rows > 0""")
def decision_overlaps(t):
    return d.rule_overlaps(t.orders, over("U"))


@query("decision_boundaries", f"""WITH b AS (SELECT CAST(unnest([299999.0, 300000.0, 300001.0, 99999.0, 100000.0, 100001.0, 4999.0, 5000.0, 5001.0]) AS DOUBLE) AS o_totalprice), v AS (SELECT o_totalprice, {AMOUNT_SQL} AS points FROM b UNION ALL SELECT NULL, NULL)
SELECT v.o_totalprice, points, (SELECT count(*) FROM orders o WHERE abs(o.o_totalprice - v.o_totalprice) <= 1000) AS near_rows FROM v""")
def decision_boundaries(t):
    """Boundary test rows, their decision, and how many orders lie near each."""
    rows = d.decide(d.boundary_rows(t.spark, AMOUNT), AMOUNT).select("o_totalprice", "points")
    values = [r["o_totalprice"] for r in rows.collect() if r["o_totalprice"] is not None]
    counts = t.orders.agg(*[F.sum((F.abs(F.col("o_totalprice") - v) <= 1000).cast("long")).alias(f"n{i}") for i, v in enumerate(values)])
    near = counts.select(F.inline(F.array(*[F.struct(F.lit(v).alias("o_totalprice"), F.col(f"n{i}").alias("near_rows")) for i, v in enumerate(values)])))
    return rows.join(near, "o_totalprice", "left").select("o_totalprice", "points", F.coalesce("near_rows", F.lit(0)).alias("near_rows"))
