"""Ordinary inputs that the supplied tables do not have."""

import pytest
from pyspark.sql import functions as F

from specula.operators import decision, depend, derive, graph, series
from specula.operators.shaping import Step, run
from specula.sources import sampling, triples


def test_theil_sen_of_ties_and_of_a_constant(spark):
    tied = spark.range(300).select(F.col("id").cast("double").alias("i"), (F.col("id") % 2).cast("double").alias("v"))
    assert series.theil_sen(tied).first()["slope"] == 0.0
    flat = spark.range(50).select(F.col("id").cast("double").alias("i"), F.lit(3.0).alias("v"))
    row = series.theil_sen(flat).first()
    assert (row["slope"], row["intercept"], row["ci_low"], row["ci_high"]) == (0.0, 3.0, 0.0, 0.0)


def test_absence_is_asked_of_all_facts(spark):
    facts = spark.createDataFrame([("x", graph.TYPE, "A", "class"), ("x", graph.TYPE, "B", "class"), ("y", graph.TYPE, "A", "class")], "s string, p string, o string, kind string")
    rule = graph.Rule("r", graph.Atom("class:C", ["?i"]), [graph.Atom("class:A", ["?i"]), graph.Atom("class:B", ["?i"], True)])
    fresh = facts.filter("s = 'y'")
    assert [r["s"] for r in graph.fire(rule, fresh, facts).collect()] == ["y"]
    assert graph.fire(rule, facts.filter("o = 'A'"), facts).select("s").distinct().count() == 1


def test_absence_waits_for_axioms_and_rules(spark):
    typed = lambda *pairs: spark.createDataFrame([(s, graph.TYPE, o, "class") for s, o in pairs], "s string, p string, o string, kind string")
    absent = graph.Rule("absent", graph.is_class("C", "?x"), [graph.is_class("D", "?x"), graph.Atom("class:A", ("?x",), True)])
    words = graph.vocabulary(spark, sub_class=[("B", "M"), ("M", "A"), ("C", "E")], sub_property=[("near", "by")], inverse=[("by", "beside")])
    got = {(r["s"], r["o"]) for r in graph.infer(typed(("x", "B"), ("x", "D"), ("y", "D")), words, [absent]).collect()}
    assert got == {("x", "B"), ("x", "M"), ("x", "A"), ("x", "D"), ("y", "D"), ("y", "C"), ("y", "E")}
    # what a rule concludes reaches the absence through the hierarchy, and what follows from absence feeds other rules
    makes = graph.Rule("makes", graph.is_class("B", "?x"), [graph.is_class("F", "?x")])
    uses = graph.Rule("uses", graph.is_class("G", "?x"), [graph.is_class("E", "?x")])
    got = {(r["s"], r["o"]) for r in graph.infer(typed(("x", "F"), ("x", "D"), ("y", "D")), words, [absent, uses, makes]).collect()}
    assert ("x", "C") not in got and {("x", "A"), ("y", "C"), ("y", "E"), ("y", "G")} <= got and ("x", "G") not in got
    # an absence of properties, through a sub-property and an inverse
    facts = spark.createDataFrame([("a", "near", "b", "object"), ("a", graph.TYPE, "D", "class"), ("b", graph.TYPE, "D", "class")], "s string, p string, o string, kind string")
    alone = graph.Rule("alone", graph.is_class("Alone", "?x"), [graph.is_class("D", "?x"), graph.Atom("property:beside", ("?x", "?y"), True)])
    assert {r["s"] for r in graph.infer(facts, words, [alone]).filter("o = 'Alone'").collect()} == {"a"}
    for head in ("class:A", "class:B"):
        with pytest.raises(ValueError):
            graph.infer(typed(("y", "D")), words, [graph.Rule("circle", graph.Atom(head, ("?x",)), absent.body)])


def test_bounds_on_rounds_are_errors(spark):
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(12)], "a0 string, a1 string")
    rules = [graph.Rule("base", graph.Atom("reach", ["?a", "?b"]), [graph.Atom("edge", ["?a", "?b"])]),
             graph.Rule("step", graph.Atom("reach", ["?a", "?c"]), [graph.Atom("reach", ["?a", "?b"]), graph.Atom("edge", ["?b", "?c"])])]
    with pytest.raises(RuntimeError):
        graph.horn({"edge": edges}, rules, max_rounds=4)
    assert graph.horn({"edge": edges}, rules)["reach"].count() == 78


def test_depth_of_long_chains_and_circles(spark):
    chain = spark.createDataFrame([(f"c{i + 1:03d}", f"c{i:03d}") for i in range(80)] + [("c080", "c000")], "head string, body string")
    got = {r["column"]: r["depth"] for r in derive.derivation_depth(chain).collect()}
    assert got == {f"c{i:03d}": i for i in range(81)}
    with pytest.raises(ValueError):
        derive.derivation_depth(chain.union(spark.createDataFrame([("c000", "c080")], "head string, body string")))


def test_interactions_of_ten_features(spark):
    cols = [F.rand(i).alias(f"x{i}") for i in range(10)]
    df = spark.range(400).select(*cols).withColumn("y", F.col("x8") * F.col("x9"))
    got = depend.interactions(df, [f"x{i}" for i in range(10)], "y")
    assert got.count() == 45 and got.first()["a"] == "x8" and got.first()["b"] == "x9"


def test_formulas_of_sixteen_columns(spark):
    cols = [F.rand(i).alias(f"x{i:02d}") for i in range(15)]
    df = spark.range(600).select(*cols).withColumn("z", F.col("x00") * F.col("x01") - F.col("x02"))
    got = derive.derivable_columns(df, df.columns).filter("column = 'z'").first()
    assert got["kind"] == "polynomial-2" and abs(got["terms"]["x00*x01"] - 1) < 1e-6


def test_digests_see_a_null_move(spark):
    schema = "a string, b string"
    one, two = spark.createDataFrame([("a", None)], schema), spark.createDataFrame([(None, "a")], schema)
    assert sampling.row_digest(one).first() != sampling.row_digest(two).first()
    assert sampling.text_digest(one).first() != sampling.text_digest(two).first()


def test_statement_lines_escape(spark):
    facts = spark.createDataFrame([("t/1 x", "note", 'a "b"\\c\nd\te', "string")], "s string, p string, o string, kind string")
    assert triples.statement_lines(facts).first()["line"] == '<t/1%20x> <note> "a \\"b\\"\\\\c\\nd\\te" .'


def test_gaps_of_nested_intervals(spark):
    spans = [(0, 100), (10, 20), (30, 40), (150, 160)]
    table = decision.Table("t", "collect", ["x"], [decision.Row([decision.Between(*s)], 1) for s in spans], "out")
    got = [(r["low"], r["high"]) for r in decision.interval_gaps(spark, table, "x").filter("issue = 'gap'").collect()]
    assert got == [(100.0, 150.0)]


@pytest.mark.parametrize("key", [lambda i: f"r{i:04d}", lambda i: (1 << 60) + i])
def test_time_split_of_any_ids(spark, key):
    rows = [(key(i), "2024-01-01" if i < 400 else "2024-01-02", 1.0) for i in range(600)]
    df = spark.createDataFrame(rows, ["id", "at", "v"]).withColumn("at", F.col("at").cast("timestamp"))
    shaped = run(df, [Step("split", "split", params={"kind": "time", "time_column": "at", "test": 0.5})], row_id="id")
    parts = {r["_part"]: r["n"] for r in shaped.df.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert parts == {"test": 300, "train": 300}
    assert shaped.df.filter("at > '2024-01-01' AND _part = 'train'").count() == 0


def test_lag_with_a_missing_time(spark):
    rows = [(i, None if i == 500 else f"2024-01-01 00:{i // 60:02d}:{i % 60:02d}", float(i)) for i in range(1000)]
    df = spark.createDataFrame(rows, "id bigint, at string, v double").withColumn("at", F.col("at").cast("timestamp"))
    shaped = run(df, [Step("split", "split", params={"kind": "time", "time_column": "at", "test": 0.0}), Step("lag", "lag", ["v"], {"time_column": "at", "lags": [1]})], row_id="id")
    got = {r["id"]: r["v_lag1"] for r in shaped.df.collect()}
    assert got[501] == 499.0 and got[500] == 999.0 and got[700] == 699.0
