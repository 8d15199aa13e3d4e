"""Graphs, decision tables, places and models on small frames with known answers."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from specula.operators import graph, spatial
from specula.operators.decision import Between, Row, Table, boundary_rows, coverage, decide, interval_gaps, lint
from specula.operators.graph import Atom, Rule, has, is_class
from specula.operators.graph import Test as Builtin


def facts(spark, rows):
    return spark.createDataFrame(rows, "s string, p string, o string, kind string")


def triples(df):
    return {(r["s"], r["p"], r["o"]) for r in df.collect()}


def test_hierarchies_and_characteristics(spark):
    words = graph.vocabulary(spark, [("GrandFather", "Father"), ("Father", "Parent"), ("Parent", "Person")],
                             [("hasMother", "hasParent"), ("hasParent", "hasAncestor")], [("knows", "symmetric"), ("before", "transitive")], [("teaches", "taughtBy")])
    known = graph.infer(facts(spark, [("alice", "type", "Father", "class"), ("bob", "hasMother", "alice", "object"), ("a", "knows", "b", "object"),
                                      ("x", "before", "y", "object"), ("y", "before", "z", "object"), ("z", "before", "w", "object"), ("t", "teaches", "u", "object")]), words)
    got = triples(known)
    assert {("alice", "type", "Parent"), ("alice", "type", "Person"), ("bob", "hasParent", "alice"), ("bob", "hasAncestor", "alice"), ("b", "knows", "a"),
            ("x", "before", "w"), ("u", "taughtBy", "t")} <= got
    assert triples(graph.infer(known.select("s", "p", "o", "kind"), words)) == got
    prov = {(r["s"], r["p"], r["o"]): r["prov_rule"] for r in known.filter("prov_kind = 'inferred'").collect()}
    assert prov[("b", "knows", "a")] == "symmetric" and prov[("x", "before", "w")] == "transitive"


def test_rule_and_contradictions(spark):
    words = graph.vocabulary(spark, traits=[("email", "functional")], disjoint=[("Woman", "Man")])
    f = facts(spark, [("tx1", "type", "Payment", "class"), ("tx2", "type", "Payment", "class"), ("tx1", "hasAmount", "12500", "value"), ("tx2", "hasAmount", "200", "value"),
                      ("sam", "type", "Man", "class"), ("sam", "type", "Woman", "class"), ("sam", "email", "a@x", "value"), ("sam", "email", "b@x", "value")])
    rule = Rule("high", is_class("HighValue", "?t"), [is_class("Payment", "?t"), has("hasAmount", "?t", "?a"), Builtin(">=", ("?a", 10000))])
    known = graph.infer(f, words, [rule])
    assert [r["s"] for r in known.filter("o = 'HighValue'").collect()] == ["tx1"]
    clash = graph.disjoint_members(known.filter("p = 'type'"), words.disjoint).collect()
    assert [(r["member"], r["a"], r["b"]) for r in clash] == [("sam", "Man", "Woman")]
    assert graph.functional_conflicts(f, words.traits).first()["holder"] == "sam"


def test_negation_runs_after_its_stratum(spark):
    one = spark.createDataFrame([("a",), ("b",)], "a0 string")
    rel = {"node": one, "edge": spark.createDataFrame([("a", "b")], "a0 string, a1 string")}
    rules = [Rule("r", Atom("alone", ("?x",)), [Atom("node", ("?x",)), Atom("target", ("?x",), negated=True)]), Rule("t", Atom("target", ("?y",)), [Atom("edge", ("?x", "?y"))])]
    assert [r["a0"] for r in graph.horn(rel, rules)["alone"].collect()] == ["a"]
    with pytest.raises(ValueError):
        graph.horn(rel, [Rule("p", Atom("p", ("?x",)), [Atom("node", ("?x",)), Atom("p", ("?x",), negated=True)])])


RISK = Table("risk", "U", ["hasAmount"], [Row([Between(10000, None)], 90), Row([Between(1000, 10000)], 30), Row([Between(0, 1000)], 0)], "points")


def test_amount_bands(spark):
    df = spark.createDataFrame([(10000.0,), (9999.0,), (1000.0,), (0.0,), (-5.0,), (None,)], "hasAmount double")
    assert [r["points"] for r in decide(df, RISK).collect()] == [90, 30, 30, 0, None, None]
    row = coverage(df, RISK).first()
    assert (row["unmatched"], row["several"]) == (2, 0)
    assert {r["issue"] for r in interval_gaps(spark, RISK, "hasAmount").collect()} == {"shared end point"}
    assert boundary_rows(spark, RISK).count() == 10
    assert lint([Table("bad", "X", ["a"], [Row([], 1)], "o")])


def lattice(spark, n=700):
    """Clustered points; a third of them share one place."""
    rng = np.random.default_rng(5)
    xy = np.concatenate([rng.normal(0, 30, (n // 3, 2)), rng.normal(400, 60, (n // 3, 2)), np.tile([[150.0, 150.0]], (n - 2 * (n // 3), 1))]).round(1)
    pdf = pd.DataFrame({"id": range(len(xy)), "part": "all", "_x": xy[:, 0], "_y": xy[:, 1]})
    d = np.hypot(xy[:, None, 0] - xy[None, :, 0], xy[:, None, 1] - xy[None, :, 1])
    return spark.createDataFrame(pdf), d


@pytest.mark.parametrize("few", [1000, 5])
def test_nearest_against_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(spatial, "FEW", few)
    points, d = lattice(spark)
    got = spatial.nearest(points, 3).toPandas().sort_values(["id", "rank"])
    other = d.copy()
    np.fill_diagonal(other, np.inf)
    want = np.sort(other, axis=1)[:, :3]
    assert len(got) == 3 * len(d) and np.allclose(got["distance"].to_numpy().reshape(-1, 3), want)
    assert (got["id"] != got["other"]).all()


@pytest.mark.parametrize("radius", [12.0, 90.0])
def test_neighbours_and_clusters_against_brute_force(spark, radius):
    points, d = lattice(spark)
    near = d <= radius
    got = spatial.neighbours_within(points, radius).toPandas().sort_values("id")
    assert got["n"].tolist() == (near.sum(1) - 1).tolist()
    core = near.sum(1) >= 6
    label = np.full(len(d), -1)
    for i in np.flatnonzero(core):
        if label[i] < 0:
            todo, label[i] = [i], i
            while todo:
                for k in np.flatnonzero(near[todo.pop()] & core & (label < 0)):
                    label[k] = i
                    todo.append(k)
    noise = ~core & ~(near[:, core].any(1))
    found = spatial.dbscan(points, radius, 6).toPandas().sort_values("id")
    assert found["cluster"].isna().tolist() == noise.tolist()
    mine = found["cluster"].to_numpy()[core]
    assert len(set(mine)) == len(set(label[core])) == len({(a, b) for a, b in zip(mine, label[core])})


def test_cross_record_hot_key(spark):
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({"id": range(600), "k": np.where(rng.random(600) < 0.4, 1, rng.integers(2, 60, 600)), "v": rng.choice(list("ab"), 600), "t": rng.integers(0, 90000, 600)})
    df = spark.createDataFrame(pdf).withColumn("at", F.timestamp_seconds("t"))
    got = {r["id"] for r in graph.cross_record(df, "k", "v", "at", "id", 120).collect()}
    m = pdf.merge(pdf, on="k")
    want = set(m[(m.v_x != m.v_y) & ((m.t_x - m.t_y).abs() <= 120)]["id_x"])
    assert got == want
