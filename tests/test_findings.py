"""What larger tables have shown: sums past a long, halves of a split, exact tests, sizes of plans in loops."""

import hashlib
import math
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from specula import session
from specula.functions import probability as p
from specula.operators import graph, hypothesis, spatial
from specula.operators.shaping import Step, run
from specula.plans import ordered
from specula.plans.components import connected_components
from specula.session import settle
from specula.sources import sampling


def test_text_digest_past_a_long(spark):
    # the same row 200000 times: the sum of its 48-bit hash passes 2**63
    n = 200_000
    value = int(hashlib.md5(b"v5").hexdigest()[:12], 16)
    assert n * value > 2**63
    row = sampling.text_digest(spark.range(n).select(F.lit(5).alias("k"))).first()
    assert (row["rows"], row["digest"]) == (n, n * value % 2**63)


@pytest.mark.parametrize("kind, halves, sizes", [
    ("stratified", "up", (1, 1)), ("stratified", "even", (1, 0)), ("random", "up", (1, 1)), ("random", "even", (1, 0)),
    ("time", "up", (1, 1)), ("time", "even", (1, 0))])
def test_halves_of_a_split(spark, kind, halves, sizes):
    df = spark.range(5).select("id", F.lit("a").alias("by"), F.timestamp_seconds("id").alias("at"))
    step = Step("s", "split", params={"kind": kind, "by": "by", "time_column": "at", "test": 0.2, "valid": 0.1, "halves": halves})
    parts = [r["_part"] for r in run(df, [step], "id").df.collect()]
    assert (parts.count("test"), parts.count("valid")) == sizes


def test_fisher_asked_for_whatever_is_expected(spark):
    cells = spark.createDataFrame([("x", "y", a, b, n) for a, b, n in (("f", "f", 900), ("f", "t", 60), ("t", "f", 70), ("t", "t", 12))],
                                  "a string, b string, level_a string, level_b string, n long")
    assert hypothesis.chi_square_from_cells(cells).first()["used"] == "chi-square"
    row = hypothesis.chi_square_from_cells(cells, exact=True).first()
    r1, c1, n = 960, 970, 1042
    chance = lambda x: math.comb(c1, x) * math.comb(n - c1, r1 - x) / math.comb(n, r1)
    want = sum(chance(x) for x in range(r1 + c1 - n, r1 + 1) if chance(x) <= chance(900) * (1 + 1e-7))
    assert row["used"] == "fisher" and abs(row["p"] - want) < 1e-9


def test_fisher_in_blocks():
    a, b, c, d = 60_200, 60_000, 60_000, 60_100
    r1, c1, n = a + b, a + c, a + b + c + d
    x = np.arange(max(0, r1 + c1 - n), min(r1, c1) + 1)
    lg = np.vectorize(math.lgamma)
    choose = lambda m, j: lg(m + 1.0) - lg(j + 1.0) - lg(m - j + 1.0)
    chance = np.exp(choose(c1, x) + choose(n - c1, r1 - x) - choose(n, r1))
    assert len(x) > 100_000
    assert abs(p.fisher_two_sided(a, b, c, d) - chance[chance <= chance[a - x[0]] * (1 + 1e-7)].sum()) < 1e-6


def test_sizes_of_plans_stay_small_in_a_long_chain(spark):
    chain = spark.range(300).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    out = connected_components(chain)
    assert out._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 10**9
    assert out.agg(F.count(F.lit(1)), F.max("component")).first()[:] == (301, 0)


def test_neighbours_are_not_planned_through_the_driver(spark, tmp_path, monkeypatch):
    spark.range(2000).select("id", (F.col("id") % 50 * 10.0).alias("_x"), (F.col("id") / 5.0).alias("_y"), F.lit("all").alias("part")).write.parquet(f"{tmp_path}/p")
    plans = []
    monkeypatch.setattr(ordered, "settle", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or settle(df))
    assert spatial.neighbours_within(spark.read.parquet(f"{tmp_path}/p"), 25.0).count() == 2000
    assert plans and not any("BroadcastHashJoin" in plan for plan in plans)


def test_facts_of_one_property_stay_in_their_tasks(spark):
    facts = spark.range(4000).select(F.concat(F.lit("a"), (F.col("id") % 3000).cast("string")).alias("s"), F.when(F.col("id") >= 0, "near").otherwise("far").alias("p"), F.col("id").cast("string").alias("o"), F.lit("object").alias("kind"))
    words = graph.vocabulary(spark, sub_property=[("near", "by")], traits=[("near", t) for t in ("functional", "symmetric", "transitive")], inverse=[("near", "beside")])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for facts that are too many to be broadcast themselves
    clashes = graph.functional_conflicts(facts, words.traits)
    told = graph.propagate(facts, words.sub_property, words.traits, words.inverse)
    try:
        for df, rows in ((clashes, 1000), (told, 12000)):
            assert "SortMergeJoin" not in df._jdf.queryExecution().executedPlan().toString()
            assert df.count() == rows
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_morans_permutations_by_blocks(spark, monkeypatch):
    for name, size in (("BLOCK", 40), ("BUCKET", 50), ("DEALT", 400)):
        monkeypatch.setattr(spatial, name, size)
    n, reps = 300, 9
    draw = np.random.default_rng(3)
    x, y, v = draw.random(n) * 100, draw.random(n) * 100, draw.normal(size=n)
    x[:90], y[:90] = 1.0, 1.0  # a crowded place is split
    points = spark.createDataFrame([(i, "all", float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "id long, part string, _x double, _y double")
    values = spark.createDataFrame([(i, float(a)) for i, a in enumerate(v)], "id long, v double")
    links = [(i, (i * 7 + j) % n) for i in range(n) for j in (1, 2, 150) if (i * 7 + j) % n != i]
    sums = []
    number = {r["id"]: r["d"] for r in spark.range(n).select("id", F.array(*[F.pmod(F.xxhash64("id", F.lit(r), F.lit(7)), F.lit(1 << 52)) for r in range(1, reps + 1)]).alias("d")).collect()}
    z = v - v.mean()
    for r in range(reps + 1):
        dealt = z if r == 0 else z[sorted(range(n), key=lambda i: (number[i][r - 1], i))]  # noqa: B023
        sums.append(sum(dealt[i] * dealt[j] for i, j in links) / (z @ z) / 3)
    df = spark.createDataFrame(links, "id long, other long")
    row = spatial.morans_i(points, df, values, "v", 3, permutations=reps).first()
    assert abs(row["i"] - sums[0]) < 1e-12 and row["permutations"] == reps
    assert row["pseudo_p"] == (1 + sum(abs(s) >= abs(sums[0]) for s in sums[1:])) / (1 + reps)


def largest_parts(monkeypatch, most):
    """Rows of the largest partition of every table that the loops of ``graph`` write, with tasks of ``most`` rows."""
    monkeypatch.setattr(session, "TASK_ROWS", most, raising=False)
    sizes = []

    def written(df):
        out = settle(df)
        sizes.append(out.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] or 0)
        return out
    monkeypatch.setattr(graph, "settle", written)
    return sizes


def test_closure_deals_its_rows(spark, monkeypatch):
    sizes = largest_parts(monkeypatch, 1000)
    tree = spark.range(1, 2048).select(F.col("id").cast("string").alias("child"), F.floor(F.col("id") / 2).cast("string").alias("parent"))
    got = {r[:] for r in graph.transitive_closure(tree).collect()}
    assert got == {(str(i), str(i >> k)) for i in range(1, 2048) for k in range(1, i.bit_length() + 1)}
    assert max(sizes) < 1300


def test_closure_of_rings_and_shortcuts(spark):
    links = [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 5), (5, 6), (6, 7), (3, 7), (7, 8), (9, 9), (0, 4)]
    want = set(links)
    while more := {(a, d) for a, b in want for c, d in want if b == c} - want:
        want |= more
    edges = spark.createDataFrame(links, "child long, parent long")
    for loops in (True, False):
        got = [r[:] for r in graph.transitive_closure(edges, keep_loops=loops).collect()]
        assert len(got) == len(set(got)) and set(got) == {(a, b) for a, b in want if loops or a != b}


def test_horn_joins_only_what_is_new(spark, monkeypatch):
    links = [(str(i), str(i + 1)) for i in range(6)] + [("6", "2"), ("4", "9")]
    want = set(links)
    while more := {(a, d) for a, b in want for c, d in want if b == c} - want:
        want |= more
    Atom, Rule, Test = graph.Atom, graph.Rule, graph.Test
    step = Rule("1", Atom("far", ("?x", "?y")), [Atom("near", ("?x", "?y"))])
    again = Rule("2", Atom("far", ("?x", "?z")), [Atom("far", ("?x", "?y")), Atom("near", ("?y", "?z"))])
    tested = Rule("2", again.head, [*again.body, Test("<>", ("?x", "none"))])  # no plain closure, so it goes round by round
    swapped = Rule("2", again.head, [Atom("near", ("?y", "?z")), Atom("far", ("?x", "?y"))])
    relations = {"near": spark.createDataFrame(links, "a0 string, a1 string")}
    calls = []
    match = graph.match
    monkeypatch.setattr(graph, "match", lambda body, table: calls.append(len(body)) or match(body, table))
    for rules, limit, most in (([step, again], None, 0), ([step, again], 50, 12), ([step, tested], None, 12), ([step, swapped], None, 12)):
        calls.clear()
        got = [r[:] for r in graph.horn(relations, rules, limit)["far"].collect()]
        assert len(got) == len(set(got)) and set(got) == want
        assert len(calls) <= most and calls.count(1) <= 1  # a rule of facts alone fires once
    loops = Rule("3", Atom("loop", ("?x",)), [Atom("far", ("?x", "?x"))])
    assert {r[0] for r in graph.horn(relations, [step, again, loops])["loop"].collect()} == {a for a, b in want if a == b}


def test_inference_deals_its_rows(spark, monkeypatch):
    sizes = largest_parts(monkeypatch, 1000)
    facts = spark.range(6000).coalesce(1).select(F.concat(F.lit("a"), "id").alias("s"), F.lit("near").alias("p"), F.concat(F.lit("b"), F.col("id").cast("string")).alias("o"), F.lit("object").alias("kind"))
    words = graph.vocabulary(spark, sub_property=[("near", "by")], traits=[("near", "symmetric")], inverse=[("near", "beside")])
    assert graph.infer(facts, words).groupBy("p").count().orderBy("p").collect() == [("beside", 12000), ("by", 12000), ("near", 12000)]
    assert max(sizes) < 1400


def test_clusters_of_crowded_cells_in_time(spark):
    # 150000 points on a square of four radii: billions of pairs of points are within the radius
    points = spark.range(150_000).select("id", F.lit("all").alias("part"), (F.rand(1) * 40).alias("_x"), (F.rand(2) * 40).alias("_y"))
    stop = threading.Timer(100, spark.sparkContext.cancelAllJobs)
    stop.start()
    try:
        row = spatial.dbscan(settle(points), 10.0, 4).agg(F.count_distinct("cluster"), F.count("cluster")).first()
    finally:
        stop.cancel()
    assert tuple(row) == (1, 150_000)


@pytest.mark.parametrize("gap, deal", [(9.99, 500), (10.0, 500), (9.99, 2_000_000)])
def test_clusters_that_corners_leave_open(spark, monkeypatch, gap, deal):
    # two crowded bars, far apart at their ends, a copied location and some points around them
    monkeypatch.setattr(spatial, "DEALT", deal)
    rng = np.random.default_rng(8)
    at = np.linspace(0, 14, 500)
    bars = [np.column_stack([0.0 + bent, at]) for bent in (-(at - 7) ** 2 / 100, gap + (at - 7) ** 2 / 100)]
    xy = np.vstack([*bars, np.repeat([[-30.0, 2.0]], 9, axis=0), rng.uniform(-40, 40, (300, 2)) + [0, 60]])
    points = spark.createDataFrame([(i, "ab"[i % 7 == 0], float(x), float(y)) for i, (x, y) in enumerate(xy)], "id long, part string, _x double, _y double")
    want = 0
    got = {r["id"]: r["cluster"] for r in spatial.dbscan(points, 10.0, 5).collect()}
    for part in "ab":
        ids = np.array([i for i in range(len(xy)) if "ab"[i % 7 == 0] == part])
        near = ((xy[ids, None] - xy[ids]) ** 2).sum(-1) <= 100
        core = near.sum(1) >= 5
        groups = connected(near & core & core[:, None])
        want += len(set(groups[core]))
        assert [got[i] is None for i in ids] == (~near[:, core].any(1)).tolist()
        assert len({(got[i], g) for i, g in zip(ids[core], groups[core])}) == len(set(groups[core])) == len({got[i] for i in ids[core]})
    assert len(set(got.values()) - {None}) == want


def test_clusters_are_components_of_blocks(spark, monkeypatch):
    nodes = []

    def record(edges):
        nodes.append(edges.select("src").union(edges.select("dst")).distinct().count())
        return connected_components(edges)

    monkeypatch.setattr(spatial, "connected_components", record)
    lattice = spark.range(160 * 160).select("id", F.lit("all").alias("part"), (F.col("id") % 160).cast("double").alias("_x"), F.floor(F.col("id") / 160).cast("double").alias("_y"))
    row = spatial.dbscan(lattice, 1.5, 4).agg(F.count_distinct("cluster"), F.count("cluster")).first()
    assert tuple(row) == (1, 25600) and max(nodes) < 50


@pytest.mark.parametrize("deal", [1000, 2_000_000])
def test_distance_of_the_kth_neighbour(spark, monkeypatch, deal):
    monkeypatch.setattr(spatial, "DEALT", deal)
    rng = np.random.default_rng(3)
    few = rng.uniform(-50, 50, (60, 2))
    xy = np.vstack([np.repeat(few[:20], 12, axis=0), np.repeat(few[20:], 3, axis=0), rng.uniform(-50, 50, (700, 2)), rng.normal(20, 0.2, (500, 2)), rng.uniform(-900, 900, (150, 2))])
    parts = np.where(np.arange(len(xy)) < 5, "c", np.where(np.arange(len(xy)) % 3 == 0, "a", "b"))  # too few others in c
    points = spark.createDataFrame([(i, str(p), float(x), float(y)) for i, (p, (x, y)) in enumerate(zip(parts, xy))], "id long, part string, _x double, _y double")
    got = {r["id"]: r["distance"] for r in spatial.kth_distances(points, 8).collect()}
    want = {}
    for part in "ab":
        ids = np.flatnonzero(parts == part)
        far = np.sqrt(((xy[ids, None] - xy[ids]) ** 2).sum(-1))
        np.fill_diagonal(far, np.inf)
        want.update(zip(ids.tolist(), np.sort(far, axis=1)[:, 7].tolist()))
    assert got.keys() == want.keys() and max(abs(got[i] - want[i]) for i in want) < 1e-9


def connected(near):
    label = np.arange(len(near))
    while True:
        low = np.where(near, label, len(near)).min(1)
        step = np.minimum(label, low)
        if (step == label).all():
            return label
        label = step
