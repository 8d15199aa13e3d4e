"""Ranks and quantiles whose window tasks stay below a set size on any distribution."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from specula.operators import depend, hypothesis
from specula.plans import ordered
from specula.plans.longform import numeric_long


@pytest.fixture(scope="module")
def skewed():
    """Values over 30 powers of ten, a third of all rows one value, infinities, ties and gaps."""
    draw = np.random.default_rng(0)
    v = np.concatenate([np.exp(draw.normal(0, 8, 12_000)), -np.exp(draw.normal(0, 8, 4_000)), np.full(9_000, 3.5), draw.integers(0, 50, 2_000), [np.inf, -np.inf, 0.0, -0.0]])
    draw.shuffle(v)
    return v


def table(spark, v):
    return spark.createDataFrame([(i, float(x), None if i % 7 == 0 else float(i % 1000)) for i, x in enumerate(v)], "id long, v double, w double").repartition(8)


def test_no_cell_has_more_values_than_asked_for(spark, skewed):
    df = table(spark, skewed)
    most = 400
    cuts = ordered.cut_points(df, ["v", "w"], most=most)
    cells = numeric_long(df, ["v", "w"]).withColumn("bucket", ordered.bucket_by_column(F.col("column"), F.col("value"), cuts))
    sizes = cells.groupBy("column", "bucket").agg(F.countDistinct("value").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi")).collect()
    assert max(r["n"] for r in sizes) <= most
    for c in ("v", "w"):  # cells are in the order of their values
        mine = sorted((r for r in sizes if r["column"] == c), key=lambda r: r["bucket"])
        assert len(mine) > len(skewed) / 4 / most and all(a["hi"] < b["lo"] for a, b in zip(mine, mine[1:]))
    assert all(len(x) > 32 for x in cuts.values() if len(x) != len(cuts["w"]))


def test_ranks_with_small_cells(spark, skewed, monkeypatch):
    monkeypatch.setattr(ordered, "MOST", 300)
    got = {(r["column"], r["value"]): (r["before_n"], r["n"], r["total_n"]) for r in ordered.ranked_counts(table(spark, skewed), ["v"]).collect()}
    values, counts = np.unique(skewed, return_counts=True)
    before = np.cumsum(counts) - counts
    assert got == {("v", float(x)): (int(b), int(n), len(skewed)) for x, b, n in zip(values, before, counts)}


@pytest.mark.parametrize("most", [None, 50])
def test_selection_by_repeated_counting(spark, skewed, most):
    wanted = {0, 1, 5_000, 13_371, 13_372, len(skewed) - 1}
    totals, found = ordered.order_statistics(table(spark, skewed), ["v"], lambda n: wanted, most)
    order = np.sort(skewed)
    assert totals == {"v": len(skewed)} and {k for _, k in found} == wanted
    for (_, k), (value, begin) in found.items():
        assert value == order[k] and begin == int((skewed < order[k]).sum())


def test_lookup_by_halving_agrees_with_the_tree(spark):
    bounds = [float(x) for x in sorted(set(np.round(np.random.default_rng(1).normal(0, 5, 300), 3)))]
    df = spark.createDataFrame([(float(x),) for x in [*bounds, *np.random.default_rng(2).normal(0, 6, 500), float("inf"), float("-inf")]], "v double")
    got = df.select("v", ordered.bucket_of(F.col("v"), bounds).alias("b")).collect()
    assert all(r["b"] == np.searchsorted(bounds, r["v"], side="right") for r in got)


def test_rows_are_collapsed_before_values_are_placed(spark, skewed, monkeypatch):
    # comparing every row with cut points took most of the time of large tables
    def refuse(*args, **kwargs):
        raise AssertionError("rows are compared with cut points")
    for module in (ordered, hypothesis):
        monkeypatch.setattr(module, "cut_points", refuse, raising=False)
    monkeypatch.setattr(ordered, "MOST", 300)
    df = table(spark, skewed).withColumn("g", F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b"))
    got = {r["value"]: (r["n0"], r["n1"], r["before_n0"], r["before_n1"], r["total_n0"]) for r in hypothesis.ranked_sides(df, {"g": ["a", "b"]}, ["v"]).collect()}
    a, b = skewed[0::3], skewed[1::3]
    assert got == {float(x): (int((a == x).sum()), int((b == x).sum()), int((a < x).sum()), int((b < x).sum()), len(a)) for x in np.unique(np.concatenate([a, b]))}


def test_ranks_return_to_rows_in_small_tasks(spark, skewed, monkeypatch):
    monkeypatch.setattr(ordered, "MOST", 300)
    df = table(spark, skewed)
    ranked = depend.rank_columns(df, ["v", "w"], ["id"])
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "_row" not in plan  # v by shuffle, w by broadcast, and no table of rows times columns
    values, place, counts = np.unique(skewed, return_inverse=True, return_counts=True)
    want = (np.cumsum(counts) - counts + (counts + 1) / 2)[place]
    rows = ranked.collect()
    assert len(rows) == len(skewed) and all(r["v"] == want[r["id"]] and (r["w"] is None) == (r["id"] % 7 == 0) for r in rows)
    assert ranked.rdd.getNumPartitions() >= len(skewed) // 300


@pytest.fixture()
def sides(spark, monkeypatch):
    """Rows of two values and two groups that fill many chunks and cells, with ties, nulls, NaN, infinities and a hot value."""
    from specula.plans import packed
    monkeypatch.setattr(packed, "CHUNK", 70)
    monkeypatch.setattr(packed, "MOST", 40)

    def refuse(*args, **kwargs):
        raise AssertionError("a row per value is shuffled and put in order again")
    for name in ("range_cells", "running_totals"):
        monkeypatch.setattr(hypothesis, name, refuse)
    rng = np.random.default_rng(5)
    x = np.where(rng.random(1500) < 0.4, 7.0, np.round(rng.lognormal(0, 3, 1500), 1))
    x[:6] = [float("nan"), float("nan"), float("inf"), float("-inf"), 0.0, -0.0]
    y = rng.normal(0, 1, 1500)
    rows = [(None if i % 31 == 9 else float(x[i]), float(y[i]), None if i % 17 == 3 else "abc"[i * i % 7 % 3], "pq"[int(y[i] > rng.normal())]) for i in range(1500)]
    return rows, spark.createDataFrame(rows, "x double, y double, g string, h string").repartition(3)


LEVELS = {"g": ["a", "b", "c"], "h": ["p", "q"]}


def samples(rows, group, value):
    """{level: values} of one pair, minus zero and NaN made plain numbers that keep the order."""
    plain = lambda v: 1e300 * 1e8 if v != v else min(v + 0.0, 1e300) if v > 0 else max(v + 0.0, -1e300)
    out = {name: [] for name in LEVELS[group]}
    for r in rows:
        level, v = r[2 if group == "g" else 3], r[0 if value == "x" else 1]
        if level is not None and v is not None:
            out[level].append(plain(v))
    return {k: np.array(v) for k, v in out.items()}


def test_rank_sums_come_from_packed_cells(spark, sides):
    rows, df = sides
    got = {(r["group_col"], r["value_col"], r["level"]): (r["n"], r["r"], r["total"], r["ties"]) for r in hypothesis.rank_sums(hypothesis.rank_cells(df, LEVELS, ["x", "y"]), LEVELS).collect()}
    want = {}
    for g in LEVELS:
        for v in ("x", "y"):
            own = samples(rows, g, v)
            both = np.concatenate(list(own.values()))
            sizes = np.unique(both, return_counts=True)[1].astype(float)
            for level, a in own.items():
                want[g, v, level] = (len(a), sum((both < z).sum() + ((both == z).sum() + 1) / 2 for z in a), len(both), (sizes ** 3 - sizes).sum())
    assert got == want


def test_mann_whitney_comes_from_packed_cells(spark, sides):
    rows, df = sides
    cells = hypothesis.rank_cells(df, LEVELS, ["x", "y"], pairs=True)
    assert cells.filter("group_col = 'g' AND value_col = 'y'").count() > 20
    got = {(r["group_col"], r["value_col"], r["a"], r["b"]): r for r in hypothesis.mann_whitney_pairs(cells, LEVELS).collect()}
    assert len(got) == 8
    for (g, v, a, b), r in got.items():
        one, two = samples(rows, g, v)[a], samples(rows, g, v)[b]
        u = sum((two < z).sum() + (two == z).sum() / 2 for z in one)
        sizes = np.unique(np.concatenate([one, two]), return_counts=True)[1].astype(float)
        n1, n2 = len(one), len(two)
        spread = np.sqrt(n1 * n2 / 12 * (n1 + n2 + 1 - (sizes ** 3 - sizes).sum() / ((n1 + n2) * (n1 + n2 - 1))))
        assert (r["n1"], r["n2"], r["u"]) == (n1, n2, u)
        assert r["z"] == pytest.approx(max(0.0, (max(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / spread), rel=1e-12)


def test_kept_levels_of_packed_cells(spark, sides):
    rows, df = sides
    kept = spark.createDataFrame([("g", "x", "a"), ("g", "x", "c"), ("h", "y", "q")], "group_col string, value_col string, level string")
    got = {(r["group_col"], r["value_col"], r["level"]): (r["n"], r["total"]) for r in hypothesis.rank_sums(hypothesis.rank_cells(df, LEVELS, ["x", "y"], kept), LEVELS).collect()}
    a, c, q = (len(samples(rows, *w)[level]) for *w, level in (("g", "x", "a"), ("g", "x", "c"), ("h", "y", "q")))
    assert got == {("g", "x", "a"): (a, a + c), ("g", "x", "c"): (c, a + c), ("h", "y", "q"): (q, q)}


def test_packed_counts_shuffle_few_rows(spark):
    from specula.plans import packed
    df = spark.range(0, 50_000, 1, 4).select((F.col("id") * 37 % 9973).cast("double").alias("x"), (F.col("id") % 3).cast("int").alias("i"))
    counts = packed.packed_counts(df, ["x"], [F.col("i")], 3)
    assert counts.count() <= 4 * 8  # a row per task and cell
    assert counts.select(F.sum(F.octet_length("n") / 4)).first()[0] > 20_000


def test_rank_cells_of_no_rows(spark):
    df = spark.createDataFrame([], "x double, g string")
    cells = hypothesis.rank_cells(df, {"g": ["a", "b"]}, ["x"], pairs=True)
    assert hypothesis.rank_sums(cells, {"g": ["a", "b"]}).collect() == [] and hypothesis.mann_whitney_pairs(cells, {"g": ["a", "b"]}).collect() == []
