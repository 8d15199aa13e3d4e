"""Tail probabilities and order statistics against published or brute-force values."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from specula.functions import probability as p
from specula.operators import depend, series
from specula.plans.components import connected_components
from specula.plans.ordered import average_rank, exact_quantiles, ranked_counts
from specula.plans.sequence import with_lags, with_position


@pytest.mark.parametrize("got, want, tol", [
    (p.chi2_sf(3.841459, 1), 0.05, 1e-6), (p.chi2_sf(18.307038, 10), 0.05, 1e-6), (p.t_two_sided(2.228139, 10), 0.05, 1e-6),
    (p.f_sf(4.102821, 2, 10), 0.05, 1e-6), (p.normal_two_sided(1.959964), 0.05, 1e-6), (p.studentized_range_sf(3.877, 3, 10), 0.05, 5e-4),
    (p.studentized_range_sf(3.633, 4, math.inf), 0.05, 5e-4), (p.fisher_two_sided(3, 1, 1, 3), 0.485714, 1e-5),
    (p.ks_sf(1.3581 / math.sqrt(50), 100, 100), 0.05, 1e-3)])
def test_tails(got, want, tol):
    assert abs(got - want) < tol


def test_shapiro_published_example():
    w, prob = p.shapiro_wilk(np.array([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236], float))
    assert abs(w - 0.7888) < 1e-3 and abs(prob - 0.0067) < 1e-3


def skewed(spark, n=3000):
    """A third of the rows share one value."""
    rng = np.random.default_rng(1)
    x = np.where(rng.random(n) < 0.34, 5.0, rng.normal(10, 4, n).round(2))
    return pd.DataFrame({"id": range(n), "x": x, "y": (x * 0.3 + rng.normal(0, 2, n)).round(1)})


def test_quantiles_and_ranks_with_a_hot_value(spark):
    pdf = skewed(spark)
    df = spark.createDataFrame(pdf).repartition(4)
    probs = [0, 0.01, 0.25, 0.5, 0.9, 1]
    assert np.allclose(exact_quantiles(df, ["x"], probs)["x"], np.quantile(pdf["x"], probs))
    ranks = {r["value"]: r["rank"] for r in ranked_counts(df, ["x"]).select("value", average_rank().alias("rank")).collect()}
    want = pdf["x"].rank()
    assert all(ranks[v] == w for v, w in zip(pdf["x"], want))
    got = depend.spearman_pairs(df, ["x", "y"]).first()["spearman"]
    assert abs(got - pdf["x"].rank().corr(pdf["y"].rank())) < 1e-12


def test_kendall_counts_every_pair(spark):
    pdf = skewed(spark, 400)
    dx, dy = np.sign(np.subtract.outer(pdf.x.values, pdf.x.values)), np.sign(np.subtract.outer(pdf.y.values, pdf.y.values))
    s = np.triu(dx * dy, 1)
    row = depend.kendall(spark.createDataFrame(pdf), "x", "y").first()
    assert (row["concordant"], row["discordant"]) == ((s > 0).sum(), (s < 0).sum())


@pytest.mark.parametrize("cell", [25, 60, 10_000])
def test_kendall_by_cells(spark, monkeypatch, cell):
    monkeypatch.setattr(depend, "CELL", cell)
    draw = np.random.default_rng(4)
    pdf = pd.DataFrame({"x": np.where(draw.random(900) < 0.2, 3.0, draw.normal(3, 2, 900).round(1)), "y": np.where(draw.random(900) < 0.3, -1.0, draw.integers(-200, 200, 900))})
    given, counted = [], depend.concordance
    monkeypatch.setattr(depend, "concordance", lambda points, *args, **kwargs: given.append(points.count()) or counted(points, *args, **kwargs))
    s = np.triu(np.sign(np.subtract.outer(pdf.x.values, pdf.x.values)) * np.sign(np.subtract.outer(pdf.y.values, pdf.y.values)), 1)
    row = depend.kendall(spark.createDataFrame(pdf), "x", "y").first()
    assert (row["concordant"], row["discordant"]) == ((s > 0).sum(), (s < 0).sum())
    assert given[0] < 800  # pairs of cells, where rows used to enter once per bit of their rank


def test_positions_and_lags_across_blocks(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"k": rng.choice(["a", "b"], 500, p=[0.8, 0.2]), "t": np.where(rng.random(500) < 0.3, 7.0, rng.random(500) * 20).round(1), "id": range(500)})
    placed = with_position(spark.createDataFrame(pdf), ["k"], "t", "id")
    got = with_lags(placed, ["k"], {"p1": ("id", 1), "p5": ("id", 5)}, block=16).toPandas().sort_values("id").reset_index(drop=True)
    want = pdf.sort_values(["t", "id"])
    for name, lag in (("p1", 1), ("p5", 5)):
        w = want.groupby("k")["id"].shift(lag).reindex(pdf.index)
        assert got[name].astype(float).equals(w.astype(float))
    assert len(got) == 500


def test_components_of_a_long_path(spark):
    edges = spark.range(60).filter("id < 40").select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    more = spark.createDataFrame([(50, 51), (52, 51), (55, 55)], "src long, dst long")
    found = {r["node"]: r["component"] for r in connected_components(edges.union(more)).collect()}
    assert {found[i] for i in range(41)} == {0} and found[52] == 50 and found[55] == 55


def test_theil_sen_both_ways(spark):
    rng = np.random.default_rng(3)
    y = (0.7 * np.arange(60) + rng.normal(0, 5, 60)).round(1)
    slopes = np.sort([(y[j] - y[i]) / (j - i) for i in range(60) for j in range(i + 1, 60)])
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(y)], "i long, v double")
    short = series.theil_sen(df).first()
    assert abs(short["slope"] - np.median(slopes)) < 1e-12
    tries = [-1.0131, 0.5131, 0.7131, 2.0131]
    want = [(slopes <= t).sum() for t in tries]
    points = np.column_stack([np.arange(60), y])
    assert series._count_slopes(df, tries, points) == want == series._count_slopes(df, tries, None)


def test_change_points_find_planted_shifts(spark):
    rng = np.random.default_rng(4)
    y = np.concatenate([rng.normal(0, 1, 300), rng.normal(6, 1, 200), rng.normal(-3, 1, 250)])
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(y)], "i long, e double")
    cuts = [r["i"] for r in series.change_points(df).collect()]
    assert len(cuts) == 2 and abs(cuts[0] - 300) <= 2 and abs(cuts[1] - 500) <= 2
