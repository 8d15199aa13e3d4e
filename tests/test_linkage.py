"""Ward's hierarchy against a plain loop, and planted groups in all rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from specula.operators import linkage, segments


def brute_ward(x, k):
    groups = [[i] for i in range(len(x))]
    while len(groups) > k:
        best = None
        means = [x[g].mean(0) for g in groups]
        for i in range(len(groups)):
            for j in range(i):
                a, b = len(groups[i]), len(groups[j])
                grown = a * b / (a + b) * ((means[i] - means[j]) ** 2).sum()
                if best is None or grown < best[0]:
                    best = (grown, i, j)
        _, i, j = best
        groups[j] += groups.pop(i)
    return {frozenset(g) for g in groups}


def test_ward_by_brute_force(spark):
    draw = np.random.default_rng(5)
    x = np.concatenate([draw.normal(c, s, (n, 2)) for c, s, n in ((0, 1, 60), (4, 2, 50), (9, 0.5, 40))])
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)], "id long, `a.b` double, y double").repartition(4)
    for k in (2, 3, 7, 20):
        got = {}
        for r in linkage.with_groups(df, ["a.b", "y"], k).select("id", "segment").collect():
            got.setdefault(r["segment"], set()).add(r["id"])
        assert {frozenset(g) for g in got.values()} == brute_ward(x, k)


@pytest.mark.parametrize("leaves", [40, 512])
def test_planted_groups_in_all_rows(spark, leaves):
    centre = F.element_at(F.array(*[F.lit(float(c)) for c in (0, 50, 120, 300)]), F.pmod(F.col("id"), F.lit(4)).cast("int") + 1)
    df = spark.range(40_000).select("id", *[(centre + 3 * F.randn(seed)).alias(c) for seed, c in ((1, "x"), (2, "y"), (3, "z"))], F.pmod("id", F.lit(4)).alias("planted"))
    features = linkage.clustering_features(df, ["x", "y", "z"], leaves)
    assert features.count() <= leaves and features.agg(F.sum("n")).first()[0] == 40_000
    found = linkage.with_groups(df, ["x", "y", "z"], 4, leaves)
    assert segments.adjusted_rand(found, "segment", "planted").first()[0] == 1.0


def test_features_add_up(spark):
    draw = np.random.default_rng(2)
    x = draw.normal(size=(500, 3))
    (n, mean, squares), _ = linkage.fold(np.ones(500), x, np.zeros(500), 20)
    assert len(n) <= 20 and np.isclose(n.sum(), 500)
    total = (squares + n * ((mean - x.mean(0)) ** 2).sum(1)).sum()
    assert np.isclose(total, ((x - x.mean(0)) ** 2).sum())


def test_incomplete_rows_and_empty_tables(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0), (2, 9.0, 9.0), (3, None, 1.0), (4, float("nan"), 1.0), (5, 0.1, 0.0)], "id int, x double, y double")
    got = {r["id"]: r["segment"] for r in linkage.with_groups(df, ["x", "y"], 2).collect()}
    assert got == {1: 0, 2: 1, 3: None, 4: None, 5: 0}
    assert linkage.with_groups(df.limit(0), ["x", "y"], 2).count() == 0
