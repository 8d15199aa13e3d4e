"""Repetitions against plain loops over the same draws."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from specula.operators import hypothesis
from specula.plans import resample


def plain_draw(row_id, rep, seed=7):
    h = hashlib.md5(f"{row_id}:{seed}".encode()).hexdigest()
    a, b = int(h[:8], 16) % resample.MODULUS, int(h[8:16], 16) % resample.MODULUS
    return (a + b * rep) % resample.MODULUS


@pytest.fixture(scope="module")
def table(spark):
    rows = [(i, None if i % 17 == 3 else float((i * 37) % 101) + (4.0 if i % 3 == 0 else 0.0), i % 3 == 0) for i in range(400)]
    return rows, spark.createDataFrame(rows, "id long, y double, g boolean").repartition(7)


def test_bootstrap_is_the_plain_loop(table):
    rows, df = table
    limits, stats = resample.poisson_limits(), []
    for rep in range(1, 61):
        w = {i: sum(plain_draw(i, rep) >= x for x in limits) for i, y, _ in rows if y is not None}
        stats.append(sum(w[i] * y for i, y, _ in rows if y is not None) / sum(w.values()))
    got = hypothesis.bootstrap_interval(df, "y", "id", reps=60).first()
    assert got["reps"] == 60
    assert [got["ci_low"], got["centre"], got["ci_high"]] == pytest.approx(np.quantile(stats, [0.025, 0.5, 0.975]).tolist(), rel=1e-9)


def test_permutation_is_the_plain_loop(table):
    rows, df = table
    kept = [(i, y, g) for i, y, g in rows if y is not None]
    share = sum(g for _, _, g in kept) / len(kept)
    gaps = []
    for rep in range(41):
        side = [g if rep == 0 else plain_draw(i, rep) < share * resample.MODULUS for i, _, g in kept]
        gaps.append(np.mean([y for (_, y, _), s in zip(kept, side) if s]) - np.mean([y for (_, y, _), s in zip(kept, side) if not s]))
    got = hypothesis.permutation_test(df, "y", F.col("g"), "id", reps=40).first()
    assert got["observed"] == pytest.approx(gaps[0]) and got["reps"] == 40
    assert got["p"] == pytest.approx((1 + sum(abs(d) >= abs(gaps[0]) for d in gaps[1:])) / 41)


def test_no_row_per_repetition(table):
    _, df = table
    plan = hypothesis.bootstrap_interval(df, "y", "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "MapInPandas" in plan


def test_weights_are_poisson():
    u = np.random.default_rng(3).integers(0, resample.MODULUS, 200_000)
    w = sum((u >= x).astype(int) for x in resample.poisson_limits())
    assert w.mean() == pytest.approx(1, abs=0.01) and w.var() == pytest.approx(1, abs=0.02)


def test_empty_and_one_sided(spark):
    none = spark.createDataFrame([], "id long, y double, g boolean")
    assert tuple(hypothesis.bootstrap_interval(none, "y", "id", reps=5).first()) == ("y", 0, None, None, None)
    assert hypothesis.permutation_test(none, "y", F.col("g"), "id", reps=5).first()["observed"] is None
    one = spark.createDataFrame([(1, 2.0, True), (2, 3.0, True)], "id long, y double, g boolean")
    assert hypothesis.permutation_test(one, "y", F.col("g"), "id", reps=5).first()["reps"] == 0
