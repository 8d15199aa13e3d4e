"""Robust seasonal-trend decomposition against plain loops over the whole series."""

import numpy as np
import pytest

from specula.operators import stl


def line_at(y, q, x, span, w):
    n = len(y)
    left = 0 if q >= n else min(max(x + 1 - (q + 1) // 2, 0), n - q)
    right = min(left + q, n) - 1
    h = max(x - left, right - x) + (max(q - n, 0) // 2)
    ks = range(left, right + 1)
    weight = []
    for k in ks:
        d = abs(k - x)
        weight.append((1.0 if d <= 0.001 * h else (1 - (d / h) ** 3) ** 3 if d <= 0.999 * h else 0.0) * w[k])
    total = sum(weight)
    if total <= 0:
        return None
    weight = [u / total for u in weight]
    mean = sum(u * k for u, k in zip(weight, ks))
    spread = sum(u * (k - mean) ** 2 for u, k in zip(weight, ks))
    if h > 0 and spread ** 0.5 > 0.001 * (span - 1):
        weight = [u * (1 + (x - mean) / spread * (k - mean)) for u, k in zip(weight, ks)]
    return sum(u * y[k] for u, k in zip(weight, ks))


def brute(v, period, seasonal, trend_q, low, inner, outer):
    n = len(v)
    trend, w = [0.0] * n, [1.0] * n
    for turn in range(outer + 1):
        for _ in range(inner):
            cycle = [0.0] * (n + 2 * period)
            for phase in range(period):
                own, ow = [v[i] - trend[i] for i in range(phase, n, period)], [w[i] for i in range(phase, n, period)]
                made = [line_at(own, seasonal, x, len(own), ow) for x in range(-1, len(own) + 1)]
                made[1:-1] = [own[i] if m is None else m for i, m in enumerate(made[1:-1])]
                made[0], made[-1] = made[1] if made[0] is None else made[0], made[-2] if made[-1] is None else made[-1]
                for j, m in enumerate(made):
                    cycle[phase + j * period] = m
            for width in (period, period, 3):
                cycle_next = [sum(cycle[i:i + width]) / width for i in range(len(cycle) - width + 1)]
                if width == period and len(cycle) == n + 2 * period:
                    whole = cycle
                cycle = cycle_next
            level = [line_at(cycle, low, i, n, [1.0] * n) for i in range(n)]
            season = [whole[period + i] - level[i] for i in range(n)]
            plain = [a - b for a, b in zip(v, season)]
            trend = [line_at(plain, trend_q, i, n, w) for i in range(n)]
            trend = [p if t is None else t for t, p in zip(trend, plain)]
        if turn < outer:
            r = [abs(a - b - c) for a, b, c in zip(v, trend, season)]
            six = 6 * float(np.median(r))
            w = [1.0 if x <= 0.001 * six else (1 - (x / six) ** 2) ** 2 if x <= 0.999 * six else 0.0 for x in r]
    return np.array(trend), np.array(season), np.array(w)


def series(n, period, seed=0):
    draw = np.random.default_rng(seed)
    i = np.arange(n)
    season = 5 * np.sin(2 * np.pi * i / period) + 2 * (i % period == 1)
    v = 10 + 0.01 * i + season + draw.normal(0, 0.3, n)
    bad = draw.choice(n, n // 25, replace=False)
    v[bad] += draw.choice([-60, 40], len(bad))
    return v, season - season[:period].mean(), bad


@pytest.mark.parametrize("n, period, inner, outer, block", [(150, 7, 2, 3, 10**6), (420, 5, 1, 2, 100), (900, 4, 2, 1, 50), (30, 7, 1, 1, 10)])
def test_blocks_by_brute_force(spark, n, period, inner, outer, block):
    v, *_ = series(n, period, n)
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "i long, v double").repartition(4)
    got = stl.robust_decompose(df, period, inner=inner, outer=outer, block=block).orderBy("i").toPandas()
    trend, season, w = brute(list(v), period, 7, stl.next_odd(1.5 * period / (1 - 1.5 / 7)), stl.next_odd(period + 1), inner, outer)
    assert list(got["i"]) == list(range(n))
    for name, want in (("trend", trend), ("seasonal", season), ("weight", w)):
        assert np.allclose(got[name], want, atol=1e-7), name


def test_a_planted_season_among_outliers(spark):
    v, season, bad = series(600, 12, 4)
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "i long, v double")
    got = stl.robust_decompose(df, 12, outer=6, block=200).orderBy("i").toPandas()
    plain = stl.robust_decompose(df, 12, outer=0, block=200).orderBy("i").toPandas()
    good = np.setdiff1d(np.arange(600), bad)
    error = lambda p: np.abs(p["seasonal"].to_numpy() - season)[good].mean()
    assert error(got) < 0.25 < 2 * error(got) < error(plain)
    assert (got["weight"].to_numpy()[bad] == 0).all() and got["weight"].to_numpy()[good].mean() > 0.8


def test_what_is_no_series(spark):
    rows = [(i, float(i)) for i in range(20)]
    make = lambda r: spark.createDataFrame(r, "i long, v double")
    assert stl.robust_decompose(make([]), 4).count() == 0
    for bad in (rows[:6], rows[1:], rows + [(25, 1.0)], [(i, None if i == 3 else x) for i, x in rows]):
        with pytest.raises(ValueError):
            stl.robust_decompose(make(bad), 4)
