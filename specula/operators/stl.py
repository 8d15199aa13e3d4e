"""Seasonal-trend decomposition by local regression, robust against outliers, over overlapping blocks of time.

Every smoother looks at a bounded neighbourhood, so a block with enough points on either side gives the
same values as the whole series. Blocks are smoothed in one grouped map a round; between rounds the
series' median residual sets the robustness weights. No task holds more than a block and its margins.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specula.plans.ordered import exact_quantiles
from specula.session import settle

SHAPE = "i long, v double, trend double, seasonal double, w double"


def next_odd(x: float) -> int:
    n = math.ceil(x)
    return n if n % 2 else n + 1


def local_line(y, q: int, at, span: int, weights=None):
    """Locally weighted lines through the ``q`` nearest points of a series at the places ``at``.

    Weights fall with the cube of the distance. Where the points lie closer together than a thousandth of ``span``, the
    length of the whole series, the line is level, as the published method has it; where all weights are zero there is no value.
    """
    import numpy as np
    n, m = len(y), min(q, len(y))
    out = np.empty(len(at))
    for start in range(0, len(at), 2048):
        x = at[start:start + 2048]
        lo = np.clip(x + 1 - (q + 1) // 2, 0, max(n - q, 0))
        k = lo[:, None] + np.arange(m)
        h = np.maximum(x - lo, lo + m - 1 - x) + (max(q - n, 0) // 2)
        d = np.abs(k - x[:, None])
        with np.errstate(divide="ignore", invalid="ignore"):
            w = np.where(d <= 0.001 * h[:, None], 1.0, np.where(d <= 0.999 * h[:, None], (1 - (d / h[:, None]) ** 3) ** 3, 0.0))
            if weights is not None:
                w = w * weights[k]
            total = w.sum(1)
            w = w / total[:, None]
            off = k - x[:, None]
            mean = (w * off).sum(1)
            spread = (w * (off - mean[:, None]) ** 2).sum(1)
            slope = np.where((np.sqrt(spread) > 0.001 * (span - 1)) & (h > 0), -mean / spread, 0.0)
            value = (w * y[k] * (1 + slope[:, None] * (off - mean[:, None]))).sum(1)
        out[start:start + 2048] = np.where(total > 0, value, np.nan)
    return out


def _moving(y, n: int):
    import numpy as np
    run = np.concatenate([[0.0], np.cumsum(y)])
    return (run[n:] - run[:-n]) / n


def smooth(v, trend, weights, period: int, seasonal: int, wide: int, low: int, inner: int, size: int):
    """(trend, seasonal) of one stretch of a series of ``size`` points that begins with phase 0."""
    import numpy as np
    n = len(v)
    every = np.arange(n)
    for _ in range(inner):
        rest, cycle = v - trend, np.empty(n + 2 * period)
        for phase in range(min(period, n)):
            own = rest[phase::period]
            own_w = None if weights is None else weights[phase::period]
            made = local_line(own, seasonal, np.arange(-1, len(own) + 1), -(-(size - phase) // period), own_w)
            made[1:-1] = np.where(np.isnan(made[1:-1]), own, made[1:-1])
            made[0], made[-1] = (made[1] if np.isnan(made[0]) else made[0]), (made[-2] if np.isnan(made[-1]) else made[-1])
            cycle[phase::period][:len(made)] = made
        level = local_line(_moving(_moving(_moving(cycle, period), period), 3), low, every, size)
        season = cycle[period:period + n] - level
        plain = v - season
        trend = local_line(plain, wide, every, size, weights)
        trend = np.where(np.isnan(trend), plain, trend)
    return trend, season


def robust_decompose(series: DataFrame, period: int, seasonal: int = 7, trend: int | None = None, low: int | None = None,
                     inner: int = 2, outer: int = 15, block: int = 100_000) -> DataFrame:
    """(i, v, trend, seasonal, resid, weight) of a series (i, v) with every position from 0 once and no gaps.

    ``seasonal``, ``trend`` and ``low`` are the odd widths of the smoothers, by default 7, the first odd number from
    1.5 period / (1 - 1.5 / seasonal) on and the first odd number above the period. After each of ``outer`` rounds, points
    count less the further they are from the fit, none beyond six median residuals. An empty series gives
    an empty result; a series of less than two periods is an error, as is a missing value.
    """
    trend, low = trend or next_odd(1.5 * period / (1 - 1.5 / seasonal)), low or next_odd(period + 1)
    if period < 2 or not all(x % 2 and x >= 3 for x in (seasonal, trend, low)):
        raise ValueError("a period has two points at least, and widths are odd numbers from 3 on")
    facts = series.agg(F.count(F.lit(1)).alias("n"), F.min("i").alias("lo"), F.max("i").alias("hi"), F.count("v").alias("known")).first()
    n = facts["n"]
    if n and (n < 2 * period or facts["lo"] != 0 or facts["hi"] != n - 1 or facts["known"] != n):
        raise ValueError("a series needs two periods, and a value at each position from 0")
    # how far a value of one round can depend on others
    reach = inner * ((seasonal + 3) * period + low + trend + 8)
    margin = -(-reach // period) * period
    block = max(-(-block // period) * period, margin)
    keep = series.select("i", F.col("v").cast("double").alias("v"), F.lit(0.0).alias("trend"), F.lit(0.0).alias("seasonal"), F.lit(1.0).alias("w"))

    def run(key, part):
        part = part.sort_values("i")
        here = key[0]
        begin = int(part["i"].iloc[0])
        weights = part["w"].to_numpy() if (part["w"] != 1.0).any() else None
        found = smooth(part["v"].to_numpy(), part["trend"].to_numpy(), weights, period, seasonal, trend, low, inner, n)
        part["trend"], part["seasonal"] = found
        a = max(here * block - begin, 0)
        return part.iloc[a:a + block]

    own = F.floor(F.col("i") / block)
    into = F.col("i") % block
    homes = F.filter(F.array(own, F.when(into < margin, own - 1), F.when(into >= block - margin, own + 1)), lambda b: b.isNotNull() & (b >= 0) & (b <= max(n - 1, 0) // block))
    for turn in range(outer + 1):
        fitted = keep.withColumn("block", F.explode(homes)).groupBy("block").applyInPandas(lambda key, part: run(key, part.drop(columns="block")), SHAPE)
        fitted = settle(fitted)
        if turn == outer or not n:
            break
        apart = F.abs(F.col("v") - F.col("trend") - F.col("seasonal"))
        six = 6 * exact_quantiles(fitted.select(apart.alias("r")), ["r"], [0.5])["r"][0]
        share = apart / six if six else F.lit(0.0)
        keep = fitted.withColumn("w", F.when(apart <= 0.001 * six, 1.0).when(apart <= 0.999 * six, F.pow(1 - share * share, F.lit(2))).otherwise(0.0))
    return fitted.select("i", "v", "trend", "seasonal", (F.col("v") - F.col("trend") - F.col("seasonal")).alias("resid"), F.col("w").alias("weight"))
