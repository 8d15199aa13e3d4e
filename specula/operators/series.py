"""Regularity, resampling, trend, autocorrelation, seasons, stationarity and change points.

A series is (i, t, v): i counts steps of the modal interval. Everything that looks along the
series works on blocks of i that overlap by as much as it looks back.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specula.functions import tails
from specula.functions.probability import normal_sf
from specula.operators.depend import concordance
from specula.operators.typing import instant_gaps
from specula.plans.gram import gram
from specula.plans.longform import numeric_long
from specula.plans.ordered import exact_quantiles
from specula.plans.sequence import BLOCK, with_lags, with_position
from specula.session import settle

SMALL = 20_000  # series of at most this many points may be broadcast


def regularity(df: DataFrame, time: str) -> DataFrame:
    """Modal interval over distinct instants, gaps beyond 1.5 times it, the largest, and their share."""
    gaps = instant_gaps(df, time)
    modal = gaps.agg(F.max_by("seconds", F.struct("n", -F.col("seconds"))).alias("modal_seconds"))
    wide = F.col("seconds") > 1.5 * F.col("modal_seconds")
    return gaps.join(F.broadcast(modal), F.lit(True)).agg(
        F.max("modal_seconds").alias("modal_seconds"), F.sum("n").alias("steps"),
        F.sum(F.when(wide, F.col("n")).otherwise(0)).alias("gaps"), F.max("seconds").alias("largest_seconds")
    ).withColumn("gap_share", F.col("gaps") / F.col("steps"))


def lag_one(df: DataFrame, time: str, columns: list[str], row_id: str) -> DataFrame:
    """(column, n, lag1): correlation of each column with its previous value along time."""
    rows = df.select(F.unix_micros(F.col(time).cast("timestamp")).cast("double").alias("at"), F.col(row_id).cast("double").alias("tie"), *columns)
    long = numeric_long(rows.filter("at IS NOT NULL"), columns, ["at", "tie"])
    lagged = with_lags(with_position(long, ["column"], "at", "tie"), ["column"], {"prev": ("value", 1)})
    return lagged.groupBy("column").agg(F.count("value").alias("n"), F.corr("value", "prev").alias("lag1"))


def choose_series(df: DataFrame, time: str, columns: list[str], row_id: str, force: str | None = None) -> DataFrame:
    """Candidates by the strength of their memory; the first (or the forced one) is the series.

    Id-like names are no candidates.
    """
    names = [c for c in columns if not (c.lower() == "id" or c.lower().endswith("_id") or c.lower().startswith("id_"))]
    scored = lag_one(df, time, names, row_id).filter("n >= 20").select("column", "n", F.coalesce(F.nanvl("lag1", F.lit(0.0)), F.lit(0.0)).alias("lag1"))
    best = Window.partitionBy(F.lit(0)).orderBy((F.col("column") == F.lit(force or "")).desc(), F.abs("lag1").desc(), "column")  # candidates only
    return scored.withColumn("rank", F.row_number().over(best)).withColumn("chosen", F.col("rank") == 1)


def resample(df: DataFrame, time: str, value: str, step_seconds: float) -> DataFrame:
    """(i, t, v): means per step from the start of the first day, gaps filled on a straight line."""
    at = F.unix_micros(F.col(time).cast("timestamp"))
    rows = df.select(at.alias("us"), F.col(value).cast("double").alias("v")).dropna()
    day = 86_400_000_000
    first = rows.agg(F.min("us")).first()[0] // day * day
    step = int(round(step_seconds * 1e6))
    means = rows.groupBy(F.floor((F.col("us") - first) / step).cast("long").alias("k")).agg(F.avg("v").alias("v"))
    start = means.agg(F.min("k")).first()[0]
    known = with_position(means.select((F.col("k") - start).alias("i"), "v", F.lit(0).alias("one")), ["one"], "i", "i")
    pairs = with_lags(known, ["one"], {"pi": ("i", 1), "pv": ("v", 1)})
    span = F.sequence(F.coalesce(F.col("pi") + 1, F.col("i")), F.col("i"))
    full = pairs.withColumn("j", F.explode(span))
    line = F.when(F.col("j") == F.col("i"), F.col("v")).otherwise(
        F.col("pv") + (F.col("v") - F.col("pv")) * (F.col("j") - F.col("pi")) / (F.col("i") - F.col("pi")))
    return full.select(F.col("j").alias("i"), F.timestamp_micros(F.lit(first + start * step) + F.col("j") * step).alias("t"), line.alias("v"))


# ------------------------------------------------------------------ trend

def mann_kendall(series: DataFrame) -> DataFrame:
    """Sign sum of all ordered pairs with tie correction, counted without forming pairs."""
    top = series.agg(F.max("i"), F.count(F.lit(1))).first()
    pairs = concordance(series.select("i", "v"), [], "i", "v", max(1, int(top[0]).bit_length()))
    k = F.col("k").cast("double")
    ties = series.groupBy("v").agg(F.count(F.lit(1)).alias("k")).agg(F.sum(k * (k - 1) * (2 * k + 5)).alias("ties"))
    n = float(top[1])
    s = (F.col("concordant") - F.col("discordant")).cast("double")
    spread = (n * (n - 1) * (2 * n + 5) - F.col("ties")) / 18
    z = (s - F.signum(s)) / F.sqrt(spread)
    return pairs.join(ties, F.lit(True)).select(F.lit(int(n)).cast("long").alias("n"), s.alias("s"), z.alias("z")).withColumn("p", tails.p_normal("z"))


def _count_slopes(series: DataFrame, candidates: list[float], points: np.ndarray | None) -> list[int]:
    """How many pairwise slopes are at most each candidate."""
    spark = series.sparkSession
    if points is not None:
        shared = spark.sparkContext.broadcast(points)

        def count(batches):
            x, y = shared.value[:, 0], shared.value[:, 1]
            total = np.zeros(len(candidates), dtype=np.int64)
            for b in batches:
                for i, v in zip(b["i"].to_numpy(dtype=float), b["v"].to_numpy(dtype=float)):
                    at = np.searchsorted(x, i, side="right")
                    slopes = np.sort((y[at:] - v) / (x[at:] - i))
                    total += np.searchsorted(slopes, candidates, side="right")
            yield pd.DataFrame({"c": np.arange(len(candidates)), "n": total})

        rows = series.select("i", "v").repartition(8).mapInPandas(count, "c int, n long").groupBy("c").agg(F.sum("n").alias("n")).collect()
        found = {r["c"]: r["n"] for r in rows}
        return [found[c] for c in range(len(candidates))]
    n = len_series = series.count()
    spread = series.select("i", "v", F.posexplode(F.array(*[F.lit(float(c)) for c in candidates])).alias("c", "m")).select("c", "i", (F.col("v") - F.col("m") * F.col("i")).alias("y"))
    bits = max(1, int(series.agg(F.max("i")).first()[0]).bit_length())
    found = {r["c"]: r["concordant"] for r in concordance(spread, ["c"], "i", "y", bits).collect()}
    return [n * (len_series - 1) // 2 - found.get(c, 0) for c in range(len(candidates))]


def _slopes_between(series: DataFrame, points: np.ndarray, low: float, high: float) -> np.ndarray:
    shared = series.sparkSession.sparkContext.broadcast(points)

    def emit(batches):
        x, y = shared.value[:, 0], shared.value[:, 1]
        for b in batches:
            for i, v in zip(b["i"].to_numpy(dtype=float), b["v"].to_numpy(dtype=float)):
                at = np.searchsorted(x, i, side="right")
                s = (y[at:] - v) / (x[at:] - i)
                yield pd.DataFrame({"s": s[(s > low) & (s <= high)]})

    return np.sort(series.select("i", "v").repartition(8).mapInPandas(emit, "s double").toPandas()["s"].to_numpy())


def theil_sen(series: DataFrame, confidence: float = 0.95) -> DataFrame:
    """Median of all pairwise slopes with its interval and intercept.

    Slopes are never listed: candidate slopes are bracketed by counting how many lie below
    them. Short series count by a broadcast of the points and end exactly; longer ones count
    by concordance of the detrended values and end at relative precision 1e-12.
    """
    series = settle(series.select("i", "v"))
    n = series.count()
    if n < 5:
        return series.sparkSession.createDataFrame([], "n long, slope double, intercept double, ci_low double, ci_high double")
    points = series.orderBy("i").toPandas().to_numpy(dtype=float) if n <= SMALL else None
    total = n * (n - 1) // 2
    k = F.col("k").cast("double")
    ties = series.groupBy("v").agg(F.count(F.lit(1)).alias("k")).agg(F.sum(k * (k - 1) * (2 * k + 5))).first()[0]
    sigma = math.sqrt((n * (n - 1) * (2 * n + 5) - ties) / 18)
    from statistics import NormalDist
    z = NormalDist().inv_cdf((1 - confidence) / 2)
    ranks = {"a": (total - 1) // 2, "b": total // 2, "lo": max(int(round((total + z * sigma) / 2)) - 1, 0), "hi": min(int(round((total - z * sigma) / 2)), total - 1)}
    ends = series.agg(F.min("v"), F.max("v")).first()
    reach = max(ends[1] - ends[0], 1e-300) * 1.000001
    tries = sorted([s * reach * 2.0 ** -e for e in range(40) for s in (-1, 1)] + [0.0])
    spans = {name: (-reach, reach, 0, total) for name in ranks}   # low, high, slopes <= low, slopes <= high
    found: dict[str, float] = {}
    for _ in range(40):
        counts = _count_slopes(series, tries, points)
        for name, rank in ranks.items():
            low, high, nl, nh = spans[name]
            for c, m in zip(tries, counts):
                if m <= rank and c > low:
                    low, nl = c, m
                if m > rank and c < high:
                    high, nh = c, m
            spans[name] = (low, high, nl, nh)
        for name, (low, high, nl, nh) in spans.items():
            if name in found:
                continue
            if points is not None and nh - nl <= 200_000:
                near = [x for x, sp in spans.items() if x not in found and sp == spans[name]]
                slopes = _slopes_between(series, points, low, high)
                found.update({x: float(slopes[ranks[x] - nl]) for x in near})
            elif high - low <= 1e-12 * max(abs(low), abs(high)):
                found[name] = (low + high) / 2
            elif high - low <= 1e-15 * reach:  # ties at a slope of exactly zero never close in relative terms
                found[name] = 0.0
        if len(found) == len(ranks):
            break
        tries = sorted({low + (high - low) * j / 33 for name, (low, high, _, _) in spans.items() if name not in found for j in range(1, 33)})
    slope = (found["a"] + found["b"]) / 2
    mid = exact_quantiles(series, ["v", "i"], [0.5])
    return series.sparkSession.createDataFrame([(n, slope, mid["v"][0] - slope * mid["i"][0], found["lo"], found["hi"])],
                                               "n long, slope double, intercept double, ci_low double, ci_high double")


def detrended(series: DataFrame, fit: DataFrame) -> DataFrame:
    """The series with ``e`` = v minus the trend line."""
    row = fit.first()
    slope, start = (row["slope"], row["intercept"]) if row else (0.0, 0.0)
    return series.withColumn("e", F.col("v") - (F.lit(slope) * F.col("i") + F.lit(start)))


# ------------------------------------------------------------------ autocorrelation and seasons

def autocorrelation(series: DataFrame, column: str, lags: int = 60) -> DataFrame:
    """(lag, acf), lag 0 included, from one pass over overlapping blocks."""
    head = series.agg(F.avg(column), F.count(column)).first()
    lags = min(lags, head[1] // 2)
    base = series.select("i", (F.col(column) - F.lit(head[0])).alias("e"), F.lit(0).alias("one"))
    wide = with_lags(base, ["one"], {f"l{k}": ("e", k) for k in range(1, lags + 1)}, "i")
    row = wide.agg(F.sum(F.col("e") * F.col("e")).alias("s0"), *[F.sum(F.col("e") * F.col(f"l{k}")).alias(f"s{k}") for k in range(1, lags + 1)])
    return row.select(F.inline(F.array(*[F.struct(F.lit(k).cast("long").alias("lag"), (F.col(f"s{k}") / F.col("s0")).alias("acf")) for k in range(lags + 1)])))


def partial_autocorrelation(acf: DataFrame, lags: int = 20) -> DataFrame:
    """(lag, pacf) by the Durbin-Levinson recursion over the short table of autocorrelations."""
    r = [row["acf"] for row in acf.orderBy("lag").collect()]
    lags = min(lags, len(r) - 1)
    out, phi = [(0, 1.0)], []
    spread = 1.0
    for k in range(1, lags + 1):
        top = r[k] - sum(p * r[k - 1 - j] for j, p in enumerate(phi))
        last = top / spread
        phi = [p - last * q for p, q in zip(phi, reversed(phi))] + [last]
        spread *= 1 - last * last
        out.append((k, last))
    return acf.sparkSession.createDataFrame(out, "lag long, pacf double")


def seasonal_period(acf: DataFrame) -> DataFrame:
    """(period, acf): the largest local peak above 0.15 from lag 3; no row means no season."""
    w = Window.partitionBy(F.lit(0)).orderBy("lag")  # at most 61 rows
    seen = acf.select("lag", "acf", F.lag("acf").over(w).alias("p"), F.lead("acf").over(w).alias("f"))
    peaks = seen.filter("lag >= 3 AND f IS NOT NULL AND acf > p AND acf >= f AND acf > 0.15")
    return peaks.orderBy(F.col("acf").desc(), "lag").limit(1).select(F.col("lag").alias("period"), "acf")


def decompose(series: DataFrame, period: int) -> DataFrame:
    """(i, v, trend, seasonal, resid): centred moving average, mean by phase, remainder."""
    odd = period % 2 == 1
    width, half = (period, period // 2) if odd else (period + 1, period // 2)
    base = series.select("i", "v", F.lit(0).alias("one"))
    block = max(BLOCK, 2 * width)
    here = F.floor(F.col("i") / block)
    spread = base.withColumn("block", F.explode(F.when(F.col("i") % block >= block - width, F.array(here, here + 1)).otherwise(F.array(here))))
    w = Window.partitionBy("one", "block").orderBy("i")
    run = F.sum("v").over(w.rowsBetween(-(width - 1), 0))
    first = F.lag("v", width - 1).over(w)
    trend = run / period if odd else (run - 0.5 * (F.col("v") + first)) / period
    centred = (spread.select("i", "block", F.lag("v", half).over(w).alias("cv"), F.lag("i", half).over(w).alias("ci"),
                             F.when(first.isNotNull(), trend).alias("trend"))
               .filter(F.col("block") == here).filter("trend IS NOT NULL").select(F.col("ci").alias("i"), F.col("cv").alias("v"), "trend"))
    phase = F.pmod(F.col("i"), F.lit(period)).cast("int")
    means = centred.groupBy(phase.alias("phase")).agg(F.avg(F.col("v") - F.col("trend")).alias("m"))
    level = means.agg(F.avg("m").alias("centre"))
    season = means.join(F.broadcast(level), F.lit(True)).select("phase", (F.col("m") - F.col("centre")).alias("seasonal"))
    return (centred.withColumn("phase", phase).join(F.broadcast(season), "phase")
            .select("i", "v", "trend", "seasonal", (F.col("v") - F.col("trend") - F.col("seasonal")).alias("resid")))


def season_strength(parts: DataFrame, period: int) -> DataFrame:
    r, s, t = F.col("resid"), F.col("seasonal"), F.col("trend")
    row = parts.agg(F.var_pop(r).alias("r"), F.var_pop(s + r).alias("sr"), F.var_pop(t + r).alias("tr"))
    strength = lambda c: F.when(F.col(c) > 0, F.greatest(F.lit(0.0), 1 - F.col("r") / F.col(c)))
    return row.select(F.lit(period).cast("long").alias("period"), strength("sr").alias("seasonal_strength"), strength("tr").alias("trend_strength"))


# ------------------------------------------------------------------ stationarity

# Published response-surface coefficients for the unit-root p-value (constant, one series)
# and critical values of the level-stationarity test.
ADF_SMALL = (2.1659, 1.4412, 0.038269)
ADF_LARGE = (1.7339, 0.93202, -0.12745, -0.010368)
ADF_STAR, ADF_MIN, ADF_MAX = -1.61, -18.83, 2.74
KPSS_CRITICAL = ((0.347, 0.10), (0.463, 0.05), (0.574, 0.025), (0.739, 0.01))


def adf_p(tau: float) -> float:
    if tau > ADF_MAX:
        return 1.0
    if tau < ADF_MIN:
        return 0.0
    coef = ADF_SMALL if tau <= ADF_STAR else ADF_LARGE
    return normal_sf(-sum(c * tau ** k for k, c in enumerate(coef)))


def kpss_p(stat: float) -> float:
    return float(np.interp(stat, [c for c, _ in KPSS_CRITICAL], [p for _, p in KPSS_CRITICAL]))


def augmented_dickey_fuller(series: DataFrame) -> tuple[float, float, int]:
    """(statistic, p, lag): lags by Akaike's criterion; every fit reads one cross-product matrix."""
    n = series.count()
    most = min(int(math.ceil(12 * (n / 100) ** 0.25)), n // 2 - 3)
    base = with_lags(series.select("i", "v", F.lit(0).alias("one")), ["one"], {"y": ("v", 1)}, "i").withColumn("d", F.col("v") - F.col("y"))
    wide = settle(with_lags(base, ["one"], {f"d{k}": ("d", k) for k in range(1, most + 1)}, "i"))

    def solve(g, lags):
        names = ["y", *[f"d{k}" for k in range(1, lags + 1)]]
        r2, coef, _ = g.fit("d", names)
        rest = (1 - r2) * g.n * g.std[g.names.index("d")] ** 2
        return rest, coef, names

    trimmed = gram(wide, ["d", "y", *[f"d{k}" for k in range(1, most + 1)]])
    score = lambda lags: trimmed.n * math.log(solve(trimmed, lags)[0] / trimmed.n) + 2 * (lags + 2)
    best = min(range(most + 1), key=score)
    g = gram(wide, ["d", "y", *[f"d{k}" for k in range(1, best + 1)]])
    rest, coef, names = solve(g, best)
    inverse = np.linalg.pinv(g.take(names))
    i = g.names.index("y")
    error = math.sqrt(rest / (g.n - len(names) - 1) * inverse[0, 0] / (g.n * g.std[i] ** 2))
    tau = coef["y"] / error
    return tau, adf_p(tau), best


def kpss(series: DataFrame) -> tuple[float, float, int]:
    """(statistic, p, lags): level stationarity with data-driven lags."""
    n = series.count()
    acf = {r["lag"]: r["acf"] for r in autocorrelation(series, "v", max(60, int(4 * n ** (1 / 3)))).collect()}
    s2 = series.agg(F.var_pop("v")).first()[0] * n
    s0, s1 = s2 / n, 0.0
    for k in range(1, int(n ** (2 / 9)) + 1):
        r = acf[k] * s2 / (n / 2)
        s0, s1 = s0 + r, s1 + k * r
    lags = min(int(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3)), n - 1, max(acf))
    long_run = (s2 + 2 * sum(acf[k] * s2 * (1 - k / (lags + 1)) for k in range(1, lags + 1))) / n
    total = cumulative(series.withColumn("e", F.col("v") - F.lit(series.agg(F.avg("v")).first()[0])), {"c": F.col("e")})
    eta = total.agg(F.sum(F.col("c") * F.col("c"))).first()[0] / (n * n)
    return eta / long_run, kpss_p(eta / long_run), lags


def stationarity(series: DataFrame) -> DataFrame:
    """Both tests, which answer opposite questions, and how to read them together."""
    series = settle(series)
    tau, p, used = augmented_dickey_fuller(series)
    eta, q, lags = kpss(series)
    row = series.sparkSession.createDataFrame([(tau, p, used, eta, q, lags)], "adf double, adf_p double, adf_lags long, kpss double, kpss_p double, kpss_lags long")
    steady, moving = F.col("adf_p") < 0.05, F.col("kpss_p") < 0.05
    return row.withColumn("reading", F.when(steady & ~moving, "stationary").when(~steady & moving, "non-stationary")
                          .when(steady & moving, "conflicting: difference-stationary around a trend").otherwise("conflicting: neither is decisive"))


def cumulative(series: DataFrame, sums: dict[str, Column], block: int = BLOCK) -> DataFrame:
    """Add running totals along i: inside blocks, plus the sum of the blocks before."""
    base = series.withColumn("_b", F.floor(F.col("i") / block)).withColumns({f"_{k}": e for k, e in sums.items()})
    per = base.groupBy("_b").agg(*[F.sum(f"_{k}").alias(f"t_{k}") for k in sums])
    upto = Window.partitionBy(F.lit(0)).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # one row per block
    starts = per.select("_b", *[F.coalesce(F.sum(f"t_{k}").over(upto), F.lit(0.0)).alias(f"t_{k}") for k in sums])
    inside = Window.partitionBy("_b").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    return (base.join(F.broadcast(starts), "_b").withColumns({k: F.col(f"t_{k}") + F.sum(f"_{k}").over(inside) for k in sums})
            .drop("_b", *[f"_{k}" for k in sums], *[f"t_{k}" for k in sums]))


# ------------------------------------------------------------------ change points

def change_points(series: DataFrame, column: str = "e", most: int = 4, least: int = 10) -> DataFrame:
    """(i, mean_before, mean_after, shift, gain): mean shifts by binary segmentation.

    Running totals of values and squares give the cost of every cut in one scan per round; a
    cut must gain more than ln(n) times the variance.
    """
    head = series.agg(F.count(column), F.var_pop(column), F.avg(column)).first()
    n, spread, centre = head[0], head[1], head[2]
    schema = "i long, mean_before double, mean_after double, shift double, gain double"
    if n < 4 * least:
        return series.sparkSession.createDataFrame([], schema)
    e = F.col(column) - F.lit(centre)
    run = settle(cumulative(series.select("i", column), {"c1": e, "c2": e * e}).select("i", "c1", "c2"))
    at = {-1: (0.0, 0.0)}
    ends = run.filter(F.col("i") == n - 1).first()
    at[n - 1] = (ends["c1"], ends["c2"])
    cost = lambda a, b: (at[b - 1][1] - at[a - 1][1]) - (at[b - 1][0] - at[a - 1][0]) ** 2 / (b - a)
    open_spans, cuts = [(0, n)], []
    for _ in range(most):
        spans = [(a, b) for a, b in open_spans if b - a > 2 * least]
        if not spans:
            break
        best = None
        for a, b in spans:
            left, right = F.col("i") + 1 - a, b - F.col("i") - 1
            c1, c2 = at[a - 1]
            d1, d2 = at[b - 1]
            before = (F.col("c2") - c2) - (F.col("c1") - c1) ** 2 / left
            after = (d2 - F.col("c2")) - (d1 - F.col("c1")) ** 2 / right
            gain = (cost(a, b) - before - after).alias("gain")
            row = (run.filter((F.col("i") + 1 >= a + least) & (F.col("i") + 1 < b - least)).select("i", "c1", "c2", gain)
                   .agg(F.max(F.struct("gain", -F.col("i"), "i", "c1", "c2")).alias("w")).first()["w"])
            if row and (best is None or row["gain"] > best[0]):
                best = (row["gain"], row["i"] + 1, a, b, row["c1"], row["c2"])
        if best is None or best[0] <= math.log(n) * spread:
            break
        gain, cut, a, b, c1, c2 = best
        at[cut - 1] = (c1, c2)
        mean = lambda lo, hi: centre + (at[hi - 1][0] - at[lo - 1][0]) / (hi - lo)
        cuts.append((cut, mean(a, cut), mean(cut, b), mean(cut, b) - mean(a, cut), gain))
        open_spans = [s for s in open_spans if s != (a, b)] + [(a, cut), (cut, b)]
    return series.sparkSession.createDataFrame(sorted(cuts), schema)


def thinned(series: DataFrame, most: int = 400) -> DataFrame:
    """Every step-th point, about ``most`` of them."""
    step = max(1, series.count() // most)
    return series.filter(F.col("i") % step == 0)
