"""Time-series queries: daily order values and hourly events."""

from __future__ import annotations

from pyspark.sql import functions as F

from specula.catalog import query
from specula.operators import series, stl
from specula.plans.longform import rnd

r = lambda c, d=6: rnd(F.col(c), d).alias(c)

GAPS = """WITH d AS (SELECT DISTINCT date_trunc('minute', ts) AS t FROM events), g AS (SELECT (epoch_us(t) - epoch_us(lag(t) OVER (ORDER BY t))) / 1e6 AS s FROM d), k AS (SELECT s, count(*) AS n FROM g WHERE s IS NOT NULL GROUP BY 1), m AS (SELECT arg_max(s, (n, -s)) AS modal FROM k)"""


@query("regularity", GAPS + """ SELECT max(modal) AS modal_seconds, CAST(sum(n) AS BIGINT) AS steps, CAST(sum(CASE WHEN s > 1.5 * modal THEN n ELSE 0 END) AS BIGINT) AS gaps, max(s) AS largest_seconds,
 round(sum(CASE WHEN s > 1.5 * modal THEN n ELSE 0 END) / sum(n), 6) + 0.0 AS gap_share FROM k, m""")
def regularity(t):
    return series.regularity(t.events.select(F.date_trunc("minute", "ts").alias("minute")), "minute").select("modal_seconds", "steps", "gaps", "largest_seconds", r("gap_share"))


WAVE = "(SELECT *, value / 1000 + sin(epoch_us(ts) / 1e6 / 20000) AS wave FROM events)"


def wave(t):
    return t.events.withColumn("wave", F.col("value") / 1000 + F.sin(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 / 20000))


@query("series_choice", f"""WITH l AS (SELECT 'value' AS "column", value AS v, lag(value) OVER (ORDER BY ts, event_id) AS p FROM events UNION ALL SELECT 'wave', wave, lag(wave) OVER (ORDER BY ts, event_id) FROM {WAVE}),
c AS (SELECT "column", count(*) AS n, corr(v, p) AS lag1 FROM l GROUP BY 1) SELECT "column", n, round(lag1, 6) + 0.0 AS lag1, row_number() OVER (ORDER BY abs(lag1) DESC) = 1 AS chosen FROM c""")
def series_choice(t):
    return series.choose_series(wave(t), "ts", ["user_id", "value", "wave"], "event_id").select("column", "n", r("lag1"), "chosen")


DAILY = """(WITH k AS (SELECT (epoch_us(o_orderdate) - epoch_us((SELECT min(o_orderdate) FROM orders))) // 86400000000 AS i, avg(o_totalprice + epoch_us(o_orderdate) / 4e9) AS v FROM orders GROUP BY 1),
 s AS (SELECT i, v, lag(i) OVER (ORDER BY i) AS pi, lag(v) OVER (ORDER BY i) AS pv FROM k), j AS (SELECT *, unnest(range(coalesce(pi + 1, i), i + 1)) AS j FROM s)
 SELECT j AS i, CASE WHEN j = i THEN v ELSE pv + (v - pv) * (j - pi) / (i - pi) END AS v FROM j)"""


def daily(t):
    df = t.orders.withColumn("worth", F.col("o_totalprice") + F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 4e9)
    return series.resample(df, "o_orderdate", "worth", 86400.0)


@query("resample", f"SELECT i, round(v, 6) + 0.0 AS v FROM {DAILY}")
def resample(t):
    return daily(t).select("i", r("v"))


HOURLY = """(WITH k AS (SELECT (epoch_us(ts) - epoch_us(date_trunc('day', (SELECT min(ts) FROM events)))) // 3600000000 AS k, avg(value) AS v FROM events GROUP BY 1),
 s AS (SELECT k - (SELECT min(k) FROM k) AS i, v FROM k), p AS (SELECT i, v, lag(i) OVER (ORDER BY i) AS pi, lag(v) OVER (ORDER BY i) AS pv FROM s), j AS (SELECT *, unnest(range(coalesce(pi + 1, i), i + 1)) AS j FROM p)
 SELECT j AS i, CASE WHEN j = i THEN v ELSE pv + (v - pv) * (j - pi) / (i - pi) END + 40 * sin(2 * pi() * j / 24) AS v FROM j)"""


def hourly(t):
    """Hourly means of events with a planted daily season."""
    return series.resample(t.events, "ts", "value", 3600.0).withColumn("v", F.col("v") + 40 * F.sin(2 * 3.141592653589793 * F.col("i") / 24))


@query("resample_hourly", f"SELECT i, round(v, 6) + 0.0 AS v FROM {HOURLY}")
def resample_hourly(t):
    return hourly(t).select("i", r("v"))


TREND = f"""d AS (SELECT * FROM {DAILY}), s AS (SELECT quantile_cont((b.v - a.v) / (b.i - a.i), 0.5) AS slope FROM d a JOIN d b ON a.i < b.i), f AS (SELECT slope, (SELECT median(v) FROM d) - slope * (SELECT median(i) FROM d) AS start FROM s)"""


@query("theil_sen", f"WITH {TREND} SELECT (SELECT count(*) FROM d) AS n, round(slope, 6) + 0.0 AS slope, round(start, 3) + 0.0 AS intercept FROM f")
def theil_sen(t):
    return series.theil_sen(daily(t)).select("n", r("slope"), r("intercept", 3))


@query("mann_kendall", f"""WITH d AS (SELECT * FROM {DAILY}), s AS (SELECT CAST(sum(sign(b.v - a.v)) AS DOUBLE) AS s FROM d a JOIN d b ON a.i < b.i), n AS (SELECT count(*) AS n FROM d), t AS (SELECT sum(k * (k - 1) * (2 * k + 5)) AS t FROM (SELECT count(*) AS k FROM d GROUP BY v))
SELECT n, s, round((s - sign(s)) / sqrt((n * (n - 1.0) * (2 * n + 5) - t) / 18), 6) + 0.0 AS z FROM s, n, t""")
def mann_kendall(t):
    return series.mann_kendall(daily(t)).select("n", "s", r("z"))


ACF = f"""h AS (SELECT i, v - (SELECT avg(v) FROM {HOURLY}) AS e FROM {HOURLY}), a AS (SELECT l AS lag, sum(x.e * y.e) / (SELECT sum(e * e) FROM h) AS acf FROM range(61) g(l), h x JOIN h y ON x.i = y.i + l GROUP BY 1)"""


@query("autocorrelation", f"WITH {ACF} SELECT lag, round(acf, 6) + 0.0 AS acf FROM a")
def autocorrelation(t):
    return series.autocorrelation(hourly(t), "v").select("lag", r("acf"))


@query("seasonal_period", f"WITH {ACF}, w AS (SELECT lag, acf, lag(acf) OVER (ORDER BY lag) AS p, lead(acf) OVER (ORDER BY lag) AS f FROM a) SELECT lag AS period, round(acf, 6) AS acf FROM w WHERE lag >= 3 AND f IS NOT NULL AND acf > p AND acf >= f AND acf > 0.15 ORDER BY w.acf DESC, lag LIMIT 1")
def seasonal_period(t):
    return series.seasonal_period(series.autocorrelation(hourly(t), "v")).select("period", r("acf"))


PARTS = f"""h AS (SELECT * FROM {HOURLY}), m AS (SELECT i, v, (sum(v) OVER w - 0.5 * (first_value(v) OVER w + last_value(v) OVER w)) / 24 AS trend, count(*) OVER w AS k FROM h WINDOW w AS (ORDER BY i ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING)),
c AS (SELECT i, v, trend FROM m WHERE k = 25), p AS (SELECT i % 24 AS ph, avg(v - trend) AS m FROM c GROUP BY 1), x AS (SELECT i, v, trend, m - (SELECT avg(m) FROM p) AS seasonal, v - trend - (m - (SELECT avg(m) FROM p)) AS resid FROM c JOIN p ON i % 24 = ph)"""


@query("decomposition", f"WITH {PARTS} SELECT i, round(trend, 6) + 0.0 AS trend, round(seasonal, 6) + 0.0 AS seasonal, round(resid, 6) + 0.0 AS resid FROM x")
def decomposition(t):
    return series.decompose(hourly(t), 24).select("i", r("trend"), r("seasonal"), r("resid"))


@query("season_strength", f"WITH {PARTS} SELECT CAST(24 AS BIGINT) AS period, round(greatest(0.0, 1 - var_pop(resid) / var_pop(seasonal + resid)), 6) + 0.0 AS seasonal_strength, round(greatest(0.0, 1 - var_pop(resid) / var_pop(trend + resid)), 6) + 0.0 AS trend_strength FROM x")
def season_strength(t):
    return series.season_strength(series.decompose(hourly(t), 24), 24).select("period", r("seasonal_strength"), r("trend_strength"))


# one round of local regression with the widths of a period of 24: cycle 7, level 25, trend 47
def _lines(points: str, places: str, q: int) -> str:
    """Locally weighted lines: points (g, k, n, v) and places (g, x, n) to (g, x, v)."""
    return f"""(SELECT g, x, CASE WHEN sqrt(greatest(c, 0)) > 0.001 * (n - 1) THEN my - a * (wkv - a * my) / c ELSE my END AS v FROM (
 SELECT g, x, any_value(n) AS n, sum(w * k) / sum(w) AS a, sum(w * k * k) / sum(w) - (sum(w * k) / sum(w)) * (sum(w * k) / sum(w)) AS c, sum(w * v) / sum(w) AS my, sum(w * k * v) / sum(w) AS wkv FROM (
  SELECT p.g, p.x, t.n, t.k - p.x AS k, t.v, CASE WHEN abs(t.k - p.x) <= 0.001 * h THEN 1.0 WHEN abs(t.k - p.x) <= 0.999 * h THEN pow(1 - pow(abs(t.k - p.x) / h, 3), 3) ELSE 0.0 END AS w
  FROM (SELECT g, x, lo, least(lo + {q}, n) - 1 AS hi, greatest(x - lo, least(lo + {q}, n) - 1 - x) + greatest({q} - n, 0) // 2 AS h
        FROM (SELECT g, x, n, greatest(least(x + 1 - {(q + 1) // 2}, n - {q}), 0) AS lo FROM {places})) p JOIN {points} t ON t.g = p.g AND t.k BETWEEN p.lo AND p.hi) GROUP BY g, x))"""


def _run(table: str, n: int) -> str:
    return f"(SELECT k, v FROM (SELECT k, avg(v) OVER w AS v, count(*) OVER w AS m FROM {table} WINDOW w AS (ORDER BY k ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING)) WHERE m = {n})"


ONE_PASS = f"""h AS (SELECT CAST(i AS BIGINT) AS i, v FROM {HOURLY}), t AS (SELECT i % 24 AS g, i // 24 AS k, count(*) OVER (PARTITION BY i % 24) AS n, v FROM h),
tx AS (SELECT g, n, unnest(range(-1, n + 1)) AS x FROM (SELECT DISTINCT g, n FROM t)), cycle AS (SELECT (x + 1) * 24 + g AS k, v FROM {_lines('t', 'tx', 7)}),
m1 AS {_run('cycle', 24)}, m2 AS {_run('m1', 24)}, m3 AS (SELECT 0 AS g, k, count(*) OVER () AS n, v FROM {_run('m2', 3)}), mx AS (SELECT g, k AS x, n FROM m3),
level AS (SELECT x AS i, v FROM {_lines('m3', 'mx', 25)}), season AS (SELECT h.i, h.v, c.v - l.v AS seasonal FROM h JOIN level l USING (i) JOIN cycle c ON c.k = h.i + 24),
d AS (SELECT 0 AS g, i AS k, count(*) OVER () AS n, v - seasonal AS v FROM season), dx AS (SELECT g, k AS x, n FROM d), trend AS (SELECT x AS i, v AS trend FROM {_lines('d', 'dx', 47)})"""


@query("seasonal_trend_pass", f"WITH {ONE_PASS} SELECT i, round(trend, 5) + 0.0 AS trend, round(seasonal, 5) + 0.0 AS seasonal FROM season JOIN trend USING (i)")
def seasonal_trend_pass(t):
    found = stl.robust_decompose(hourly(t), 24, inner=1, outer=0)
    return found.select("i", rnd(F.col("trend"), 5).alias("trend"), rnd(F.col("seasonal"), 5).alias("seasonal"))


@query("robust_decomposition")
def robust_decomposition(t):
    return stl.robust_decompose(hourly(t), 24)


@query("partial_autocorrelation", f"""WITH {ACF}, v AS (SELECT max(CASE WHEN lag = 1 THEN acf END) AS a, max(CASE WHEN lag = 2 THEN acf END) AS b, max(CASE WHEN lag = 3 THEN acf END) AS c FROM a)
SELECT CAST(unnest([0, 1, 2, 3]) AS BIGINT) AS lag, round(unnest([1.0, a, (b - a * a) / (1 - a * a), (c - 2 * a * b + a * a * a - a * a * c + a * b * b) / (1 - 2 * a * a + 2 * a * a * b - b * b)]), 6) + 0.0 AS pacf FROM v""")
def partial_autocorrelation(t):
    return series.partial_autocorrelation(series.autocorrelation(hourly(t), "v"), 3).select("lag", r("pacf"))


@query("stationarity")
def stationarity(t):
    return series.stationarity(daily(t)).select(r("adf"), r("adf_p"), "adf_lags", r("kpss"), r("kpss_p"), "kpss_lags", "reading")


STEP = f"(SELECT i, v + CASE WHEN i >= 900 THEN 300000 ELSE 0 END AS e FROM {DAILY})"


@query("change_points", f"""WITH s AS (SELECT * FROM {STEP}), c AS (SELECT i, sum(e) OVER w AS a, sum(e * e) OVER w AS b, (SELECT sum(e) FROM s) AS ta, (SELECT sum(e * e) FROM s) AS tb, (SELECT count(*) FROM s) AS n FROM s WINDOW w AS (ORDER BY i)),
g AS (SELECT i + 1 AS i, (tb - ta * ta / n) - (b - a * a / (i + 1)) - ((tb - b) - (ta - a) * (ta - a) / (n - i - 1)) AS gain, a / (i + 1) AS mb, (ta - a) / (n - i - 1) AS ma FROM c WHERE i + 1 >= 10 AND i + 1 < n - 10)
SELECT i, round(mb, 1) AS mean_before, round(ma, 1) AS mean_after, round(ma - mb, 1) AS shift FROM g ORDER BY gain DESC LIMIT 1""")
def change_points(t):
    s = daily(t).select("i", (F.col("v") + F.when(F.col("i") >= 900, 300000).otherwise(0)).alias("e"))
    return series.change_points(s, "e", most=1).select("i", r("mean_before", 1), r("mean_after", 1), r("shift", 1))


@query("change_points_detrended")
def change_points_detrended(t):
    """Two planted shifts on top of a slow trend."""
    step = F.when(F.col("i") >= 900, 300000).otherwise(0) + F.when(F.col("i") >= 1500, -450000).otherwise(0)
    s = daily(t).withColumn("v", F.col("v") + step)
    return series.change_points(series.detrended(s, series.theil_sen(s))).select("i", r("mean_before", 1), r("mean_after", 1), r("shift", 1))


@query("thinned_series", f"SELECT i, round(v, 6) + 0.0 AS v FROM {DAILY} WHERE i % greatest(1, (SELECT count(*) FROM {DAILY}) // 400) = 0")
def thinned_series(t):
    return series.thinned(daily(t)).select("i", r("v"))
