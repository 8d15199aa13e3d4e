"""Sources, typing, statistics, quality and distribution queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from specula.catalog import query
from specula.operators import explore, profile, quality, typing
from specula.plans.longform import rnd
from specula.sources import files, sampling, triples

LINE = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        "l_returnflag", "l_linestatus", "l_shipdate"]
LINE_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINE_NOM = ["l_returnflag", "l_linestatus", "l_linenumber"]


def union_sql(parts):
    return "\nUNION ALL\n".join(parts)


def long_sql(table, columns, cast="DOUBLE"):
    return union_sql([f"SELECT '{c}' AS \"column\", CAST({c} AS {cast}) AS value FROM {table}" for c in columns])


def counts_sql(table, columns):
    return (f"SELECT \"column\", value, count(*) AS n FROM ({long_sql(table, columns, 'VARCHAR')}) WHERE value IS NOT NULL "
            "GROUP BY ALL")


# ----------------------------------------------------------------- typing

# gaps planted the same way on both sides
GAPPY = ("(SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice, "
         "CASE WHEN o_custkey % 11 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority, o_orderstatus, "
         "o_orderkey % 2 AS odd, o_orderdate, o_custkey, 1 AS one FROM orders)")


def gappy(t):
    return t.orders.select(
        "o_orderkey", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("o_totalprice"),
        F.when(F.col("o_custkey") % 11 != 0, F.col("o_orderpriority")).alias("o_orderpriority"), "o_orderstatus",
        (F.col("o_orderkey") % 2).alias("odd"), "o_orderdate", "o_custkey", F.lit(1).alias("one"))


GAPPY_COLS = {"o_orderkey": "numeric", "o_totalprice": "numeric", "o_orderpriority": "string", "o_orderstatus": "string",
              "odd": "numeric", "o_orderdate": "datetime", "o_custkey": "numeric", "one": "numeric"}


def census_sql(table, kinds):
    parts = []
    for c, kind in kinds.items():
        text = f"CAST({c} AS VARCHAR)"
        whole = f"coalesce(bool_and({c} = round({c})), false)" if kind == "numeric" else "false"
        parts.append(f"""SELECT '{c}' AS "column", '{kind}' AS kind, count(*) AS rows, count(*) - count({c}) AS missing,
            count(DISTINCT {c}) AS nunique, avg(length({text})) AS avg_len,
            avg(CASE WHEN regexp_matches({text}, '\\s') THEN 1.0 ELSE 0.0 END) AS spaced,
            avg(CASE WHEN try_cast({text} AS TIMESTAMP) IS NOT NULL THEN 1.0 ELSE 0.0 END) AS dates,
            bool_and(lower({text}) IN ('0','1','true','false')) AS flags, {whole} AS whole,
            count(DISTINCT {c}) / greatest(count({c}), 1) AS ratio FROM {table}""")
    return union_sql(parts)


TYPING_SQL = f"""WITH c AS ({census_sql(GAPPY, GAPPY_COLS)})
SELECT "column", rows, missing, round(100.0 * missing / rows, 2) + 0.0 AS missing_pct, nunique,
  CASE WHEN nunique <= 1 THEN 'constant' WHEN nunique = 2 AND flags THEN 'boolean' WHEN kind = 'datetime' THEN 'datetime'
       WHEN kind = 'numeric' THEN CASE WHEN whole AND ratio > 0.98 AND rows > 20 THEN 'id'
                                       WHEN whole AND nunique <= 20 THEN 'ordinal' ELSE 'numeric' END
       WHEN dates > 0.9 AND nunique > 2 THEN 'datetime' WHEN ratio > 0.98 AND rows > 20 AND avg_len < 40 THEN 'id'
       WHEN avg_len > 30 OR (ratio > 0.5 AND spaced > 0.5) THEN 'text' ELSE 'nominal' END AS semantic_type,
  CASE WHEN regexp_matches("column", '(^|_)(id|key|uuid|code)$') THEN 'identifier-like'
       WHEN regexp_matches("column", '(zip|postal|cap|plz)') THEN 'postal-like' END AS name_hint,
  CASE WHEN nunique = rows THEN 'identity' WHEN nunique <= 1 THEN 'constant' ELSE 'dimension' END AS role,
  CASE WHEN kind <> 'string' THEN kind WHEN nunique <= greatest(20, 0.02 * rows) THEN 'nominal' ELSE 'text' END AS light_type
FROM c"""


@query("semantic_types", TYPING_SQL)
def semantic_types(t):
    return typing.semantic_types(gappy(t)).select(
        "column", "rows", "missing", rnd(F.col("missing_pct"), 2).alias("missing_pct"), "nunique", "semantic_type",
        "name_hint", "role", "light_type")


DOC_KINDS = {"doc_id": "numeric", "text": "string", "lang": "string", "source": "string", "n_chars": "numeric"}


@query("semantic_types_documents", TYPING_SQL.replace(GAPPY, "documents").replace(
    census_sql(GAPPY, GAPPY_COLS).replace(GAPPY, "documents"), census_sql("documents", DOC_KINDS)))
def semantic_types_documents(t):
    return typing.semantic_types(t.documents).select(
        "column", "rows", "missing", rnd(F.col("missing_pct"), 2).alias("missing_pct"), "nunique", "semantic_type",
        "name_hint", "role", "light_type")


@query("top_values", f"""SELECT "column", rank, value, n FROM (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS rank
FROM ({counts_sql('orders', ['o_orderstatus', 'o_orderpriority', 'o_custkey'])})) WHERE rank <= 8""")
def top_values(t):
    return typing.top_values(t.orders, ["o_orderstatus", "o_orderpriority", "o_custkey"]).select(
        "column", F.col("rank").cast("long").alias("rank"), "value", "n")


@query("numeric_projection", """SELECT count(*) AS n, round(sum(q), 2) AS q, round(sum(s), 2) AS s, CAST(sum(f) AS DOUBLE) AS f, count(s) AS known FROM (
SELECT CAST(l_quantity AS DOUBLE) AS q, try_cast(CASE WHEN l_linenumber = 3 THEN 'n/a' ELSE CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) END AS DOUBLE) AS s,
CASE WHEN l_linestatus = 'O' THEN 1.0 ELSE 0.0 END AS f FROM lineitem)""")
def numeric_projection(t):
    raw = t.lineitem.select("l_quantity", F.when(F.col("l_linenumber") == 3, "n/a").otherwise(
        F.col("l_quantity").cast("int").cast("string")).alias("s"), (F.col("l_linestatus") == "O").alias("f"))
    x = typing.numeric_projection(raw, {"l_quantity": "numeric", "s": "numeric", "f": "boolean"})
    return x.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("q"), F.round(F.sum("s"), 2).alias("s"),
                 F.sum("f").alias("f"), F.count("s").alias("known"))


@query("constant_columns", """SELECT * FROM (SELECT "column", count(*) AS nunique, round(max(n) / sum(n), 6) + 0.0 AS dominant_share FROM (
""" + counts_sql("(SELECT l_returnflag, l_linenumber, CASE WHEN l_quantity = 1 THEN 'rare' ELSE 'usual' END AS band, 1 AS one FROM lineitem)",
                 ["l_returnflag", "l_linenumber", "band", "one"]) + """) GROUP BY "column") WHERE nunique <= 1 OR dominant_share >= 0.95""")
def constant_columns(t):
    df = t.lineitem.select("l_returnflag", "l_linenumber", F.when(F.col("l_quantity") == 1, "rare").otherwise("usual").alias("band"),
                           F.lit(1).alias("one"))
    return typing.constant_columns(df, 0.05).select("column", "nunique", rnd(F.col("dominant_share")).alias("dominant_share"))


@query("xsd_kinds", """SELECT * FROM (VALUES ('o_orderkey', 'integer'), ('o_custkey', 'integer'), ('o_orderstatus', 'string'),
('o_totalprice', 'decimal'), ('o_orderpriority', 'string')) v("column", xsd_kind)
UNION ALL SELECT 'o_orderdate', CASE WHEN typeof(any_value(o_orderdate)) LIKE 'TIMESTAMP%' THEN 'dateTime' END FROM orders
UNION ALL SELECT 'day', CASE WHEN avg(CASE WHEN regexp_matches(strftime(o_orderdate, '%Y-%m-%d'), '^\\d{4}-\\d{2}-\\d{2}$') THEN 1 ELSE 0 END) > 0.9 THEN 'date' ELSE 'string' END FROM orders""")
def xsd_kinds(t):
    return typing.xsd_kinds(t.orders.withColumn("day", F.date_format("o_orderdate", "yyyy-MM-dd")))


TIME_SQL = """WITH d AS (SELECT DISTINCT {c} AS ts FROM {t}), g AS (SELECT epoch_us(ts) - epoch_us(lag(ts) OVER (ORDER BY ts)) AS us FROM d),
f AS (SELECT us / 1e6 AS seconds, count(*) AS n FROM g WHERE us IS NOT NULL GROUP BY 1)"""


@query("time_columns", TIME_SQL.format(c="o_orderdate", t="orders") + """
SELECT name AS "column", parsed, first, last, modal_seconds, regular FROM (VALUES ('o_orderdate'), ('day')) v(name),
(SELECT count(o_orderdate) AS parsed, min(o_orderdate) AS first, max(o_orderdate) AS last FROM orders),
(SELECT arg_max(seconds, (n, -seconds)) AS modal_seconds, max(n) / sum(n) > 0.9 AS regular FROM f)""")
def time_columns(t):
    return typing.time_columns(t.orders.withColumn("day", F.date_format("o_orderdate", "yyyy-MM-dd")))


@query("time_columns_events", TIME_SQL.format(c="ts", t="events") + """
SELECT 'ts' AS "column", parsed, first, last, modal_seconds, regular FROM
(SELECT count(ts) AS parsed, min(ts) AS first, max(ts) AS last FROM events),
(SELECT arg_max(seconds, (n, -seconds)) AS modal_seconds, max(n) / sum(n) > 0.9 AS regular FROM f)""")
def time_columns_events(t):
    return typing.time_columns(t.events)


def placed(t):
    """Customers with coordinates planted from the key."""
    return t.customer.withColumn("lat", 45 + (F.col("c_custkey") % 100) / 1000.0).withColumn(
        "lon", 7 + (F.floor(F.col("c_custkey") / 7) % 100) / 1000.0)


PLACED = "(SELECT *, 45 + (c_custkey % 100) / 1000.0 AS lat, 7 + ((c_custkey // 7) % 100) / 1000.0 AS lon FROM customer)"


@query("coordinate_columns", f"""SELECT 'lat' AS "column", 'lat' AS kind, avg(CASE WHEN lat BETWEEN -90 AND 90 THEN 1.0 ELSE 0.0 END) AS share FROM {PLACED}
UNION ALL SELECT 'lon', 'lon', avg(CASE WHEN lon BETWEEN -180 AND 180 THEN 1.0 ELSE 0.0 END) FROM {PLACED}
UNION ALL SELECT 'wkt', 'wkt', avg(CASE WHEN lat IS NOT NULL THEN 1.0 ELSE 0.0 END) FROM {PLACED}""")
def coordinate_columns(t):
    df = placed(t).withColumn("wkt", F.concat(F.lit("POINT ("), "lon", F.lit(" "), "lat", F.lit(")")))
    return typing.coordinate_columns(df)


# ----------------------------------------------------------------- statistics

PROFILE_SQL = f"""WITH k AS ({counts_sql('lineitem', LINE_NUM + LINE_NOM)}), e AS (SELECT "column", sum(n) AS t, count(*) AS nunique, max(n) AS top,
 -sum(n / (SELECT count(*) FROM lineitem) * log2(n / (SELECT count(*) FROM lineitem))) AS entropy FROM k GROUP BY 1),
v AS ({long_sql('lineitem', LINE_NUM)}), m AS (SELECT "column", avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min, max(value) AS max,
 skewness(value) AS skew, kurtosis(value) AS kurtosis, count(*) FILTER (value = 0) AS zeros FROM v GROUP BY 1)
SELECT e."column", CAST(t AS BIGINT) AS rows, nunique, round(top / t, 6) AS dominant_share, round(entropy, 4) AS entropy_bits, round(mean, 4) AS mean,
 round(std, 4) AS std, min, max, round(skew, 4) + 0.0 AS skew, round(kurtosis, 4) + 0.0 AS kurtosis, zeros FROM e LEFT JOIN m ON e."column" = m."column" """


@query("table_profile", PROFILE_SQL)
def table_profile(t):
    p = profile.table_profile(t.lineitem, LINE_NUM, LINE_NOM)
    return p.select("column", "rows", "nunique", F.round("dominant_share", 6).alias("dominant_share"),
                    F.round("entropy_bits", 4).alias("entropy_bits"), F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"),
                    "min", "max", rnd(F.col("skew"), 4).alias("skew"), rnd(F.col("kurtosis"), 4).alias("kurtosis"), "zeros")


@query("numeric_stats", f"""WITH v AS ({long_sql('lineitem', LINE_NUM)}), m AS (SELECT "column", count(*) AS n, round(avg(value), 4) AS mean,
 round(stddev_samp(value), 4) AS std, min(value) AS min, max(value) AS max, round(quantile_cont(value, 0.01), 6) AS p1, round(quantile_cont(value, 0.05), 6) AS p5,
 quantile_cont(value, 0.25) AS q1, round(quantile_cont(value, 0.5), 6) AS median, quantile_cont(value, 0.75) AS q3, round(quantile_cont(value, 0.95), 6) AS p95,
 round(quantile_cont(value, 0.99), 6) AS p99, round(skewness(value), 4) + 0.0 AS skew, round(kurtosis(value), 4) + 0.0 AS kurtosis,
 round(kurtosis_pop(value), 4) + 0.0 AS kurt_pop, count(*) FILTER (value = 0) AS zeros FROM v GROUP BY 1)
SELECT m.*  EXCLUDE (q1, q3), round(q1, 6) AS q25, round(q3, 6) AS q75, o.iqr_outliers, round(zeros / n, 6) AS zero_share FROM m JOIN (
 SELECT v."column", count(*) FILTER (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS iqr_outliers FROM v JOIN m ON v."column" = m."column" GROUP BY 1) o
 ON o."column" = m."column" """)
def numeric_stats(t):
    s = profile.numeric_stats(t.lineitem, LINE_NUM)
    r = lambda c, d: rnd(F.col(c), d).alias(c)
    return s.select("column", "n", r("mean", 4), r("std", 4), "min", "max", r("p1", 6), r("p5", 6), r("q25", 6), r("median", 6), r("q75", 6),
                    r("p95", 6), r("p99", 6), r("skew", 4), r("kurtosis", 4), r("kurt_pop", 4), "zeros", "iqr_outliers", r("zero_share", 6))


@query("datetime_stats", """WITH o AS (SELECT o_orderdate AS t, lag(o_orderdate) OVER (ORDER BY o_orderkey) AS p FROM orders),
e AS (SELECT ts AS t, lag(ts) OVER (ORDER BY event_id) AS p FROM events)
SELECT 'o_orderdate' AS "column", count(*) AS n, min(t) AS first, max(t) AS last, CAST(date_diff('day', min(t), max(t)) AS BIGINT) AS span_days,
 count(*) FILTER (t < p) AS decreases, count(*) FILTER (t < p) = 0 AS monotonic FROM o
UNION ALL SELECT 'ts', count(*), min(t), max(t), CAST(floor((epoch_us(max(t)) - epoch_us(min(t))) / 86400000000) AS BIGINT), count(*) FILTER (t < p), count(*) FILTER (t < p) = 0 FROM e""")
def datetime_stats(t):
    return profile.datetime_stats(t.orders, ["o_orderdate"], "o_orderkey").union(
        profile.datetime_stats(t.events, ["ts"], "event_id"))


TOKENS = "CASE WHEN trim({c}, ' ') = '' THEN 0 ELSE len(regexp_split_to_array(trim({c}, ' '), '\\s+')) END"


@query("text_stats", "\nUNION ALL\n".join(
    f"""SELECT '{c}' AS "column", round(avg(length({c})), 1) AS avg_len, CAST(max(length({c})) AS BIGINT) AS max_len,
 round(avg({TOKENS.format(c=c)}), 1) AS avg_tokens FROM documents""" for c in ("text", "source")))
def text_stats(t):
    return profile.text_stats(t.documents, ["text", "source"]).select(
        "column", F.round("avg_len", 1).alias("avg_len"), "max_len", F.round("avg_tokens", 1).alias("avg_tokens"))


NOMINAL = ["o_orderstatus", "o_orderpriority", "o_custkey"]


@query("nominal_stats", f"""WITH k AS (SELECT *, sum(n) OVER (PARTITION BY "column") AS t FROM ({counts_sql('orders', NOMINAL)}))
SELECT "column", CAST(max(t) AS BIGINT) AS n, count(*) AS levels, round(max(n) / max(t), 6) AS top_share, round(-sum(n / t * log2(n / t)), 4) AS entropy_bits,
 round(log2(count(*)), 4) AS max_entropy_bits, round(sum(CASE WHEN n < greatest(2, 0.01 * t) THEN n ELSE 0 END) / max(t), 6) AS long_tail_share FROM k GROUP BY 1""")
def nominal_stats(t):
    return profile.nominal_stats(t.orders, NOMINAL).select(
        "column", "n", "levels", F.round("top_share", 6).alias("top_share"), F.round("entropy_bits", 4).alias("entropy_bits"),
        F.round("max_entropy_bits", 4).alias("max_entropy_bits"), F.round("long_tail_share", 6).alias("long_tail_share"))


# ----------------------------------------------------------------- quality

@query("column_census", f"""WITH k AS ({counts_sql(GAPPY, list(GAPPY_COLS))}) SELECT "column", CAST((SELECT count(*) FROM orders) - sum(n) AS BIGINT) AS missing,
 round(1 - sum(n) / (SELECT count(*) FROM orders), 6) + 0.0 AS missing_rate, count(*) AS nunique, round(count(*) / sum(n), 6) AS cardinality_ratio,
 round(max(n) / sum(n), 6) AS dominant_share FROM k GROUP BY 1""")
def column_census(t):
    return typing.census(gappy(t)).select(
        "column", "missing", rnd(F.col("missing") / F.col("rows")).alias("missing_rate"), "nunique",
        F.round("cardinality_ratio", 6).alias("cardinality_ratio"), F.round("dominant_share", 6).alias("dominant_share"))


@query("duplicates", """SELECT *, round(duplicates / rows, 6) + 0.0 AS rate FROM (
SELECT 'all' AS keys, count(*) AS rows, count(*) - count(DISTINCT (doc_id, text, lang, source, n_chars)) AS duplicates FROM documents
UNION ALL SELECT 'text', count(*), count(*) - count(DISTINCT text) FROM documents
UNION ALL SELECT 'basis', count(*), count(*) - count(DISTINCT (lang, source)) FROM documents)""")
def duplicates(t):
    d = quality.duplicates(t.documents, {"all": t.documents.columns, "text": ["text"], "basis": ["lang", "source"]})
    return d.select("keys", "rows", "duplicates", rnd(F.col("rate")).alias("rate"))


@query("near_duplicates", """SELECT a.p_partkey AS row_id FROM part a WHERE EXISTS (SELECT 1 FROM part b WHERE b.p_partkey < a.p_partkey
 AND abs(a.p_size - b.p_size) <= 1 AND abs(a.p_retailprice - b.p_retailprice) <= 1.5)""")
def near_duplicates(t):
    return quality.near_duplicates(t.part, {"p_size": 1.0, "p_retailprice": 1.5}, "p_partkey")


MISSING = GAPPY.replace("o_orderkey % 7 = 0", "o_totalprice > 350000 AND o_orderkey % 3 = 0")


def dependent_gaps(t):
    """Gaps that depend on price (kept as value) and on the status."""
    return t.orders.select(
        "o_orderkey", "o_totalprice", "o_custkey", "o_orderpriority", "o_orderstatus",
        F.when(~((F.col("o_totalprice") > 350000) & (F.col("o_orderkey") % 3 == 0)), F.col("o_orderkey") % 97).alias("score"),
        F.when(~((F.col("o_orderstatus") == "F") & (F.col("o_orderkey") % 5 == 0)), F.lit("known")).alias("note"))


DEPENDENT = """(SELECT o_orderkey, o_totalprice, o_custkey, o_orderpriority, o_orderstatus,
 CASE WHEN o_totalprice > 350000 AND o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey % 97 END AS score,
 CASE WHEN o_orderstatus = 'F' AND o_orderkey % 5 = 0 THEN NULL ELSE 'known' END AS note FROM orders)"""


def _mw_missing(c, o):
    return f"""SELECT '{c}' AS missing_in, '{o}' AS against, CAST(round(sum(CASE WHEN miss THEN r ELSE 0 END) - count(*) FILTER (miss) * (count(*) FILTER (miss) + 1) / 2, 1) AS DOUBLE) AS statistic,
 round(2 * (sum(CASE WHEN miss THEN r ELSE 0 END) - count(*) FILTER (miss) * (count(*) FILTER (miss) + 1) / 2) / (count(*) FILTER (miss) * count(*) FILTER (NOT miss)) - 1, 6) + 0.0 AS effect, count(*) AS n
 FROM (SELECT {c} IS NULL AS miss, rank() OVER (ORDER BY {o}) + (count(*) OVER (PARTITION BY {o}) - 1) / 2 AS r FROM {DEPENDENT} WHERE {o} IS NOT NULL)"""


@query("missingness_numeric", union_sql([_mw_missing(c, o) for c in ("score", "note") for o in ("o_totalprice", "o_custkey")]))
def missingness_numeric(t):
    return quality.missingness_numeric(dependent_gaps(t), ["score", "note"], ["o_totalprice", "o_custkey"]).select(
        "missing_in", "against", F.round("statistic", 1).alias("statistic"), rnd(F.col("effect")).alias("effect"), "n")


@query("missingness_dependence")
def missingness_dependence(t):
    r = quality.missingness_dependence(dependent_gaps(t), ["o_totalprice", "o_custkey", "score"], ["o_orderpriority", "o_orderstatus", "note"])
    return r.select("missing_in", "against", "test", F.round("statistic", 4).alias("statistic"), F.round("p_adj", 8).alias("p_adj"),
                    F.round("effect", 6).alias("effect"))


@query("stored_as_text", """SELECT 'qty' AS "column", 'numeric stored as text' AS issue, round(avg(CASE WHEN try_cast(CAST(l_quantity AS VARCHAR) AS DOUBLE) IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS share FROM lineitem
UNION ALL SELECT 'day', 'date stored as text', round(avg(CASE WHEN try_cast(strftime(l_shipdate, '%Y-%m-%d') AS TIMESTAMP) IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) FROM lineitem""")
def stored_as_text(t):
    df = t.lineitem.select(F.col("l_quantity").cast("string").alias("qty"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"), "l_returnflag")
    return quality.stored_as_text(df, ["qty", "day", "l_returnflag"]).select("column", "issue", F.round("share", 6).alias("share"))


@query("category_variants", """WITH v AS (SELECT CASE WHEN o_orderkey % 5 = 0 THEN lower(o_orderpriority) WHEN o_orderkey % 5 = 1 THEN ' ' || o_orderpriority ELSE o_orderpriority END AS p FROM orders)
SELECT 'p' AS "column", count(DISTINCT p) AS levels, count(DISTINCT p) - count(DISTINCT lower(trim(p))) AS levels_collapsed FROM v""")
def category_variants(t):
    p, k = F.col("o_orderpriority"), F.col("o_orderkey") % 5
    df = t.orders.select(F.when(k == 0, F.lower(p)).when(k == 1, F.concat(F.lit(" "), p)).otherwise(p).alias("p"), "o_orderstatus")
    return quality.category_variants(df, ["p", "o_orderstatus"])


@query("range_anomalies", """SELECT * FROM (SELECT 'used_pct' AS "column", 'percentage above 100' AS issue, count(*) FILTER (o_totalprice / 4000 > 100) AS n FROM orders
UNION ALL SELECT 'net_price', 'negative value in a non-negative quantity', count(*) FILTER (o_totalprice - 2000 < 0) FROM orders) WHERE n > 0""")
def range_anomalies(t):
    df = t.orders.select((F.col("o_totalprice") / 4000).alias("used_pct"), (F.col("o_totalprice") - 2000).alias("net_price"), "o_custkey")
    return quality.range_anomalies(df, df.columns)


@query("future_dates", """SELECT 'o_orderdate' AS "column", 'after the reference' AS issue, count(*) FILTER (o_orderdate > TIMESTAMP '2001-01-01') AS n FROM orders""")
def future_dates(t):
    return quality.future_dates(t.orders, ["o_orderdate"], F.lit("2001-01-01").cast("timestamp"))


# ----------------------------------------------------------------- distributions

@query("mad_outliers", f"""WITH v AS ({long_sql('events', ['value'])} UNION ALL {long_sql('orders', ['o_totalprice'])}),
m AS (SELECT "column", median(value) AS med FROM v GROUP BY 1), d AS (SELECT v."column", value, med, abs(value - med) AS a FROM v JOIN m ON v."column" = m."column"),
s AS (SELECT "column", median(a) AS mad FROM d GROUP BY 1)
SELECT d."column", round(max(med), 6) AS median, round(max(mad), 6) AS mad, count(*) FILTER (a / (1.4826 * mad) > 3.5) AS mad_outliers, round(max(a / (1.4826 * mad)), 4) AS max_z
FROM d JOIN s ON d."column" = s."column" GROUP BY 1""")
def mad_outliers(t):
    both = profile.mad_outliers(t.events, ["value"]).union(profile.mad_outliers(t.orders, ["o_totalprice"]))
    return both.select("column", F.round("median", 6).alias("median"), F.round("mad", 6).alias("mad"), "mad_outliers", F.round("max_z", 4).alias("max_z"))


@query("outlier_agreement")
def outlier_agreement(t):
    return profile.outlier_agreement(t.events, "value", "event_id")


DENSITY_SQL = """WITH s AS (SELECT count(value) AS n, min(value) AS lo, max(value) AS hi, stddev_samp(value) * pow(count(value), -0.2) AS h FROM events),
c AS (SELECT value AS v, count(*) AS k FROM events GROUP BY 1),
d AS (SELECT i, lo + i * ((hi - lo) / 255) AS x, sum(k * exp(-0.5 * pow((lo + i * ((hi - lo) / 255) - v) / h, 2))) / (max(n) * max(h) * sqrt(2 * pi())) AS y
 FROM range(256) g(i), s, c GROUP BY 1, 2)"""


@query("density", DENSITY_SQL + " SELECT i, round(x, 4) AS x, round(y, 8) + 0.0 AS y FROM d")
def density(t):
    return profile.density(t.events, "value").select("i", F.round("x", 4).alias("x"), rnd(F.col("y"), 8).alias("y"))


@query("modes", DENSITY_SQL + """, w AS (SELECT *, lag(y) OVER (ORDER BY i) AS p, lead(y) OVER (ORDER BY i) AS f, max(y) OVER () AS peak FROM d)
SELECT 'value' AS "column", mode, round(x, 4) AS x, round(y, 8) AS y FROM (SELECT *, row_number() OVER (ORDER BY i) AS mode FROM w WHERE y > p AND y >= f AND y > 0.05 * peak) WHERE mode <= 6""")
def modes(t):
    return profile.modes(t.events, "value").select("column", F.col("mode").cast("long").alias("mode"), F.round("x", 4).alias("x"), F.round("y", 8).alias("y"))


# ----------------------------------------------------------------- sampling, digest, triples, files

@query("seeded_sample", """SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY md5('7:' || CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 200""")
def seeded_sample(t):
    return sampling.seeded_sample(t.orders, ["o_orderkey"], 200, seed=7).select("o_orderkey", "o_custkey", "o_totalprice")


@query("explorer_extract", """SELECT event_id, strftime(ts, '%Y-%m-%d') AS ts, user_id, event_type, value FROM events ORDER BY md5('7:' || CAST(event_id AS VARCHAR)), event_id LIMIT 2000""")
def explorer_extract(t):
    types = {"event_id": "id", "ts": "datetime", "user_id": "numeric", "event_type": "nominal", "value": "numeric", "props": "text"}
    return sampling.explorer_extract(t.events, types, ["event_id"], 2000, seed=7)


DIGESTED = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus"]


@query("dataset_digest", """SELECT count(*) AS rows, CAST(sum(CAST(('0x' || substr(md5(k), 1, 12)) AS BIGINT)) AS BIGINT) AS digest FROM (
 SELECT concat_ws(chr(31), """ + ", ".join(f"coalesce('v' || CAST({c} AS VARCHAR), 'n')" for c in DIGESTED) + """) AS k FROM lineitem)""")
def dataset_digest(t):
    return sampling.text_digest(t.lineitem.select(*DIGESTED))


@query("row_digest")
def row_digest(t):
    return sampling.row_digest(t.lineitem)


@query("rows_to_triples", "\nUNION ALL\n".join(
    f"""SELECT p, kind, count(*) AS n, count(DISTINCT s) AS subjects FROM (SELECT 'orders/' || CAST(o_orderkey AS VARCHAR) AS s, '{c}' AS p, '{k}' AS kind, CAST({c} AS VARCHAR) AS o FROM {GAPPY}) WHERE o IS NOT NULL GROUP BY 1, 2"""
    for c, k in (("o_totalprice", "decimal"), ("o_orderpriority", "string"), ("o_orderdate", "dateTime"), ("o_custkey", "integer"))))
def rows_to_triples(t):
    df = gappy(t).select("o_orderkey", "o_totalprice", "o_orderpriority", "o_orderdate", "o_custkey")
    g = triples.rows_to_triples(df, "orders", "o_orderkey").filter("p <> 'type'")
    return g.groupBy("p", "kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("s").alias("subjects"))


@query("triples_as_text", """SELECT '<orders/' || CAST(o_orderkey AS VARCHAR) || '> <o_orderstatus> "' || o_orderstatus || '" .' AS line FROM orders
UNION ALL SELECT '<orders/' || CAST(o_orderkey AS VARCHAR) || '> <o_custkey> "' || CAST(o_custkey AS VARCHAR) || '"^^<xsd:integer> .' FROM orders
UNION ALL SELECT '<orders/' || CAST(o_orderkey AS VARCHAR) || '> <rdf:type> <orders> .' FROM orders""")
def triples_as_text(t):
    return triples.statement_lines(triples.rows_to_triples(t.orders.select("o_orderkey", "o_orderstatus", "o_custkey"), "orders", "o_orderkey"))


ROUND_TRIP = "SELECT count(*) AS n, round(sum(c_acctbal), 2) AS total, count(DISTINCT c_mktsegment) AS segments FROM customer"


def _round_trip(t, fmt):
    back = files.round_trip(t.customer, fmt)
    return back.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"), F.count_distinct("c_mktsegment").alias("segments"))


for _fmt in ("csv", "tsv", "json", "jsonl", "parquet"):
    query(f"read_{_fmt}", ROUND_TRIP)(lambda t, fmt=_fmt: _round_trip(t, fmt))


@query("write_parts", """SELECT _part, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM (SELECT *, CASE WHEN o_orderdate >= TIMESTAMP '2000-06-01' THEN 'test' ELSE 'train' END AS _part FROM orders) GROUP BY 1""")
def write_parts(t):
    parts = t.orders.withColumn("_part", F.when(F.col("o_orderdate") >= F.lit("2000-06-01").cast("timestamp"), "test").otherwise("train"))
    return files.written_parts(parts).groupBy("_part").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("external_labels", """SELECT lang, quality, count(*) AS n, count(*) FILTER (quality IS NULL) AS unlabelled FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1, 2""")
def external_labels(t):
    joined = sampling.attach_labels(t.documents.select("doc_id", "lang"), t.labels, "doc_id")
    return joined.groupBy("lang", "quality").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("quality").isNull().cast("long")).alias("unlabelled"))


# ----------------------------------------------------------------- explorer

@query("rectangle_selection", "SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 100000 AND 200000 AND o_orderdate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1998-12-31'")
def rectangle_selection(t):
    box = {"o_totalprice": (100000, 200000), "o_orderdate": ("1997-01-01", "1998-12-31")}
    return explore.rectangle(t.orders, box).select("o_orderkey")


@query("selection_summary", """WITH s AS (SELECT * FROM orders WHERE o_totalprice BETWEEN 100000 AND 200000),
c AS (SELECT 'o_orderpriority' AS "column", o_orderpriority AS value, count(*) AS n FROM s GROUP BY 2)
SELECT 'o_totalprice' AS "column", NULL AS value, count(*) AS n, min(o_totalprice) AS low, max(o_totalprice) AS high FROM s
UNION ALL SELECT "column", value, n, NULL, NULL FROM (SELECT * FROM c ORDER BY n DESC, value LIMIT 5)""")
def selection_summary(t):
    s = explore.rectangle(t.orders, {"o_totalprice": (100000, 200000)})
    return explore.selection_summary(s, ["o_totalprice"], ["o_orderpriority"])


@query("label_distribution", "SELECT o_orderstatus AS label, count(*) AS n FROM orders GROUP BY 1")
def label_distribution(t):
    return explore.label_distribution(t.orders, "o_orderstatus")


@query("axis_coding", """SELECT o_orderkey, o_totalprice AS x, CAST(epoch_ms(o_orderdate) AS DOUBLE) AS y, CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS DOUBLE) AS z FROM orders""")
def axis_coding(t):
    return explore.axis_codes(t.orders, {"x": ("o_totalprice", "numeric"), "y": ("o_orderdate", "datetime"), "z": ("o_orderpriority", "nominal")}, ["o_orderkey"])
