"""Shaping steps run through the recipe, and checks of their output."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from specula.catalog import query
from specula.catalog import sqltext as q
from specula.operators import verify
from specula.operators.shaping import Cycle, Geometry, Partition, Step, preset, run
from specula.plans.longform import rnd
from specula.sources.sampling import text_digest

r = lambda c, d=6: rnd(F.col(c), d).alias(c)

# Orders with planted gaps and a derived label.
BASE = """(SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, o_orderdate, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS price,
 o_totalprice AS total, CASE WHEN o_custkey % 13 = 0 THEN NULL ELSE o_orderpriority END AS prio, CASE WHEN o_totalprice > 300000 THEN 1 ELSE 0 END AS big FROM orders)"""


def base(t):
    return t.orders.select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_orderdate",
        F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("price"), F.col("o_totalprice").alias("total"),
        F.when(F.col("o_custkey") % 13 != 0, F.col("o_orderpriority")).alias("prio"),
        F.when(F.col("o_totalprice") > 300000, 1).otherwise(0).alias("big"))


TIME_SPLIT = Step("split", "split", params={"kind": "time", "time_column": "o_orderdate", "test": 0.2, "valid": 0.1, "halves": "up"})
CUTOFF = Step("split", "split", params={"kind": "cutoff", "time_column": "o_orderdate", "cutoff": "2000-01-01"})
CUT = "CASE WHEN o_orderdate >= TIMESTAMP '2000-01-01' THEN 'test' ELSE 'train' END"
PARTED = f"(SELECT *, {CUT} AS _part FROM {BASE})"
TRAIN = f"(SELECT * FROM {BASE} WHERE o_orderdate < TIMESTAMP '2000-01-01')"


def shaped(t, *steps, split=CUTOFF, geometry=None, df=None):
    return run(base(t) if df is None else df, [*([split] if split else []), *steps], "o_orderkey", geometry).df


# ----------------------------------------------------------------- phase 1

@query("retype", """SELECT o_orderkey, try_cast(CASE WHEN o_orderkey % 5 = 0 THEN 'x' ELSE CAST(o_custkey AS VARCHAR) END AS DOUBLE) AS code, CAST(o_custkey AS VARCHAR) AS o_custkey,
 CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN o_orderpriority END AS o_orderpriority, try_cast(CASE WHEN o_orderkey % 3 = 0 THEN 'bad' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS TIMESTAMP) AS day, o_orderkey % 2 = 1 AS odd FROM orders""")
def retype(t):
    df = t.orders.select("o_orderkey", F.when(F.col("o_orderkey") % 5 == 0, "x").otherwise(F.col("o_custkey").cast("string")).alias("code"), "o_custkey", "o_orderpriority",
                         F.when(F.col("o_orderkey") % 3 == 0, "bad").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("day"), (F.col("o_orderkey") % 2).cast("string").alias("odd"))
    steps = [Step("a", "retype", ["code"], {"to": "numeric"}), Step("b", "retype", ["o_custkey"], {"to": "nominal"}),
             Step("c", "retype", ["o_orderpriority"], {"to": "ordinal", "order": ["1-URGENT", "2-HIGH", "3-MEDIUM"]}),
             Step("d", "retype", ["day"], {"to": "datetime"}), Step("e", "retype", ["odd"], {"to": "boolean"})]
    return run(df, steps, "o_orderkey").df.drop("_part")


@query("drop_identity_and_constant", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def drop_identity_and_constant(t):
    df = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", F.lit("x").alias("one"),
                         F.when(F.col("o_orderkey") % 200 == 0, "rare").otherwise("usual").alias("nearly"))
    steps = [Step("a", "drop_identity"), Step("b", "drop_constant", params={"tolerance": 0.02})]
    return run(df, steps, "o_orderkey", Geometry(roles={"o_custkey": "key"})).df.drop("_part")


@query("dedupe", """SELECT doc_id, lang, source, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1""")
def dedupe(t):
    return run(t.documents, [Step("d", "dedupe", params={"on": ["text"]})], "doc_id").df.select("doc_id", "lang", "source", "n_chars")


@query("dedupe_keep_last", """SELECT event_id, user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1""")
def dedupe_keep_last(t):
    return run(t.events, [Step("d", "dedupe", params={"on": ["user_id", "event_type"], "keep": "last"})], "event_id").df.select("event_id", "user_id", "event_type", "value")


@query("dedupe_near", """SELECT p_partkey FROM part a WHERE NOT EXISTS (SELECT 1 FROM part b WHERE b.p_partkey < a.p_partkey AND abs(a.p_size - b.p_size) <= 2 AND abs(a.p_retailprice - b.p_retailprice) <= 0.75)""")
def dedupe_near(t):
    step = Step("d", "dedupe", params={"tolerances": {"p_size": 2.0, "p_retailprice": 0.75}})
    return run(t.part, [step], "p_partkey").df.select("p_partkey")


@query("parse_datetime", """SELECT count(*) AS n, count(day) AS parsed, count(*) - count(day) AS lost, min(day) AS first, max(day) AS last FROM (SELECT CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderdate END AS day FROM orders)""")
def parse_datetime(t):
    df = t.orders.select("o_orderkey", F.when(F.col("o_orderkey") % 9 == 0, "soon").otherwise(F.date_format("o_orderdate", "dd.MM.yyyy")).alias("day"))
    s = run(df, [Step("p", "parse_datetime", ["day"], {"format": "dd.MM.yyyy"})], "o_orderkey")
    return s.df.agg(F.count(F.lit(1)).alias("n"), F.count("day").alias("parsed"), F.lit(s.fitted["p"]["lost"]["day"]).cast("long").alias("lost"), F.min("day").alias("first"), F.max("day").alias("last"))


# ----------------------------------------------------------------- phase 2

GEO = Geometry(roles={"o_custkey": "key"}, basis=["o_orderstatus", "o_orderpriority", "price", "net", "gross", "tax"],
               derivations={"gross": ["net", "tax"]}, cycles=[Cycle("money", ["net", "gross"], {"from_net": ["gross"], "from_gross": ["net"]}, "from_net")],
               partitions=[Partition("big", leakage=["total"])])


def money(t):
    return base(t).withColumns({"net": F.col("total") * 0.8, "tax": F.col("total") * 0.2, "gross": F.col("total")})


@query("drop_derived_and_leakage", f"SELECT o_orderkey, o_orderstatus, o_orderpriority, o_orderdate, price, prio, big, round(total * 0.2, 4) AS tax, total AS gross FROM {BASE}")
def drop_derived_and_leakage(t):
    steps = [Step("i", "drop_identity"), Step("o", "orient_cycle", params={"cycle": "money", "orientation": "from_gross"}), Step("d", "drop_derived"),
             Step("s", "select_partition", params={"label": "big"}), Step("l", "drop_leakage")]
    return run(money(t), steps, "o_orderkey", GEO).df.drop("_part").withColumn("tax", F.round("tax", 4))


@query("keep_columns", f"SELECT o_orderkey, o_orderstatus, big FROM {BASE}")
def keep_columns(t):
    steps = [Step("s", "select_partition", params={"label": "big"}), Step("l", "drop_leakage"), Step("k", "keep_columns", params={"columns": ["o_orderstatus"]})]
    return run(money(t), steps, "o_orderkey", GEO).df.drop("_part")


# ----------------------------------------------------------------- phase 3

def draw(key):
    return f"md5('7:' || CAST({key} AS VARCHAR))"


def part_sql(rank, n, test=0.2, valid=0.1):
    return f"CASE WHEN {rank} <= round({test} * {n}) THEN 'test' WHEN {rank} <= round({test} * {n}) + round({valid} * {n}) THEN 'valid' ELSE 'train' END"


@query("split_random", f"SELECT o_orderkey, {part_sql('i', 'n')} AS _part FROM (SELECT o_orderkey, row_number() OVER (ORDER BY {draw('o_orderkey')}) AS i, count(*) OVER () AS n FROM orders)")
def split_random(t):
    return shaped(t, split=Step("s", "split", params={"kind": "random", "test": 0.2, "valid": 0.1, "halves": "up"})).select("o_orderkey", "_part")


@query("split_stratified", f"SELECT o_orderkey, {part_sql('i', 'n')} AS _part FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {draw('o_orderkey')}) AS i, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders)")
def split_stratified(t):
    return shaped(t, split=Step("s", "split", params={"kind": "stratified", "by": "o_orderstatus", "test": 0.2, "valid": 0.1, "halves": "up"})).select("o_orderkey", "_part")


@query("split_stratified_many", f"SELECT o_orderkey, {part_sql('i', 'n').replace('round(', 'round_even(').replace(' * n)', ' * n, 0)')} AS _part FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY {draw('o_orderkey')}) AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)")
def split_stratified_many(t):
    return shaped(t, split=Step("s", "split", params={"kind": "stratified", "by": "o_custkey", "test": 0.2, "valid": 0.1})).select("o_orderkey", "_part")


@query("split_group", f"""SELECT o_orderkey, _part FROM orders JOIN (SELECT o_custkey, {part_sql('i', 'n')} AS _part FROM (SELECT o_custkey, row_number() OVER (ORDER BY {draw('o_custkey')}) AS i, count(*) OVER () AS n FROM (SELECT DISTINCT o_custkey FROM orders))) USING (o_custkey)""")
def split_group(t):
    return shaped(t, split=Step("s", "split", params={"kind": "group", "by": "o_custkey", "test": 0.2, "valid": 0.1, "halves": "up"})).select("o_orderkey", "_part")


TIME_PART = "SELECT o_orderkey, o_orderdate, CASE WHEN i > n - round(0.2 * n) THEN 'test' WHEN i > n - round(0.2 * n) - round(0.1 * n) THEN 'valid' ELSE 'train' END AS _part FROM (SELECT o_orderkey, o_orderdate, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS i, count(*) OVER () AS n FROM orders)"


@query("split_time", f"SELECT o_orderkey, _part FROM ({TIME_PART})")
def split_time(t):
    return shaped(t, split=TIME_SPLIT).select("o_orderkey", "_part")


@query("split_cutoff", f"SELECT o_orderkey, _part FROM {PARTED}")
def split_cutoff(t):
    return shaped(t).select("o_orderkey", "_part")


# ----------------------------------------------------------------- phase 4

@query("impute", f"""SELECT o_orderkey, CASE WHEN price IS NULL THEN 1 ELSE 0 END AS price_missing, round(coalesce(price, (SELECT median(price) FROM {TRAIN})), 4) AS price,
 coalesce(prio, (SELECT prio FROM {TRAIN} WHERE prio IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, prio LIMIT 1)) AS prio FROM {BASE}""")
def impute(t):
    return shaped(t, Step("m", "impute", ["price"], {"strategy": "median", "indicator": True}), Step("p", "impute", ["prio"], {"strategy": "mode"})).select(
        "o_orderkey", "price_missing", r("price", 4), "prio")


@query("impute_mean_and_constant", f"SELECT o_orderkey, round(coalesce(price, (SELECT avg(price) FROM {TRAIN})), 3) AS price, coalesce(prio, 'none') AS prio FROM {BASE}")
def impute_mean_and_constant(t):
    return shaped(t, Step("m", "impute", ["price"], {"strategy": "mean"}), Step("p", "impute", ["prio"], {"strategy": "constant", "value": "none"})).select("o_orderkey", r("price", 3), "prio")


@query("impute_by_group", f"""WITH g AS (SELECT o_orderstatus, o_custkey % 20 AS c20, median(price) AS m FROM {TRAIN} GROUP BY 1, 2),
k AS (SELECT o_orderstatus, prio, row_number() OVER (PARTITION BY o_orderstatus ORDER BY count(*) DESC, prio) AS i FROM {TRAIN} WHERE prio IS NOT NULL GROUP BY 1, 2)
SELECT o_orderkey, round(coalesce(price, m, (SELECT median(price) FROM {TRAIN})), 4) AS price, coalesce(b.prio, k.prio) AS prio FROM {BASE} b LEFT JOIN g ON g.o_orderstatus = b.o_orderstatus AND g.c20 = b.o_custkey % 20 LEFT JOIN k ON k.o_orderstatus = b.o_orderstatus AND k.i = 1""")
def impute_by_group(t):
    df = base(t).withColumn("c20", F.col("o_custkey") % 20)
    return shaped(t, Step("m", "impute", ["price"], {"strategy": "group-median", "by": ["o_orderstatus", "c20"]}),
                  Step("p", "impute", ["prio"], {"strategy": "group-mode", "by": ["o_orderstatus"]}), df=df).select("o_orderkey", r("price", 4), "prio")


@query("clip_and_winsorize", f"""WITH e AS (SELECT quantile_cont(price, 0.05) AS lo, quantile_cont(price, 0.95) AS hi FROM {TRAIN})
SELECT o_orderkey, CASE WHEN total < 50000 THEN 50000 WHEN total > 400000 THEN 400000 ELSE total END AS total, round(CASE WHEN price < lo THEN lo WHEN price > hi THEN hi ELSE price END, 4) AS price FROM {BASE}, e""")
def clip_and_winsorize(t):
    return shaped(t, Step("c", "clip", ["total"], {"lower": 50000, "upper": 400000}), Step("w", "winsorize", ["price"], {"lower_q": 0.05, "upper_q": 0.95})).select("o_orderkey", "total", r("price", 4))


@query("transform", "SELECT l_orderkey, round(ln(1 + l_quantity), 6) AS a, round(ln(l_extendedprice), 6) AS b, round(sqrt(l_tax), 6) AS c, round(1.0 / l_linenumber, 6) AS d FROM lineitem")
def transform(t):
    df = t.lineitem.select("l_orderkey", F.col("l_quantity").alias("a"), F.col("l_extendedprice").alias("b"), F.col("l_tax").alias("c"), F.col("l_linenumber").alias("d"))
    steps = [Step(k, "transform", [c], {"kind": k}) for c, k in (("a", "log1p"), ("b", "log"), ("c", "sqrt"), ("d", "reciprocal"))]
    return run(df, steps, "l_orderkey").df.select("l_orderkey", r("a"), r("b"), r("c"), r("d"))


BEST_BOX = "SELECT i / 20.0 AS lam FROM (SELECT i, var_pop(CASE WHEN i = 0 THEN ln(x) ELSE (pow(x, i / 20.0) - 1) / (i / 20.0) END) AS v FROM (SELECT (value + 0.01) / (SELECT exp(avg(ln(value + 0.01))) FROM events) AS x FROM events), range(-40, 41) g(i) GROUP BY i) ORDER BY v LIMIT 1"


@query("transform_box_cox", f"SELECT count(*) AS n, round(max(lam), 1) + 0.0 AS lam FROM events, ({BEST_BOX})")
def transform_box_cox(t):
    s = run(t.events.select("event_id", (F.col("value") + 0.01).alias("value")), [Step("b", "transform", ["value"], {"kind": "box-cox"})], "event_id")
    return s.df.agg(F.count("value").alias("n")).select("n", rnd(F.lit(s.fitted["b"]["lambda"]["value"]), 1).alias("lam"))


@query("transform_yeo_johnson")
def transform_yeo_johnson(t):
    s = run(t.customer.select("c_custkey", "c_acctbal"), [Step("y", "transform", ["c_acctbal"], {"kind": "yeo-johnson"})], "c_custkey")
    return s.df.agg(F.count("c_acctbal").alias("n"), F.round(F.skewness("c_acctbal"), 3).alias("skew"), F.lit(round(s.fitted["y"]["lambda"]["c_acctbal"], 4)).alias("lam"))


@query("transform_suggestions", """WITH s AS (SELECT skewness(value) * (count(value) - 2) / sqrt(count(value) * (count(value) - 1.0)) AS skew, min(value + 0.01) AS lo FROM events), a AS (SELECT skewness(ln(1 + value + 0.01 - (SELECT lo FROM s))) AS k, count(value) AS n FROM events)
SELECT 'value' AS "column", 'box-cox' AS kind, round(skew, 4) AS skew, round(k * (n - 2) / sqrt(n * (n - 1.0)), 4) AS skew_after FROM s, a WHERE abs(skew) > 1 AND lo > 0""")
def transform_suggestions(t):
    from specula.operators.suggest import transform_suggestions as suggest
    return suggest(t.events.select((F.col("value") + 0.01).alias("value")), ["value"]).select("column", "kind", r("skew", 4), r("skew_after", 4))


@query("bin", f"""WITH e AS (SELECT {q.quantile_edges('price', TRAIN, 4)} AS e, (SELECT min(total) FROM {TRAIN}) AS lo, (SELECT max(total) FROM {TRAIN}) AS hi)
SELECT o_orderkey, {q.right_closed_bin('price', 'e')} AS price_bin, CASE WHEN total <= lo + (hi - lo) / 3 THEN 0 WHEN total <= lo + (hi - lo) * 2 / 3 THEN 1 ELSE 2 END AS total,
 CASE WHEN o_custkey <= 100 THEN 0 WHEN o_custkey <= 500 THEN 1 ELSE 2 END AS o_custkey_bin FROM (SELECT * FROM {BASE} WHERE price IS NOT NULL), e""")
def bin_query(t):
    out = shaped(t, Step("q", "bin", ["price"], {"kind": "quantile", "k": 4}), Step("w", "bin", ["total"], {"kind": "width", "k": 3, "replace": True}),
                 Step("c", "bin", ["o_custkey"], {"kind": "custom", "edges": [0, 100, 500, 1e9]}))
    return out.filter("price IS NOT NULL").select("o_orderkey", "price_bin", F.col("total").cast("int").alias("total"), F.col("o_custkey_bin").cast("int").alias("o_custkey_bin"))


@query("datetime_expand", """SELECT event_id, year(ts) AS ts_year, month(ts) AS ts_month, day(ts) AS ts_day, isodow(ts) - 1 AS ts_dow, hour(ts) AS ts_hour, CASE WHEN isodow(ts) >= 6 THEN 1::BIGINT ELSE 0::BIGINT END AS ts_is_weekend,
 round(sin(2 * pi() * month(ts) / 12), 6) + 0.0 AS ts_month_sin, round(cos(2 * pi() * month(ts) / 12), 6) + 0.0 AS ts_month_cos, round(sin(2 * pi() * (isodow(ts) - 1) / 7), 6) + 0.0 AS ts_dow_sin, round(cos(2 * pi() * (isodow(ts) - 1) / 7), 6) + 0.0 AS ts_dow_cos,
 round(sin(2 * pi() * hour(ts) / 24), 6) + 0.0 AS ts_hour_sin, round(cos(2 * pi() * hour(ts) / 24), 6) + 0.0 AS ts_hour_cos FROM events""")
def datetime_expand(t):
    step = Step("d", "datetime_expand", ["ts"], {"parts": ["year", "month", "day", "dow", "hour", "is_weekend"], "cyclic": True})
    d = run(t.events, [step], "event_id").df
    return d.select("event_id", *[f"ts_{p}" for p in ("year", "month", "day", "dow", "hour", "is_weekend")], *[r(f"ts_{p}_{f}") for p in ("month", "dow", "hour") for f in ("sin", "cos")])


@query("lag", """SELECT event_id, lag(value, 1) OVER w AS value_lag1, lag(value, 24) OVER w AS value_lag24 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def lag(t):
    return run(t.events, [Step("l", "lag", ["value"], {"lags": [1, 24], "group_by": "user_id", "time_column": "ts"})], "event_id").df.select("event_id", "value_lag1", "value_lag24")


@query("lag_ungrouped_within_parts", f"SELECT o_orderkey, lag(total, 1) OVER w AS total_lag1, lag(total, 3) OVER w AS total_lag3 FROM {PARTED} WINDOW w AS (PARTITION BY _part ORDER BY o_orderdate, o_orderkey)")
def lag_ungrouped(t):
    return shaped(t, Step("l", "lag", ["total"], {"lags": [1, 3], "time_column": "o_orderdate"})).select("o_orderkey", "total_lag1", "total_lag3")


# ----------------------------------------------------------------- phase 5 and 6

@query("encode_one_hot", f"""SELECT o_orderkey, """ + ", ".join(f"""CAST(o_orderstatus = '{s}' AS TINYINT) AS "o_orderstatus={s}" """ for s in "FOP") + f", CAST(coalesce(prio, '<null>') = '1-URGENT' AS TINYINT) AS urgent FROM {BASE}")
def encode_one_hot(t):
    d = shaped(t, Step("e", "encode", ["o_orderstatus", "prio"], {"strategy": "one-hot"}))
    return d.select("o_orderkey", *[f"`o_orderstatus={s}`" for s in "FOP"], F.col("`prio=1-URGENT`").alias("urgent"))


@query("encode_ordinal_many", f"""WITH o AS (SELECT DISTINCT 'Customer#' || o_custkey AS c FROM {TRAIN}), p AS (SELECT c, row_number() OVER (ORDER BY c) - 1 AS code FROM o)
SELECT o_orderkey, code AS name FROM orders LEFT JOIN p ON 'Customer#' || o_custkey = c""")
def encode_ordinal_many(t):
    df = base(t).withColumn("name", F.concat(F.lit("Customer#"), F.col("o_custkey").cast("string")))
    return shaped(t, Step("o", "encode", ["name"], {"strategy": "ordinal"}), df=df).select("o_orderkey", "name")


@query("encode_ordinal_and_frequency", f"""WITH o AS (SELECT DISTINCT coalesce(prio, '<null>') AS c FROM {TRAIN}), p AS (SELECT c, row_number() OVER (ORDER BY c) - 1 AS code FROM o), f AS (SELECT CAST(o_custkey AS VARCHAR) AS k, count(*) / (SELECT count(*) FROM {TRAIN}) AS s FROM {TRAIN} GROUP BY 1)
SELECT o_orderkey, p.code AS prio, round(coalesce(f.s, 0.0), 8) AS o_custkey, CAST(list_position(['O', 'F'], o_orderstatus) - 1 AS BIGINT) AS o_orderstatus FROM {BASE} b LEFT JOIN p ON p.c = coalesce(b.prio, '<null>') LEFT JOIN f ON f.k = CAST(b.o_custkey AS VARCHAR)""")
def encode_ordinal_and_frequency(t):
    d = shaped(t, Step("o", "encode", ["prio"], {"strategy": "ordinal"}), Step("f", "encode", ["o_custkey"], {"strategy": "frequency"}),
               Step("s", "encode", ["o_orderstatus"], {"strategy": "ordinal", "order": ["O", "F"]}))
    return d.select("o_orderkey", "prio", r("o_custkey", 8), F.col("o_orderstatus").cast("long").alias("o_orderstatus"))


@query("encode_target", f"""WITH m AS (SELECT coalesce(prio, '<null>') AS c, avg(big) AS v FROM {TRAIN} GROUP BY 1), k AS (SELECT CAST(o_custkey AS VARCHAR) AS c, avg(big) AS v FROM {TRAIN} GROUP BY 1)
SELECT o_orderkey, round(m.v, 6) AS prio, round(coalesce(k.v, (SELECT avg(big) FROM {TRAIN})), 6) AS o_custkey FROM {BASE} b LEFT JOIN m ON m.c = coalesce(b.prio, '<null>') LEFT JOIN k ON k.c = CAST(b.o_custkey AS VARCHAR)""")
def encode_target(t):
    d = run(base(t), [Step("s", "select_partition", params={"label": "big"}), CUTOFF, Step("e", "encode", ["prio", "o_custkey"], {"strategy": "target"})], "o_orderkey").df
    return d.select("o_orderkey", r("prio"), r("o_custkey"))


@query("encode_target_out_of_fold")
def encode_target_folds(t):
    d = run(base(t), [Step("s", "select_partition", params={"label": "big"}), CUTOFF, Step("e", "encode", ["prio"], {"strategy": "target", "folds": 5})], "o_orderkey").df
    return d.groupBy("_part").agg(F.count_distinct("prio").alias("codes"), F.round(F.avg("prio"), 4).alias("mean_code"))


@query("encode_hashing")
def encode_hashing(t):
    d = shaped(t, Step("h", "encode", ["o_custkey"], {"strategy": "hashing", "buckets": 4}))
    return d.agg(*[F.sum(f"`o_custkey#{i}`").alias(f"bucket_{i}") for i in range(4)])


@query("scale", f"""WITH s AS (SELECT avg(price) AS m, stddev_pop(price) AS sd, quantile_cont(o_custkey, 0.5) AS med, quantile_cont(o_custkey, 0.75) - quantile_cont(o_custkey, 0.25) AS iqr, min(total) AS lo, max(total) AS hi FROM {TRAIN})
SELECT o_orderkey, round((price - m) / sd, 6) + 0.0 AS price, round((o_custkey - med) / iqr, 6) + 0.0 AS o_custkey, round((total - lo) / (hi - lo), 6) + 0.0 AS total FROM {BASE}, s""")
def scale(t):
    d = shaped(t, Step("a", "scale", params={"kind": "standard", "columns": ["price"]}), Step("b", "scale", params={"kind": "robust", "columns": ["o_custkey"]}),
               Step("c", "scale", params={"kind": "minmax", "columns": ["total"]}))
    return d.select("o_orderkey", r("price"), r("o_custkey"), r("total"))


@query("project", """WITH c AS (SELECT avg(l_tax) AS mx, avg(l_discount) AS my, var_pop(l_tax) AS a, var_pop(l_discount) AS d, covar_pop(l_tax, l_discount) AS b FROM lineitem), e AS (SELECT *, (a + d) / 2 + sqrt(pow((a - d) / 2, 2) + b * b) AS l1 FROM c)
SELECT CAST(2 AS BIGINT) AS components, round(l1 / (a + d), 6) AS explained, round((SELECT var_pop(((l_discount - my) * (l1 - a) + (l_tax - mx) * b) / sqrt((l1 - a) * (l1 - a) + b * b)) FROM lineitem), 8) AS var1 FROM e""")
def project(t):
    s = run(t.lineitem.select("l_orderkey", "l_tax", "l_discount"), [Step("p", "project", params={"columns": ["l_tax", "l_discount"], "variance": 0.95})], "l_orderkey")
    return s.df.agg(F.lit(len(s.fitted["p"]["explained"])).cast("long").alias("components"), F.round(F.lit(s.fitted["p"]["explained"][0]), 6).alias("explained"), F.round(F.var_pop("pc1"), 8).alias("var1"))


@query("select_features", f"SELECT o_orderkey, o_custkey, total FROM {BASE}")
def select_features(t):
    df = base(t).select("o_orderkey", "o_custkey", "total", (F.col("total") * 2 + 1).alias("twice"), F.lit(3.0).alias("flat"), (F.col("o_orderkey") % 3).alias("noise"))
    steps = [CUTOFF_ANY(), Step("v", "select_features", params={"kind": "variance", "threshold": 0.0}), Step("c", "select_features", params={"kind": "correlation", "threshold": 0.95}),
             Step("i", "select_features", params={"kind": "importance", "threshold": 0.0, "scores": {"o_custkey": 0.2, "noise": -0.01}})]
    return run(df, steps, "o_orderkey").df.drop("_part")


def CUTOFF_ANY():
    return Step("s", "split", params={"kind": "random", "test": 0.2})


@query("custom_step", f"SELECT o_orderkey, round(total / 1000, 6) AS thousands FROM {BASE} WHERE o_orderstatus <> 'P'")
def custom_step(t):
    step = Step("u", "custom", params={"phase": 4, "function": lambda d, ctx: d.filter("o_orderstatus <> 'P'").withColumn("thousands", F.col("total") / 1000)}, source="user")
    return shaped(t, step).select("o_orderkey", r("thousands", 6))


# ----------------------------------------------------------------- whole recipes and reports

def full_recipe(t):
    steps = [Step("id", "drop_identity"), Step("cycle", "orient_cycle", params={"cycle": "money"}), Step("derived", "drop_derived"), Step("label", "select_partition", params={"label": "big"}),
             Step("leak", "drop_leakage", why="total decides big"), TIME_SPLIT, Step("gaps", "impute", ["price"], {"strategy": "median", "indicator": True}),
             Step("calendar", "datetime_expand", ["o_orderdate"], {"cyclic": True}), Step("codes", "encode", ["o_orderstatus"], {"strategy": "one-hot"}),
             Step("scale", "scale", params={"kind": "robust", "columns": ["price"]})]
    return run(money(t), steps, "o_orderkey", GEO)


@query("recipe", f"""WITH p AS ({TIME_PART}), b AS (SELECT b.*, p._part FROM {BASE} b JOIN p USING (o_orderkey)), m AS (SELECT median(price) AS med FROM b WHERE _part = 'train'),
f AS (SELECT b.*, coalesce(price, med) AS filled FROM b, m), s AS (SELECT quantile_cont(filled, 0.5) AS c, quantile_cont(filled, 0.75) - quantile_cont(filled, 0.25) AS w FROM f WHERE _part = 'train')
SELECT _part, count(*) AS n, round(avg((filled - c) / w), 6) + 0.0 AS price, CAST(count(*) FILTER (price IS NULL) AS BIGINT) AS gaps, round(avg(month(o_orderdate)), 6) AS month, CAST(count(*) FILTER (o_orderstatus = 'F') AS BIGINT) AS status_f, round(avg(big), 6) AS rate FROM f, s GROUP BY 1""")
def recipe(t):
    d = full_recipe(t).df
    return d.groupBy("_part").agg(F.count(F.lit(1)).alias("n"), rnd(F.avg("price")).alias("price"), F.sum("price_missing").cast("long").alias("gaps"), F.round(F.avg("o_orderdate_month"), 6).alias("month"),
                                  F.sum("`o_orderstatus=F`").cast("long").alias("status_f"), F.round(F.avg("big"), 6).alias("rate"))


@query("recipe_manifest", f"""WITH p AS (SELECT _part, count(*) AS n FROM ({TIME_PART}) GROUP BY 1) SELECT step_id, part, n FROM (SELECT unnest(['id', 'cycle', 'derived', 'label', 'leak']) AS step_id, 'all' AS part, (SELECT count(*) FROM orders) AS n)
UNION ALL SELECT step_id, _part, n FROM (SELECT unnest(['split', 'gaps', 'calendar', 'codes', 'scale']) AS step_id), p""")
def recipe_manifest(t):
    return full_recipe(t).manifest_table().select("step_id", F.explode("rows_after").alias("part", "n"))


@query("recipe_lineage")
def recipe_lineage(t):
    return full_recipe(t).lineage()


@query("recipe_schema")
def recipe_schema(t):
    return full_recipe(t).output_schema()


@query("recipe_digest")
def recipe_digest(t):
    """Two runs of one recipe give the same rows."""
    one, two = (text_digest(full_recipe(t).df.drop("_part")) for _ in range(2))
    return one.join(two.select(F.col("digest").alias("again")), F.lit(True)).select("rows", (F.col("digest") == F.col("again")).alias("same"))


@query("preset_train_ready", f"""SELECT _part, count(*) AS n FROM (SELECT {part_sql('i', 'n')} AS _part FROM (SELECT row_number() OVER (PARTITION BY big ORDER BY {draw('o_orderkey')}) AS i, count(*) OVER (PARTITION BY big) AS n FROM {BASE})) GROUP BY 1""")
def preset_train_ready(t):
    geometry = Geometry(roles={"o_custkey": "key"}, partitions=[Partition("big", leakage=["total"])])
    types = {"price": "numeric", "prio": "nominal", "o_orderstatus": "nominal", "o_custkey": "numeric", "total": "numeric"}
    steps = preset("train-ready", geometry, types, label="big", halves="up")
    return run(base(t).drop("o_orderdate"), steps, "o_orderkey", geometry).df.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))


# ----------------------------------------------------------------- verification

@query("verify_structure")
def verify_structure(t):
    return verify.structural(full_recipe(t))


@query("verify_derivations", f"""SELECT 'gross' AS "column", count(*) AS rows, count(*) FILTER (abs(total - (total * 0.8 + total * 0.2)) <= 1e-6 * greatest(1.0, abs(total))) AS agree, true AS confirmed FROM {BASE}""")
def verify_derivations(t):
    s = run(money(t), [Step("c", "drop_constant")], "o_orderkey", GEO)
    return verify.surviving_derivations(s, {"gross": "net + tax"})


@query("verify_broken_derivation", f"""SELECT 'gross' AS "column", count(*) AS rows, count(*) FILTER (abs(total - (CASE WHEN total * 0.8 > 200000 THEN 200000 ELSE total * 0.8 END + total * 0.2)) <= 1e-6 * greatest(1.0, abs(CASE WHEN total * 0.8 > 200000 THEN 200000 ELSE total * 0.8 END + total * 0.2))) AS agree, false AS confirmed FROM {BASE}""")
def verify_broken(t):
    s = run(money(t), [Step("c", "clip", ["net"], {"upper": 200000})], "o_orderkey", GEO)
    return verify.surviving_derivations(s, {"gross": "net + tax"})


@query("verify_dropped_heads", f"SELECT 'net,tax' AS lhs, 'gross' AS rhs, count(*) AS rows, 1.0::DOUBLE AS determination, true AS holds FROM {BASE}")
def verify_dropped(t):
    s = run(money(t), [Step("d", "drop_derived")], "o_orderkey", GEO)
    return verify.still_determined(money(t), s, "gross", ["net", "tax"])


@query("verify_untouched_drift", f"""SELECT 'o_custkey' AS "column", true AS small, false AS moved UNION ALL SELECT 'o_orderstatus', true, count(*) < 0 FROM {BASE}""")
def verify_untouched(t):
    src = base(t).select("o_orderkey", "o_custkey", "o_orderstatus", "price")
    s = run(src, [Step("w", "winsorize", ["price"])], "o_orderkey")
    return verify.untouched_drift(src, s).select("column", (F.col("psi") < 1e-9).alias("small"), "moved")


@query("verify_split", "SELECT count(*) AS rows, CAST(0 AS BIGINT) AS in_two_parts FROM orders")
def verify_split(t):
    return verify.split_overlap(shaped(t, split=TIME_SPLIT), "o_orderkey")


@query("verify_groups", "SELECT count(DISTINCT o_custkey) AS keys, CAST(0 AS BIGINT) AS straddling FROM orders")
def verify_groups(t):
    return verify.group_integrity(shaped(t, split=Step("s", "split", params={"kind": "group", "by": "o_custkey"})), "o_custkey")


@query("verify_time_order", f"SELECT _part, min(o_orderdate) AS first, max(o_orderdate) AS last, true AS in_order FROM ({TIME_PART}) GROUP BY 1")
def verify_time(t):
    return verify.time_order(shaped(t, split=TIME_SPLIT), "o_orderdate")


@query("verify_label_rates", f"SELECT _part, round(avg(big), 6) AS rate, (SELECT round(avg(big), 6) FROM {BASE}) AS whole, abs(avg(big) - (SELECT avg(big) FROM {BASE})) <= 0.15 AS within FROM {PARTED} GROUP BY 1")
def verify_labels(t):
    return verify.label_rates(base(t), shaped(t), "big").select("_part", r("rate"), r("whole"), "within")
