"""Segments and importance: fits over the tables, with SQL for the parts SQL can say."""

from __future__ import annotations

from pyspark.sql import functions as F

from specula.catalog import query
from specula.operators import importance, linkage, segments
from specula.operators.importance import Task
from specula.plans.longform import rnd

r = lambda c, d=6: rnd(F.col(c), d).alias(c)


def two_groups(t):
    """Parts moved apart in two planted groups."""
    shift = F.when(F.col("p_partkey") % 3 == 0, 200).otherwise(0)
    return t.part.select("p_partkey", "p_brand", "p_type", (F.col("p_size") + shift).alias("size"), (F.col("p_retailprice") + shift).alias("price"), (F.col("p_partkey") % 3 == 0).cast("int").alias("planted"))


@query("kmeans_scan")
def kmeans_scan(t):
    return segments.kmeans_scan(two_groups(t), ["size", "price"], "p_partkey", ks=(2, 3), refits=2).select("k", *[r(c, 4) for c in ("inertia", "silhouette", "stability_mean", "agreement", "score")])


@query("best_k")
def best_k(t):
    return segments.best_k(segments.kmeans_scan(two_groups(t), ["size", "price"], "p_partkey", ks=(2, 3), refits=1)).select("k", r("score", 4))


@query("segments_against_planted", "SELECT CAST(1.0 AS DOUBLE) AS ari, count(*) AS n, count(DISTINCT p_partkey % 3 = 0) AS segments FROM part")
def segments_against_planted(t):
    found = segments.assign(two_groups(t), ["size", "price"], "p_partkey", 2)
    return segments.adjusted_rand(found, "segment", "planted").join(found.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("segment").alias("segments")), F.lit(True))


@query("linkage_groups", """WITH p AS (SELECT p_partkey % 3 = 0 AS planted, p_size + CASE WHEN p_partkey % 3 = 0 THEN 200 ELSE 0 END AS size FROM part),
g AS (SELECT count(*) AS n, avg(size) AS size FROM p GROUP BY planted) SELECT CAST(row_number() OVER (ORDER BY n DESC, size) - 1 AS INTEGER) AS segment, n, round(size, 6) AS size FROM g""")
def linkage_groups(t):
    found = linkage.with_groups(two_groups(t).select("size", "price"), ["size", "price"], 2)
    return found.groupBy("segment").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("size"), 6).alias("size"))


@query("adjusted_rand", """WITH c AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS n FROM lineitem GROUP BY 1, 2), s AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM c) AS ij, (SELECT sum(k * (k - 1) / 2) FROM (SELECT sum(n) AS k FROM c GROUP BY a)) AS i,
 (SELECT sum(k * (k - 1) / 2) FROM (SELECT sum(n) AS k FROM c GROUP BY b)) AS j, (SELECT count(*) * (count(*) - 1.0) / 2 FROM lineitem) AS t) SELECT round((ij - i * j / t) / ((i + j) / 2 - i * j / t), 8) + 0.0 AS ari FROM s""")
def adjusted_rand(t):
    return segments.adjusted_rand(t.lineitem, "l_returnflag", "l_linestatus").select(r("ari", 8))


@query("segment_profile", """WITH s AS (SELECT *, l_linenumber % 3 AS segment, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y FROM lineitem), b AS (SELECT segment, count(*) AS n, count(*) / (SELECT count(*) FROM s) AS share, avg(y) AS label_rate FROM s GROUP BY 1),
c AS (SELECT segment, 'l_quantity' AS "column", median(l_quantity) AS median, (avg(l_quantity) - (SELECT avg(l_quantity) FROM s)) / (SELECT stddev_pop(l_quantity) FROM s) AS d, NULL AS dominant FROM s GROUP BY 1
 UNION ALL SELECT segment, 'l_extendedprice', median(l_extendedprice), (avg(l_extendedprice) - (SELECT avg(l_extendedprice) FROM s)) / (SELECT stddev_pop(l_extendedprice) FROM s), NULL FROM s GROUP BY 1
 UNION ALL SELECT segment, 'l_returnflag', NULL, NULL, (SELECT l_returnflag FROM s x WHERE x.segment = s.segment GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) FROM s GROUP BY segment)
SELECT CAST(segment AS INTEGER) AS segment, n, round(share, 6) AS share, round(label_rate, 6) AS label_rate, "column", round(median, 4) AS median, round(d, 6) + 0.0 AS standardised_difference, dominant FROM b JOIN c USING (segment)""")
def segment_profile(t):
    s = t.lineitem.withColumn("segment", F.col("l_linenumber") % 3).withColumn("y", (F.col("l_returnflag") == "R").cast("int"))
    p = segments.segment_profile(s, "segment", ["l_quantity", "l_extendedprice"], ["l_returnflag"], "y")
    return p.select("segment", "n", r("share"), r("label_rate"), "column", r("median", 4), r("standardised_difference"), "dominant")


# ----------------------------------------------------------------- importance

def orders(t):
    """A label that depends on the price; ``hint`` is the price with noise, ``key`` is noise."""
    return t.orders.select("o_orderkey", "o_orderpriority", (F.col("o_custkey") % 17).alias("key"), (F.col("o_totalprice") / 1e5 + (F.col("o_orderkey") * 7 % 13) / 4).alias("hint"),
                           (F.col("o_totalprice") / 1e5).alias("price"), (F.col("o_totalprice") > 250000).cast("int").alias("big"), "o_orderstatus")


TASK = Task("big", ["hint", "key"], ["o_orderpriority"], "binary", "o_orderkey")
LEAKY = Task("big", ["hint", "key", "price"], ["o_orderpriority"], "binary", "o_orderkey")


@query("model_baseline", """SELECT 'multiclass' AS task, 'majority' AS kind, round(max(n) / sum(n), 6) AS score FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderstatus)
UNION ALL SELECT 'binary', 'majority', 0.5 * (count(*) / count(*)) FROM orders UNION ALL SELECT 'regression', 'mean', 0.0 * count(*) FROM orders""")
def model_baseline(t):
    out = None
    for kind, label in (("multiclass", "o_orderstatus"), ("binary", "big"), ("regression", "price")):
        task = Task(label, ["hint"], [], kind, "o_orderkey")
        one = importance.baseline(importance.prepare(orders(t), task), task).select(F.lit(kind).alias("task"), "kind", r("score"))
        out = one if out is None else out.union(one)
    return out


@query("fold_deal", """SELECT y AS target, fold, count(*) AS n FROM (SELECT CASE WHEN o_totalprice > 250000 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS y, (row_number() OVER (PARTITION BY o_totalprice > 250000 ORDER BY o_orderkey) - 1) % 5 AS fold FROM orders) GROUP BY 1, 2""")
def fold_deal(t):
    rows = importance.dealt(importance.prepare(orders(t), TASK), TASK)
    return rows.groupBy("target", (F.col("_deal") % 5).alias("fold")).agg(F.count(F.lit(1)).alias("n"))


@query("model_scores")
def model_scores(t):
    return importance.model_scores(orders(t), TASK, folds=2).select("model", "metric", r("score", 3))


@query("model_scores_regression")
def model_scores_regression(t):
    return importance.model_scores(orders(t), Task("price", ["hint", "key"], [], "regression", "o_orderkey"), models=("linear",), folds=3).select("model", "metric", r("score", 3))


@query("permutation_importance")
def permutation_importance(t):
    return importance.permutation_importance(orders(t), TASK, repeats=2).select("feature", r("mean", 3))


@query("leakage_probe")
def leakage_probe(t):
    return importance.leakage_probe(orders(t), LEAKY, ["price"], folds=2).select(F.concat_ws(",", "suspects").alias("suspects"), r("score_with", 3), r("score_without", 3), "near_perfect")


@query("learning_curve")
def learning_curve(t):
    return importance.learning_curve(orders(t), TASK, fractions=(0.1, 0.5, 1.0)).select("fraction", "n", r("score", 3))
