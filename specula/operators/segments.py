"""Clusters of rows: a scan over k, stability, a second algorithm, and profiles."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from specula.operators import linkage
from specula.plans.longform import level, numeric_long
from specula.plans.ordered import quantile_columns, ranked_counts


def standardised(df: DataFrame, features: list[str], row_id: str) -> DataFrame:
    """(row_id, features vector), centred and scaled, complete rows only."""
    rows = df.select(row_id, *[F.col(c).cast("double").alias(c) for c in features]).dropna()
    vectors = VectorAssembler(inputCols=features, outputCol="raw").transform(rows)
    scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True).fit(vectors)
    return scaler.transform(vectors).select(row_id, "features")


def adjusted_rand(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index of two labelings, from their contingency table."""
    n = F.col("n").cast("double")
    two = n * (n - 1) / 2
    cells = pairs.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    sums = lambda t, name: t.agg(F.sum(two).alias(name), F.sum("n").alias(f"n_{name}"))
    whole = (sums(cells, "ij").join(sums(cells.groupBy("a").agg(F.sum("n").alias("n")), "i"), F.lit(True))
             .join(sums(cells.groupBy("b").agg(F.sum("n").alias("n")), "j"), F.lit(True)))
    total = F.col("n_ij").cast("double") * (F.col("n_ij") - 1) / 2
    chance = F.col("i") * F.col("j") / total
    top = (F.col("i") + F.col("j")) / 2
    return whole.select(F.when(top == chance, 1.0).otherwise((F.col("ij") - chance) / (top - chance)).alias("ari"))


def kmeans_scan(df: DataFrame, features: list[str], row_id: str, ks=range(2, 9), refits: int = 10, seed: int = 7) -> DataFrame:
    """(k, inertia, silhouette, stability_mean, stability_sd, agreement, score), all rows, no sample for fit or score.

    Stability refits on seeded 80% subsamples; agreement is with Ward's hierarchy over clustering features.
    """
    points = standardised(df, features, row_id)
    places = [f"f{j}" for j in range(len(features))]
    wide = points.select("*", *[vector_to_array("features")[j].alias(p) for j, p in enumerate(places)])
    tree = linkage.ward(wide, places)
    points = linkage.with_leaf(wide, places, tree).select(*points.columns, "leaf").cache()
    judge = ClusteringEvaluator(featuresCol="features", predictionCol="cluster", metricName="silhouette")
    rows = []
    for k in ks:
        model = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(points)
        labelled = model.transform(points)
        silhouette = float(judge.evaluate(labelled))
        scores = []
        for r in range(refits):
            part = points.filter(F.pmod(F.xxhash64(row_id, F.lit(seed + r)), F.lit(1000)) < 800)
            again = KMeans(k=k, seed=seed + r, featuresCol="features", predictionCol="again").fit(part)
            scores.append(float(adjusted_rand(again.transform(model.transform(part)), "cluster", "again").first()[0]))
        mean = sum(scores) / len(scores) if scores else 0.0
        sd = (sum((s - mean) ** 2 for s in scores) / len(scores)) ** 0.5 if scores else 0.0
        other = labelled.withColumn("other", F.get(F.lit(tree.labels(k)), F.col("leaf")))
        agree = float(adjusted_rand(other, "cluster", "other").first()[0])
        rows.append((k, float(model.summary.trainingCost), silhouette, mean, sd, agree, silhouette * (0.5 + 0.5 * mean)))
    points.unpersist()
    return df.sparkSession.createDataFrame(rows, "k long, inertia double, silhouette double, stability_mean double, stability_sd double, agreement double, score double")


def best_k(scan: DataFrame) -> DataFrame:
    return scan.orderBy(F.col("score").desc(), "k").limit(1)


def assign(df: DataFrame, features: list[str], row_id: str, k: int, seed: int = 7) -> DataFrame:
    """The rows with their cluster as ``segment``."""
    points = standardised(df, features, row_id)
    model = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="segment").fit(points)
    return df.join(model.transform(points).select(row_id, "segment"), row_id)


def segment_profile(df: DataFrame, segment: str, features: list[str], nominal: list[str], label: str | None = None) -> DataFrame:
    """(segment, n, share, column, median, standardised_difference, dominant, label_rate), one row per segment and column."""
    sizes = df.groupBy(F.col(segment).alias("segment")).agg(
        F.count(F.lit(1)).alias("n"), *([F.avg(F.col(label).cast("double")).alias("label_rate")] if label else [F.lit(None).cast("double").alias("label_rate")]))
    total = sizes.agg(F.sum("n").alias("total"))
    base = sizes.join(F.broadcast(total), F.lit(True)).select("segment", "n", (F.col("n") / F.col("total")).alias("share"), "label_rate")
    keyed = df.select(F.col(segment).alias("segment"), *features)
    medians = ranked_counts(keyed, features, ["segment"]).groupBy("column", "segment").agg(*quantile_columns([0.5], ["median"]))
    means = numeric_long(keyed, features, ["segment"]).groupBy("column", "segment").agg(F.avg("value").alias("m"))
    whole = numeric_long(keyed, features).groupBy("column").agg(F.avg("value").alias("g"), F.stddev_pop("value").alias("sd"))
    numbers = (medians.join(means, ["column", "segment"]).join(F.broadcast(whole), "column")
               .select("segment", "column", "median", F.when(F.col("sd") > 0, (F.col("m") - F.col("g")) / F.col("sd")).alias("standardised_difference"),
                       F.lit(None).cast("string").alias("dominant")))
    if nominal:
        long = df.select(F.col(segment).alias("segment"), *[level(c).alias(c) for c in nominal]).unpivot(["segment"], nominal, "column", "value")
        top = (long.groupBy("segment", "column", "value").agg(F.count(F.lit(1)).alias("k")).groupBy("segment", "column")
               .agg(F.min_by("value", F.struct(-F.col("k"), "value")).alias("dominant")))
        numbers = numbers.union(top.select("segment", "column", F.lit(None).cast("double"), F.lit(None).cast("double"), "dominant"))
    return base.join(numbers, "segment")
