"""Rank, effective and intrinsic dimension of the numeric columns; principal components."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from specula.plans.gram import gram
from specula.sources.sampling import seeded_sample


def space(df: DataFrame, columns: list[str]) -> DataFrame:
    """Singular values and what follows from them, from one correlation aggregation.

    Eigenvalues of a cross-product matrix square the condition number, so the exact rank is
    stated at a tolerance of 1e-13 on them, and the near rank at 1e-12 (1e-6 on singular values).
    """
    g = gram(df, columns)
    eigen = np.clip(np.linalg.eigvalsh(g.corr)[::-1], 0, None)
    total = eigen.sum()
    shares = eigen / total if total > 0 else eigen
    run = np.cumsum(shares)
    row = (columns, g.n, len(columns), [float(np.sqrt(g.n * v)) for v in eigen], shares.tolist(),
           int((eigen > 1e-13 * eigen[0]).sum()), int((eigen > 1e-12 * eigen[0]).sum()),
           int(np.searchsorted(run, 0.95) + 1), int(np.searchsorted(run, 0.99) + 1),
           float(total ** 2 / (eigen ** 2).sum()), float(np.sqrt(eigen[0] / max(eigen[-1], 1e-300))))
    return df.sparkSession.createDataFrame([row], (
        "columns array<string>, n_rows long, ambient_dim long, singular_values array<double>, explained array<double>, "
        "exact_rank long, near_rank long, dims_95 long, dims_99 long, participation_ratio double, condition_number double"))


def two_nearest_dimension(df: DataFrame, columns: list[str], row_id: list[str], max_points: int = 3000, seed: int = 7) -> DataFrame:
    """Two-nearest-neighbours estimate of the intrinsic dimension (Facco et al. 2017).

    The estimator works on a seeded sample of at most ``max_points`` distinct points. Every
    task measures its own points against the sample, so no table of pairs exists.
    """
    g = gram(df, columns)
    z = [((F.col(c).cast("double") - float(m)) / float(s if s > 0 else 1.0)).alias(f"z{i}")
         for i, (c, m, s) in enumerate(zip(columns, g.mean, g.std))]
    names = [f"z{i}" for i in range(len(columns))]
    points = (seeded_sample(df.dropna(subset=columns), row_id, max_points, seed).select(*z).distinct()
              .toPandas().to_numpy(dtype=float))
    if len(points) < 20:
        return df.sparkSession.createDataFrame([(len(points), None)], "n_points long, dimension double")
    shared = df.sparkSession.sparkContext.broadcast(points)

    def nearest(batches):
        everyone = shared.value
        for b in batches:
            own = b.to_numpy(dtype=float)
            d2 = np.maximum((own ** 2).sum(1)[:, None] + (everyone ** 2).sum(1)[None, :] - 2 * own @ everyone.T, 0)
            d2.partition(2, axis=1)
            near = np.sort(d2[:, :3], axis=1)
            yield pd.DataFrame({"r1": np.sqrt(near[:, 1]), "r2": np.sqrt(near[:, 2])})

    rows = df.sparkSession.createDataFrame(pd.DataFrame(points, columns=names)).repartition(8)
    mu = rows.mapInPandas(nearest, "r1 double, r2 double").filter("r1 > 0").select((F.col("r2") / F.col("r1")).alias("mu"))
    order = Window.partitionBy(F.lit(0)).orderBy("mu")  # at most max_points rows
    ranked = mu.withColumn("i", F.row_number().over(order)).withColumn("m", F.floor(F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))) * 0.9))
    x, y = F.log("mu"), -F.log(1 - F.col("i") / F.col("m") + 1e-12)
    return ranked.filter("i <= m").agg(F.lit(len(points)).cast("long").alias("n_points"),
                                       F.round(F.sum(x * y) / F.sum(x * x), 2).alias("dimension"))


def principal_components(df: DataFrame, columns: list[str], k: int = 3, keep: list[str] | None = None) -> tuple[DataFrame, np.ndarray]:
    """Scores of standardised complete rows on the first k components, and all explained shares.

    The p x p eigenproblem comes from one aggregation; scores are plain column arithmetic.
    A component's sign makes its largest loading positive.
    """
    g = gram(df, columns)
    loadings, shares = components(g.corr, k)
    z = [(F.col(c).cast("double") - float(m)) / float(s if s > 0 else 1.0) for c, m, s in zip(columns, g.mean, g.std)]
    scores = [sum((float(w) * e for w, e in zip(row[1:], z[1:])), float(row[0]) * z[0]).alias(f"pc{i + 1}") for i, row in enumerate(loadings)]
    return df.dropna(subset=columns).select(*(keep or []), *scores), shares


def components(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    values, vectors = np.linalg.eigh(matrix)
    order = np.argsort(values)[::-1]
    values, vectors = np.clip(values[order], 0, None), vectors[:, order]
    top = vectors[:, :k].T
    signs = np.sign(top[np.arange(len(top)), np.abs(top).argmax(axis=1)])
    return top * np.where(signs == 0, 1, signs)[:, None], values / values.sum()
