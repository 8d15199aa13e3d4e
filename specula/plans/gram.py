"""Means, scales and cross products of numeric columns: one p x p matrix on the driver."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SQL_LIMIT = 12


@dataclass
class Gram:
    names: list[str]
    n: int
    mean: np.ndarray
    std: np.ndarray          # population
    corr: np.ndarray         # cross products of standardised columns over n
    low: np.ndarray
    high: np.ndarray

    def take(self, names: list[str]) -> np.ndarray:
        at = [self.names.index(c) for c in names]
        return self.corr[np.ix_(at, at)]

    def fit(self, target: str, others: list[str]) -> tuple[float, dict[str, float], float]:
        """Least squares of target on others: R squared, coefficients, intercept."""
        i = self.names.index(target)
        at = [self.names.index(c) for c in others]
        if self.std[i] == 0 or not at:
            return 0.0, {}, float(self.mean[i])
        a, b = self.corr[np.ix_(at, at)], self.corr[at, i]
        beta = np.linalg.lstsq(a, b, rcond=1e-12)[0]
        r2 = float(beta @ b)
        scale = np.where(self.std[at] > 0, self.std[at], 1.0)
        coef = beta * self.std[i] / scale
        return min(1.0, r2), dict(zip(others, coef.tolist())), float(self.mean[i] - coef @ self.mean[at])


def gram(df: DataFrame, columns: dict[str, Column] | list[str]) -> Gram:
    """Two passes over complete rows: moments first, then centred and scaled products."""
    exprs = columns if isinstance(columns, dict) else {c: F.col(c) for c in columns}
    names = list(exprs)
    wide = df.select(*[e.cast("double").alias(f"x{i}") for i, e in enumerate(exprs.values())]).dropna()
    p = len(names)
    row = wide.agg(F.count(F.lit(1)).alias("n"),
                   *[f(f"x{i}").alias(f"{k}{i}") for i in range(p)
                     for k, f in (("m", F.avg), ("s", F.stddev_pop), ("lo", F.min), ("hi", F.max))]).first()
    n = row["n"]
    get = lambda k: np.array([row[f"{k}{i}"] if row[f"{k}{i}"] is not None else 0.0 for i in range(p)], dtype=float)
    mean, std = get("m"), get("s")
    std = np.where(std <= 1e-12 * np.maximum(np.abs(mean), 1e-300), 0.0, std)
    scale = np.where(std > 0, std, 1.0)
    corr = np.zeros((p, p))
    if n and p <= SQL_LIMIT:
        z = wide.select(*[((F.col(f"x{i}") - F.lit(float(mean[i]))) / F.lit(float(scale[i]))).alias(f"x{i}")
                          for i in range(p)])
        pairs = [(i, j) for i in range(p) for j in range(i, p)]
        sums = z.agg(*[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{k}") for k, (i, j) in enumerate(pairs)]).first()
        for k, (i, j) in enumerate(pairs):
            corr[i, j] = corr[j, i] = sums[k] / n
    elif n:
        mean_b, scale_b = mean.tolist(), scale.tolist()

        def partial(batches):
            total = np.zeros((p, p))
            for batch in batches:
                z = (batch.to_numpy(dtype=float) - mean_b) / scale_b
                total += z.T @ z
            i, j = np.triu_indices(p)
            yield pd.DataFrame({"i": i, "j": j, "s": total[i, j]})

        for r in (wide.mapInPandas(partial, "i int, j int, s double")
                  .groupBy("i", "j").agg(F.sum("s").alias("s")).collect()):
            corr[r["i"], r["j"]] = corr[r["j"], r["i"]] = r["s"] / n
    return Gram(names, n, mean, std, corr, get("lo"), get("hi"))
