"""Sums of many repetitions over all rows without a row per repetition.

A row's two numbers a and b come from one md5 of its id and the seed; its draw in repetition r is
(a + b r) mod 2^31 - 1. Over rows the draws of one repetition are independent, and those of two
repetitions are as well, which is what shares and quantiles over repetitions need. A task draws for
its rows and all repetitions at once and hands on one row per repetition, so what is shuffled is
tasks times repetitions, whatever the number of rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MODULUS = 2**31 - 1
CELLS = 1 << 20  # draws held at once by a task


def draws(row_id: str, seed: int) -> tuple[Column, Column]:
    """The numbers a and b of a row: the first and second eight hexadecimal digits of md5('<id>:<seed>')."""
    digest = F.md5(F.concat(F.col(row_id).cast("string"), F.lit(f":{seed}")))
    number = lambda start: F.conv(F.substring(digest, start, 8), 16, 10).cast("long") % F.lit(MODULUS)
    return number(1), number(9)


def poisson_limits() -> list[int]:
    """A draw's weight is the number of these limits it reaches: Poisson with mean one, to the draw's resolution."""
    total, limits = 0.0, []
    for k in range(20):
        total += math.exp(-1) / math.factorial(k)
        limits.append(math.ceil(total * MODULUS))
    return [x for x in limits if x < MODULUS]


def poisson_sums(rows: DataFrame, row_id: str, value: str, reps: int, seed: int) -> DataFrame:
    """(rep, n, s): the sum of weights and of weighted values in repetitions 1 to ``reps``."""
    limits = poisson_limits()

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s = np.zeros(reps), np.zeros(reps)
        for y, u in _blocks(batches, np.arange(1, reps + 1)):
            weight = np.zeros(u.shape, dtype=np.int8)
            for limit in limits:
                weight += u >= limit
            n += weight.sum(axis=0)
            s += y @ weight
        yield pd.DataFrame({"rep": np.arange(1, reps + 1), "n": n, "s": s})

    a, b = draws(row_id, seed)
    return (rows.select(F.col(value).alias("y"), a.alias("a"), b.alias("b")).mapInPandas(fold, "rep long, n double, s double")
            .groupBy("rep").agg(F.sum("n").alias("n"), F.sum("s").alias("s")))


def coin_sums(rows: DataFrame, row_id: str, value: str, side: str, share: float, reps: int, seed: int) -> DataFrame:
    """(rep, n1, s1, n0, s0): rows and sums of both sides; 0 has ``side`` itself, 1 to ``reps`` coins of that share."""
    limit = share * MODULUS

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n1, s1, n, s = np.zeros(reps + 1), np.zeros(reps + 1), 0, 0.0
        for y, u, g in _blocks(batches, np.arange(reps + 1), "g"):
            first = u < limit
            first[:, 0] = g == 1
            n1 += first.sum(axis=0)
            s1 += y @ first
            n, s = n + len(y), s + y.sum()
        yield pd.DataFrame({"rep": np.arange(reps + 1), "n1": n1, "s1": s1, "n0": n - n1, "s0": s - s1})

    a, b = draws(row_id, seed)
    sums = ["n1", "s1", "n0", "s0"]
    return (rows.select(F.col(value).alias("y"), a.alias("a"), b.alias("b"), F.col(side).alias("g"))
            .mapInPandas(fold, "rep long, n1 double, s1 double, n0 double, s0 double")
            .groupBy("rep").agg(*[F.sum(c).alias(c) for c in sums]))


def _blocks(batches: Iterator[pd.DataFrame], numbers: np.ndarray, *more: str) -> Iterator[tuple]:
    """(values, draws of rows by repetitions, further columns) for a bounded number of rows at a time."""
    step = max(1, CELLS // max(1, len(numbers)))
    for batch in batches:
        columns = [batch[c].to_numpy() for c in ("y", "a", "b", *more)]
        for at in range(0, len(batch), step):
            y, a, b, *rest = (c[at:at + step] for c in columns)
            yield y, (a[:, None] + b[:, None] * numbers[None, :]) % MODULUS, *rest
