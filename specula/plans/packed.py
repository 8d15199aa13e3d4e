"""Value counts by cell of the value range, folded inside the tasks and shuffled as packed runs.

A task folds its rows into counts per (value, level), cuts them at the cells' borders and hands on
one row per cell with packed arrays. So a hot value is one entry per chunk of rows, each entry is
shuffled once, and a cell needs no sorted window: the task that gets it puts its values in order.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specula.plans.ordered import MOST, MOST_CELLS
from specula.session import dealt, shuffle_width

CHUNK = 500_000  # rows that a task folds together
SAMPLE = 1_000   # sampled rows per cell, from which its borders are taken
PACKED = "g int, v int, bucket int, value binary, level binary, n binary"


def borders(df: DataFrame, columns: list[str], rows: int, most: int | None = None) -> list[np.ndarray]:
    """Cut points per column between which there are about ``most`` rows, beside those of one hot value.

    They are quantiles of a sample of rows; they balance the work, results do not depend on them.
    """
    cells = max(shuffle_width(df.sparkSession), min(MOST_CELLS, math.ceil(rows / (most or MOST))))
    if cells == 1:
        return [np.zeros(0) for _ in columns]
    known = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
    share = SAMPLE * cells / max(1, rows)
    part = df.sample(share, seed=7) if share < 1 else df
    row = part.agg(*[F.percentile_approx(known(c), [i / cells for i in range(1, cells)], 20 * cells).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    return [np.unique(np.array(row[i] or [], dtype=float)) for i in range(len(columns))]


def packed_counts(df: DataFrame, columns: list[str], levels: list[Column], width: int, kept: set[tuple[int, int, int]] | None = None) -> DataFrame:
    """(g, v, bucket, value, level, n): packed runs of counts per value of column v and level of g, dealt by their cells.

    ``levels`` are expressions with level numbers below ``width`` or null; rows with a null level or value are left out.
    ``kept`` (g, v, level) leaves other levels out. Buckets ascend with the value; NaN is the largest value.
    """
    rows = df.count()
    cuts, chunk = borders(df, columns, rows), CHUNK
    names = np.full((len(levels), len(columns), width + 1), -1)  # the last one stands for null, as index -1
    for g, v, i in np.ndindex(len(levels), len(columns), width):
        names[g, v, i] = i if kept is None or (g, v, i) in kept else -1
    wide = df.select(*[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(columns)],
                     *[F.coalesce(e.cast("int"), F.lit(-1)).alias(f"g{i}") for i, e in enumerate(levels)])

    def fold(batches):
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= chunk:
                yield from _runs(held, cuts, names)
                held, n = [], 0
        if n:
            yield from _runs(held, cuts, names)
    return dealt(wide.mapInArrow(fold, PACKED), rows * len(columns) * len(levels), "g", "v", "bucket")


def _runs(batches, cuts: list[np.ndarray], names: np.ndarray):
    """The packed runs of some rows: one Arrow batch per column and group."""
    import pyarrow as pa
    table = pa.Table.from_batches(batches).combine_chunks()
    numbers = [table.column(len(cuts) + g).to_numpy() for g in range(len(names))]
    width = names.shape[2] - 1
    for v, points in enumerate(cuts):
        column = table.column(v)
        known = np.flatnonzero(column.is_valid().to_numpy())
        value = column.fill_null(0.0).to_numpy()[known] + 0.0  # minus zero is zero
        order = np.argsort(value)
        value, order = value[order], known[order]
        new = firsts(value)
        run, value = np.cumsum(new) - 1, value[new]
        bucket = np.searchsorted(points, value, side="right")
        for g in range(len(names)):
            level = names[g, v][numbers[g][order]]
            key, n = np.unique((run * width + level)[level >= 0], return_counts=True)
            at = key // width
            starts = np.flatnonzero(firsts(bucket[at]))
            if len(starts):
                whole = lambda x: pa.array(np.full(len(starts), x, np.int32))
                yield pa.RecordBatch.from_arrays(
                    [whole(g), whole(v), pa.array(bucket[at[starts]].astype(np.int32)), _cut(value[at], starts),
                     _cut((key % width).astype(np.int32), starts), _cut(n.astype(np.int32), starts)], names=["g", "v", "bucket", "value", "level", "n"])


def _cut(array: np.ndarray, starts: np.ndarray):
    """``array`` as binary values that begin at ``starts``."""
    import pyarrow as pa
    offsets = (np.append(starts, len(array)) * array.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(array))])


def firsts(ascending: np.ndarray) -> np.ndarray:
    """Where a new value begins; NaN equals NaN."""
    new = np.ones(len(ascending), bool)
    new[1:] = (ascending[1:] != ascending[:-1]) & (ascending[:-1] == ascending[:-1])
    return new


def cell_counts(table, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(run, level, n) of a cell's packed runs, in order and each once; runs number the different values from 0."""
    whole = lambda name, kind: np.concatenate([np.frombuffer(x.as_py(), kind) for x in table.column(name)])
    value, level, n = whole("value", np.float64), whole("level", np.int32), whole("n", np.int32)
    order = np.argsort(value)
    run = np.cumsum(firsts(value[order])) - 1
    key, at = np.unique(run * width + level[order], return_inverse=True)
    return key // width, key % width, np.bincount(at, weights=n[order])
