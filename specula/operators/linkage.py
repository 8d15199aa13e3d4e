"""Ward's hierarchy of all rows by mergeable clustering features.

A clustering feature is a number of rows, their mean and the sum of squares around it; features of disjoint
rows add up. Each task folds its rows into at most ``leaves`` features on a grid that coarsens as needed, tasks'
features are folded in the same way until so many are left in all, and these are merged pair by pair
with the least growth of squares by nearest-neighbour chains. With no more different rows than leaves
the hierarchy is exact.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specula.session import settle

FEATURE = "n double, mean array<double>, squares double"


@dataclass
class Hierarchy:
    """Leaves (rows, means, squares inside) and the merges (one leaf of either side, growth of squares), least growth first."""
    n: object
    mean: object
    squares: object
    merges: list

    def labels(self, k: int) -> list[int]:
        """The group of each leaf when ``k`` are left; groups are numbered by falling size, then by their mean."""
        import numpy as np
        root = list(range(len(self.n)))

        def top(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i
        for a, b, _ in self.merges[:max(len(root) - k, 0)]:
            root[top(a)] = top(b)
        tops = np.array([top(i) for i in range(len(root))], np.int64)
        groups = []
        for t in set(tops.tolist()):
            mine = tops == t
            groups.append((-self.n[mine].sum(), tuple((self.n[mine][:, None] * self.mean[mine]).sum(0) / self.n[mine].sum()), t))
        place = {t: i for i, (_, _, t) in enumerate(sorted(groups))}
        return [place[t] for t in tops.tolist()]


def add_up(n, mean, squares, group):
    """Features added up by group number."""
    import numpy as np
    size = np.bincount(group, n)
    centre = np.stack([np.bincount(group, n * mean[:, j]) for j in range(mean.shape[1])], axis=1) / size[:, None]
    return size, centre, np.bincount(group, squares + n * ((mean - centre[group]) ** 2).sum(1))


def fold(n, mean, squares, leaves: int, width: float = 0.0):
    """(features, cell width): at most ``leaves`` features; equal means are always added up, others once they share a cell."""
    import numpy as np
    n, mean, squares = add_up(n, mean, squares, np.unique(mean, axis=0, return_inverse=True)[1].reshape(-1))
    while len(n) > leaves:
        width = width * 1.3 or np.ptp(mean, axis=0).max() / 1000
        cells = np.floor(mean / width)
        n, mean, squares = add_up(n, mean, squares, np.unique(cells, axis=0, return_inverse=True)[1].reshape(-1))
    return (n, mean, squares), width


def _record(n, mean, squares):
    import pyarrow as pa
    return pa.RecordBatch.from_arrays([pa.array(n, pa.float64()), pa.array(mean.tolist(), pa.list_(pa.float64())), pa.array(squares, pa.float64())], names=["n", "mean", "squares"])


def clustering_features(df: DataFrame, features: list[str], leaves: int = 512) -> DataFrame:
    """(n, mean, squares): at most ``leaves`` features of all complete, finite rows of ``df``."""
    def rows(batches):
        import numpy as np
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1).astype(np.float64)
            x = x[np.isfinite(x).all(axis=1)]
            yield np.ones(len(x)), x, np.zeros(len(x))

    def again(batches):
        import numpy as np
        for batch in batches:
            yield batch.column(0).to_numpy(), np.array(batch.column(1).to_pylist(), np.float64).reshape(batch.num_rows, -1), batch.column(2).to_numpy()

    def folded(parts):
        import numpy as np
        held, size, width = [], 0, 0.0
        for part in parts:
            if len(part[0]):
                held.append(part)
                size += len(part[0])
            if size > 20 * leaves:
                one, width = fold(*(np.concatenate(c) for c in zip(*held)), leaves, width)
                held, size = [one], len(one[0])
        if held:
            yield _record(*fold(*(np.concatenate(c) for c in zip(*held)), leaves, width)[0])
    wide = df.select(*[F.col(f"`{c}`").cast("double").alias(f"f{j}") for j, c in enumerate(features)]).dropna()
    found = settle(wide.mapInArrow(lambda batches: folded(rows(batches)), FEATURE))
    while (n := found.count()) > leaves:
        found = settle(found.repartition(math.ceil(n / (16 * leaves))).mapInArrow(lambda batches: folded(again(batches)), FEATURE))
    return found


def ward_merges(n, mean) -> list[tuple[int, int, float]]:
    """Ward's merges of weighted points by nearest-neighbour chains: (a point of one side, one of the other, growth of squares) by growth."""
    import numpy as np
    m = len(n)
    gap = ((mean[:, None, :] - mean[None, :, :]) ** 2).sum(2) * (n[:, None] * n[None, :] / (n[:, None] + n[None, :]))
    np.fill_diagonal(gap, np.inf)
    weight, live, chain, merges = n.astype(np.float64).copy(), np.ones(m, bool), [], []
    while len(merges) < m - 1:
        if not chain:
            chain = [int(np.flatnonzero(live)[0])]
        while True:
            here = chain[-1]
            near = int(np.argmin(gap[here]))
            if len(chain) > 1 and gap[here, chain[-2]] <= gap[here, near]:
                near = chain[-2]
                break
            chain.append(near)
        chain = chain[:-2]
        a, b, grown = here, near, gap[here, near]
        merges.append((a, b, float(grown)))
        others = live.copy()
        others[[a, b]] = False
        made = ((weight + weight[a]) * gap[a] + (weight + weight[b]) * gap[b] - weight * grown) / (weight + weight[a] + weight[b])
        gap[b] = np.where(others, made, np.inf)
        gap[:, b] = gap[b]
        gap[a] = gap[:, a] = np.inf
        weight[b] += weight[a]
        live[a] = False
    return sorted(merges, key=lambda x: x[2])


def ward(df: DataFrame, features: list[str], leaves: int = 512) -> Hierarchy:
    """The hierarchy of the complete rows of ``df`` over numeric columns; at most ``leaves`` features reach the driver."""
    import numpy as np
    rows = clustering_features(df, features, leaves).toPandas().sort_values("n", ascending=False)
    mean = np.array(rows["mean"].tolist(), np.float64).reshape(len(rows), len(features))
    n = rows["n"].to_numpy()
    return Hierarchy(n, mean, rows["squares"].to_numpy(), ward_merges(n, mean) if len(rows) else [])


def with_leaf(df: DataFrame, features: list[str], tree: Hierarchy, name: str = "leaf") -> DataFrame:
    """``df`` with the number of the nearest leaf of each row, null for incomplete rows."""
    held = df.sparkSession.sparkContext.broadcast((tree.mean, (tree.mean ** 2).sum(1)))

    @F.pandas_udf("int")
    def nearest(*columns):
        import numpy as np
        import pandas as pd
        mean, own = held.value
        x = np.stack([c.to_numpy(np.float64, na_value=np.nan) for c in columns], axis=1)
        out = np.full(len(x), -1)
        good = np.isfinite(x).all(axis=1)
        for at in range(0, len(x), 4096):
            part = np.flatnonzero(good[at:at + 4096]) + at
            if len(part) and len(mean):
                out[part] = np.argmin(own[None, :] - 2 * x[part] @ mean.T, axis=1)
        return pd.Series(out, dtype="Int32").mask(out < 0)
    return df.withColumn(name, nearest(*[F.col(f"`{c}`").cast("double") for c in features]))


def with_groups(df: DataFrame, features: list[str], k: int, leaves: int = 512, name: str = "segment") -> DataFrame:
    """``df`` with one of ``k`` groups of Ward's hierarchy for each complete row, the largest group first."""
    tree = ward(df, features, leaves)
    return with_leaf(df, features, tree, name).withColumn(name, F.get(F.lit(tree.labels(k) or [0]), F.col(name)))
