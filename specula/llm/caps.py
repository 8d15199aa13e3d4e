"""Near-duplicate vectors by spherical-cap filters.

A product code gives many filter directions from few: after a fixed random rotation the
dimensions form blocks, each with a small random code, and every combination of block codes is a
direction. List decoding extends a vector block by block and drops what cannot reach the cap any more, so it
finds all directions whose cap holds the vector without listing the code. Vectors meet in the filters they share and
are compared there, in double precision.

Filters are dealt out by their leading block codes: a vector travels once for each leading part,
as floats where these are exact, and meets others under the whole filters there. A part with many vectors is split into blocks, and each pair of
blocks is a task of bounded size. Within a task a pair counts only under the smallest filter that both have, so
nothing is counted twice and no pairs leave the task: it returns link counts and a spanning forest.
Equal vectors are one vector with a weight.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specula.llm._links import components as connected_components
from specula.llm._worker import once, slices
from specula.llm.bpe import _q
from specula.session import settle

BLOCKS, LEAD = 4, 2


class Code:
    """Directions of a dimension: a rotation, ``size`` unit vectors for each block, and the cap that about ``listed`` of them have."""

    def __init__(self, dim: int, size: int, listed: int):
        import numpy as np
        draw = np.random.default_rng([dim, size])
        self.size = size
        self.turn = np.linalg.qr(draw.normal(size=(dim, dim)))[0]
        self.parts = np.array_split(np.arange(dim), min(BLOCKS, dim))
        self.codes = []
        for part in self.parts:
            code = draw.normal(size=(size, len(part)))
            self.codes.append(code / np.linalg.norm(code, axis=1, keepdims=True) / np.sqrt(len(self.parts)))
        trial = draw.normal(size=(512, dim))
        trial /= np.linalg.norm(trial, axis=1, keepdims=True)
        every = np.concatenate([s.ravel() for s in self._dense(trial)])
        self.cap = float(np.quantile(every, max(0.0, 1 - listed / size ** len(self.parts))))

    def _blocks(self, unit):
        turned = unit @ self.turn
        return [turned[:, p] @ c.T for p, c in zip(self.parts, self.codes)]

    def _dense(self, unit):
        """Scores of random directions: a fixed draw of the code, enough for its quantile."""
        import numpy as np
        pick = np.random.default_rng(self.size).integers(0, self.size, (4096, len(self.parts)))
        yield sum(b[:, pick[:, i]] for i, b in enumerate(self._blocks(unit)))

    def decode(self, unit, least: int):
        """For each unit vector the sorted directions within the cap, or its ``least`` best if that is more."""
        import numpy as np
        blocks = self._blocks(unit)
        rest = np.cumsum([b.max(axis=1) for b in blocks][::-1], axis=0)[::-1]
        found: list = [None] * len(unit)
        todo, cap = np.arange(len(unit)), self.cap
        least = min(least, self.size ** len(blocks))
        while len(todo):
            who, code, score = todo, np.zeros(len(todo), np.int64), np.zeros(len(todo))
            for i, b in enumerate(blocks):
                grown = score[:, None] + b[who]
                ahead = rest[i + 1][who][:, None] if i + 1 < len(blocks) else 0.0
                row, digit = np.nonzero(grown + ahead >= cap)
                who, code, score = who[row], code[row] * self.size + digit, grown[row, digit]
            order = np.lexsort((-score, who))
            who, code, score = who[order], code[order], score[order]
            at = np.searchsorted(who, todo)
            end = np.searchsorted(who, todo, side="right")
            short = []
            for v, a, b in zip(todo, at, end):
                if b - a < least and cap > -2:
                    short.append(v)
                else:
                    n = max(least, int((score[a:b] >= self.cap).sum()))
                    found[v] = np.sort(code[a:a + n])
            todo, cap = np.array(short, np.int64), cap - 0.05
        return found


def links(vectors: DataFrame, vec_id: str, embedding: str, label: str, least_cosine: float = 0.98,
          listed: int = 40, least: int = 28, per_filter: int = 48, block: int = 4096) -> DataFrame:
    """(id, n_links, component): for each vector how many others it links with, and the smallest id it is connected to.

    Vectors link when their labels are equal and not null and their cosine is at least
    ``least_cosine``. Null, empty, zero vectors and those with null or non-finite components, vectors without label and rows
    without id link with nothing and are their own component; vectors of different lengths do not
    link. Repeated vectors count as others, repeated ids once each per row. ``listed`` and ``least`` say how many
    filters a vector has. Random pairs at exactly the least cosine share none about once in 10,000 pairs with the
    defaults (README has the figures); closer pairs less often.
    """
    spark = vectors.sparkSession
    kind = vectors.select(_q(vec_id)).schema[0].dataType.simpleString()
    rows = vectors.select(_q(vec_id).alias("id"), _q(label).alias("label"), _q(embedding).cast("array<double>").alias("v"))
    # a dot product of finite components may still overflow: such vectors are scaled by their largest component
    big = F.array_max(F.transform("v", lambda x: F.abs(x)))
    fine = (F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
            & (big > 0))
    held = settle(rows.select("id", "label", F.when(fine, F.col("v")).alias("v")).withColumn("same", F.when(F.col("v").isNotNull(), F.xxhash64("label", "v"))))
    # copies: the digest names them, the values decide
    kept = settle(held.filter("v IS NOT NULL").groupBy("same", "label", "v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("weight")))
    total = kept.count()
    size = max(2, round((total / per_filter) ** (1 / BLOCKS)))
    label_kind = kept.schema["label"].dataType.simpleString()

    def decode(batches):
        import numpy as np
        import pyarrow as pa
        for batch in slices(batches, 512):
            lead, row, lists, units, dims = [], [], [], [], []
            values = batch.column(2).to_pylist()
            for d in sorted({len(v) for v in values}):
                code = once(("caps", d, size, listed), lambda: Code(d, size, listed))
                at = [i for i, v in enumerate(values) if len(v) == d]
                given = np.array([values[i] for i in at])
                tail = size ** max(0, len(code.parts) - LEAD)
                for i, u, found in zip(at, given, code.decode(_unit(given), least)):
                    with np.errstate(over="ignore", under="ignore"):
                        single, data = u.astype(np.float32), found.astype(np.int32)
                    packed = (single if (single == u).all() else u).tobytes()
                    for part in np.unique(found // tail).tolist():
                        lead.append(part)
                        row.append(i)
                        lists.append(data[:np.searchsorted(found, (part + 1) * tail)].tobytes())  # later ones are never asked for
                        units.append(packed)
                        dims.append(d)
            row = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), pa.array(dims, pa.int32()),
                                              pa.array(lead, pa.int64()), batch.column(3).take(row), pa.array(lists, pa.binary()), pa.array(units, pa.binary())],
                                             names=["id", "label", "dim", "lead", "weight", "filters", "vector"])

    sent = kept.select("id", "label", "v", "weight").mapInArrow(
        decode, f"id {kind}, label {label_kind}, dim int, lead bigint, weight bigint, filters binary, vector binary")
    keys = ["label", "dim", "lead"]
    # only crowded parts are split; how many parts there are is bounded by the code and the labels counted
    crowded = settle(sent.groupBy(*keys).count().filter(F.col("count") > block).select(*keys, F.ceil(F.col("count") / block).cast("int").alias("blocks")))
    dealt = (sent.join(crowded, keys, "left") if crowded.count() else sent.withColumn("blocks", F.lit(None).cast("int")))
    many = F.coalesce("blocks", F.lit(1))
    mine = F.pmod(F.xxhash64("id"), many).cast("int")
    dealt = (dealt.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), many - 1)))
             .select("id", "label", "dim", "lead", "weight", "filters", "vector", "mine", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high")))

    def meet(key, table):
        import numpy as np
        import pyarrow as pa
        low, high = key[3].as_py(), key[4].as_py()
        dim = key[1].as_py()
        ids = table.column("id").to_pylist()
        weight = table.column("weight").to_numpy()
        unit = _unit(np.array([np.frombuffer(x, np.float32 if len(x) == 4 * dim else np.float64) for x in table.column("vector").to_pylist()], np.float64))
        filters = [np.frombuffer(x, np.int32) for x in table.column("filters").to_pylist()]
        side = table.column("mine").to_numpy()
        tail = size ** max(0, min(BLOCKS, dim) - LEAD)
        first = key[2].as_py() * tail
        number = np.concatenate(filters)
        owner = np.repeat(np.arange(len(filters)), [len(f) for f in filters])
        here = (number >= first) & (number < first + tail)
        number, owner = number[here], owner[here]
        order = np.lexsort((owner, number))
        number, owner = number[order], owner[order]
        degree = np.zeros(len(ids), np.int64)
        root = np.arange(len(ids))

        def top(i):
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(number)) + 1, [len(number)]])
        for a, b in zip(cuts[:-1], cuts[1:]):
            members = owner[a:b]
            x, y = (members, members) if low == high else (members[side[members] == low], members[side[members] == high])
            if not len(x) or not len(y):
                continue
            for s in range(0, len(x), 1024):
                xs = x[s:s + 1024]
                hit = unit[xs] @ unit[y].T >= least_cosine
                if low == high:
                    hit &= y[None, :] > xs[:, None]
                p, q = np.flatnonzero(hit.any(axis=1)), np.flatnonzero(hit.any(axis=0))
                if not len(p):
                    continue
                hit = hit[np.ix_(p, q)]
                # filters of another part may come before the first of this one
                hit &= _no_earlier([filters[i] for i in xs[p]], [filters[i] for i in y[q]], number[a])
                if not hit.any():
                    continue
                degree[xs[p]] += hit @ weight[y[q]]
                degree[y[q]] += weight[xs[p]] @ hit
                for i, j in zip(*_forest(hit)):
                    u, v = top(xs[p[i]]), top(y[q[j]])
                    if u != v:
                        root[max(u, v)] = min(u, v)
        met = np.flatnonzero(degree)
        return pa.table({"id": [ids[i] for i in met], "n": pa.array(degree[met], pa.int64()), "parent": [ids[top(i)] for i in met]},
                        schema=pa.schema([table.schema.field("id"), ("n", pa.int64()), table.schema.field("id").with_name("parent")]))

    part = settle(dealt.groupBy("label", "dim", "lead", "low", "high").applyInArrow(meet, f"id {kind}, n bigint, parent {kind}"))
    degree = part.groupBy("id").agg(F.sum("n").alias("n"))
    edges = part.select("id", "parent").filter("id <> parent")
    groups = kept.select("same", "label", "v", F.col("id").alias("first"), "weight").join(degree.withColumnRenamed("id", "first"), "first", "left")
    if edges.limit(1).count():
        groups = groups.join(connected_components(edges, "id", "parent").withColumnRenamed("node", "first"), "first", "left")
    else:
        groups = groups.withColumn("component", F.lit(None).cast(kind))
    groups = settle(groups.select("same", "label", "v", F.coalesce("component", "first").alias("component"),
                                  (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links")))
    return held.join(groups, ["same", "label", "v"], "left").select(
        "id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component", "id").alias("component"))


def _unit(given):
    """Rows of length one; scaled by the largest component first, as a dot product of finite ones may overflow."""
    import numpy as np
    scaled = given / np.abs(given).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _no_earlier(left, right, number):
    """Pairs of filter lists without a common filter below ``number``."""
    import numpy as np
    cut_l, cut_r = [x[x < number] for x in left], [x[x < number] for x in right]
    known = np.unique(np.concatenate([*cut_l, *cut_r]))
    if not len(known):
        return np.ones((len(left), len(right)), bool)

    def table(lists):
        m = np.zeros((len(lists), len(known)), np.float32)
        for i, x in enumerate(lists):
            m[i, np.searchsorted(known, x)] = 1
        return m
    return table(cut_l) @ table(cut_r).T == 0


def _forest(hit):
    """Pairs that connect what the pairs of ``hit`` connect: of each component all columns with one row and all rows with one column."""
    import numpy as np
    out_rows, out_cols = [], []
    left = hit.any(axis=1)
    while left.any():
        start = int(left.argmax())
        cols = hit[start].copy()
        rows = np.zeros(len(left), bool)
        while True:
            grown = hit[:, cols].any(axis=1)
            if (grown == rows).all():
                break
            rows = grown
            cols |= hit[rows].any(axis=0)
        r, c = np.flatnonzero(rows), np.flatnonzero(cols)
        out_rows += [r, np.full(len(c), start)]
        out_cols += [np.full(len(r), c[0]), c]
        left &= ~rows
    return np.concatenate(out_rows), np.concatenate(out_cols)
