"""Exact ranks, running totals and quantiles without a global sort.

Spark's ``percentile`` keeps every distinct value of a group in one buffer and a window
without ``partitionBy`` puts the whole table in one task. Here rows are first collapsed to
value counts (so a hot value is one row), value ranges are spread over cells, and a cell's
start is the sum of the cells before it. Cells are cut at approximate quantiles and counted;
one with more than ``MOST`` different values is cut again at quantiles of its own values until
none is left, whatever the distribution. The cut points only balance the work; results do not
depend on them.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specula.plans.longform import numeric_long
from specula.session import settle, shuffle_width

MAX_CUTS = 32      # cut points per column that are compared one by one in the plan
PER_TASK = 4       # buckets per shuffle partition, so that hashing them spreads evenly
MOST = 1_000_000   # different values that a cell, and so a window task, may have
MOST_CELLS = 20_000  # cells per column; beyond that times MOST values, cells grow with the table


def bucket_count(df: DataFrame) -> int:
    return max(4, min(MAX_CUTS, PER_TASK * shuffle_width(df.sparkSession)))


def slices_for(df: DataFrame) -> int:
    """Equal slices inside each quantile range, once there are more tasks than cut points."""
    return max(1, math.ceil(PER_TASK * shuffle_width(df.sparkSession) / MAX_CUTS))


def cut_points(df: DataFrame, columns: list[str], buckets: int | None = None, most: int | None = None) -> dict[str, list[float]]:
    """Cut points per numeric column, between which there are at most ``most`` different values.

    Approximate quantiles of a tenth of the rows come first, as many as the number of rows asks
    for. Tables in which a cell could then have more than ``most`` rows are counted, and cells
    with too many different values are cut again.
    """
    most = most or MOST
    known = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
    part = df.sample(0.1, seed=7)

    def quantiles(n: int) -> tuple[int, dict[str, list[float]]]:
        shares = [i / n for i in range(1, n)]
        row = part.agg(F.count(F.lit(1)).alias("n"), *[F.percentile_approx(known(c), shares, 20 * n).alias(f"c{i}") for i, c in enumerate(columns)]).first()
        return row["n"] * 10, {c: sorted(set(row[f"c{i}"] or [])) for i, c in enumerate(columns)}
    n = buckets or bucket_count(df)
    rows, cuts = quantiles(n)
    if 2 * rows <= n * most:
        return cuts
    cuts = quantiles(min(MOST_CELLS, max(n, math.ceil(2 * rows / most))))[1]
    long = numeric_long(df, columns)
    while True:
        sizes = cell_sizes(long, cuts)
        large = {cell: values for cell, (_, values) in sizes.items() if values > max(1, 0.8 * max(most, rows / MOST_CELLS))}
        before, cuts = cuts, narrowed(long, cuts, large, most) if large else cuts
        if cuts == before:
            return cuts


def cell_sizes(long: DataFrame, cuts: dict[str, list[float]]) -> dict[tuple[str, int], tuple[int, int]]:
    """{(column, cell): (rows, about how many different values)} of an unpivoted table."""
    cells = long.withColumn("bucket", bucket_by_column(F.col("column"), F.col("value"), cuts))
    return {(r["column"], r["bucket"]): (r["n"], min(r["n"], r["values"])) for r in cells.groupBy("column", "bucket").agg(
        F.count(F.lit(1)).alias("n"), F.approx_count_distinct("value", 0.03).alias("values")).collect()}


def narrowed(long: DataFrame, cuts: dict[str, list[float]], large: dict[tuple[str, int], int], most: int) -> dict[str, list[float]]:
    """``cuts`` with more points inside the ``large`` cells {(column, cell): different values}.

    The points are quantiles of the cell's different values, so a value with most of the rows cannot hold them all.
    """
    cells = long.withColumn("bucket", bucket_by_column(F.col("column"), F.col("value"), cuts))
    wanted = F.lit(False)
    for c in {c for c, _ in large}:
        wanted |= (F.col("column") == c) & F.col("bucket").isin(sorted(b for name, b in large if name == c))
    pieces = min(500, max(4, math.ceil(2 * max(large.values()) / most)))
    shares = [i / pieces for i in range(1, pieces)]
    points = (cells.filter(wanted).select("column", "bucket", "value").distinct().groupBy("column", "bucket")
              .agg(F.percentile_approx("value", shares, 20 * pieces).alias("points")).collect())
    return {c: sorted({*bounds, *(x for r in points if r["column"] == c for x in r["points"])}) for c, bounds in cuts.items()}


def bucket_of(value: Column, bounds: list[float], slices: int = 1) -> Column:
    """An ascending bucket number: a balanced tree over the cut points, then equal slices.

    The slice index rises with the value, so buckets stay in order whatever the data. Many cut points
    are one literal in which the value is looked up by halving, and have no slices.
    """
    if len(bounds) > 2 * MAX_CUTS:
        points = F.lit([float(x) for x in bounds])
        start = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))  # the number of points up to the value lies between

        def halve(s: Column, _: Column) -> Column:
            mid = F.shiftright(s["lo"] + s["hi"], 1)
            above = (s["lo"] < s["hi"]) & (value < F.get(points, mid))
            return F.struct(F.when(above | (s["lo"] >= s["hi"]), s["lo"]).otherwise(mid + 1).alias("lo"), F.when(above, mid).otherwise(s["hi"]).alias("hi"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(len(bounds).bit_length())), start, halve, lambda s: s["lo"])

    def leaf(i: int) -> Column:
        if slices == 1 or i == 0 or i == len(bounds):
            return F.lit(i * slices)
        low, high = bounds[i - 1], bounds[i]
        part = F.floor((value - F.lit(low)) * F.lit(slices / (high - low))).cast("int")
        return F.lit(i * slices) + F.least(F.greatest(part, F.lit(0)), F.lit(slices - 1))

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return leaf(lo)
        mid = (lo + hi) // 2
        return F.when(value < F.lit(bounds[mid]), tree(lo, mid)).otherwise(tree(mid + 1, hi))
    return tree(0, len(bounds))


def bucket_by_column(name: Column, value: Column, cuts: dict[str, list[float]], slices: int = 1) -> Column:
    expr = F.lit(0)
    for column, bounds in cuts.items():
        expr = F.when(name == column, bucket_of(value, bounds, slices)).otherwise(expr)
    return expr


def running_totals(counts: DataFrame, keys: list[str], value: str, weights: list[str],
                   bucket: str = "bucket", few_keys: bool = False) -> DataFrame:
    """Add ``before_<w>`` (sum of w at smaller values) and ``total_<w>`` per key.

    ``counts`` has one row per (keys, bucket, value); buckets ascend with the value. With
    ``few_keys`` the keys come from the plan (columns, pairs of columns), so there are at most
    keys x buckets starting points and they are broadcast; keys from the data join by shuffle.
    """
    per_bucket = counts.groupBy(*keys, bucket).agg(*[F.sum(w).alias(w) for w in weights])
    upto = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)  # bucket rows only
    starts = per_bucket.select(*keys, bucket, *[c for w in weights for c in (
        (F.sum(w).over(upto) - F.col(w)).alias(f"start_{w}"), F.sum(w).over(whole).alias(f"total_{w}"))])
    inside = (Window.partitionBy(*keys, bucket).orderBy(value)
              .rowsBetween(Window.unboundedPreceding, 0))
    joined = counts.join(F.broadcast(starts) if few_keys else starts, [*keys, bucket])
    return joined.select(*counts.columns, *[c for w in weights for c in (
        (F.col(f"start_{w}") + F.sum(w).over(inside) - F.col(w)).alias(f"before_{w}"),
        F.col(f"total_{w}"))])


def range_cells(counts: DataFrame, order: list[str], rows: int) -> DataFrame:
    """Add ``bucket``, ascending along ``order``, to value counts of a table of at most ``rows`` entries.

    The range exchange samples the different values, not the rows, so no cell holds much more than
    ``MOST`` of them; rows are placed after they are collapsed, and no row is compared with cut points.
    """
    pieces = max(shuffle_width(counts.sparkSession), math.ceil(rows / MOST))
    return settle(counts.repartitionByRange(pieces, *order).withColumn("bucket", F.spark_partition_id()))


def ranked_counts(df: DataFrame, columns: list[str], keys: list[str] | None = None) -> DataFrame:
    """(column, keys, value, n, before_n, total_n) for numeric columns; ranks run per column and key."""
    keys = keys or []
    counts = numeric_long(df, columns, keys).groupBy("column", *keys, "value").agg(F.count(F.lit(1)).alias("n"))
    placed = range_cells(counts, ["column", "value"], df.count() * len(columns))
    return running_totals(placed, ["column", *keys], "value", ["n"], few_keys=not keys)


def average_rank() -> Column:
    """Average rank of a value from its ranked count row."""
    return F.col("before_n") + (F.col("n") + 1) / 2.0


def quantile_columns(probs: list[float], names: list[str], value: str = "value",
                     n: str = "n", before: str = "before_n", total: str = "total_n") -> list[Column]:
    """Aggregates over ranked counts: linear interpolation between order statistics."""
    out = []
    last = F.col(before) + F.col(n)
    for q, name in zip(probs, names):
        spot = F.lit(q) * (F.col(total) - 1)
        low = F.min(F.when(last > F.floor(spot), F.col(value)))
        high = F.min(F.when(last > F.ceil(spot), F.col(value)))
        part = F.max(spot - F.floor(spot))
        out.append((low + part * (high - low)).alias(name))
    return out


def exact_quantiles(df: DataFrame, columns: list[str], probs: list[float]) -> dict[str, list[float | None]]:
    """Exact quantiles as fitted parameters: {column: [value per prob]}.

    Three scans, and only the buckets that hold a wanted order statistic are shuffled.
    """
    totals, found = order_statistics(df, columns, lambda total: {
        f(q * (total - 1)) for q in probs for f in (math.floor, math.ceil)})
    out: dict[str, list[float | None]] = {}
    for c in columns:
        values: list[float | None] = []
        for q in probs:
            if not totals[c]:
                values.append(None)
                continue
            spot = q * (totals[c] - 1)
            low, high = found[(c, math.floor(spot))][0], found[(c, math.ceil(spot))][0]
            values.append(low + (spot - math.floor(spot)) * (high - low))
        out[c] = values
    return out


def order_statistics(df: DataFrame, columns: list[str], ranks_of, most: int | None = None) -> tuple[dict, dict]:
    """({column: rows}, {(column, rank): (value, rows before that value)}) for 0-based ranks.

    ``ranks_of(rows)`` names the wanted ranks once the number of rows is known. Selection by
    repeated counting: only cells that hold a wanted rank are cut further, until each has at most
    ``most`` different values; these alone are collapsed to counts and put in order.
    """
    most = most or MOST
    known = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
    n = max(32, bucket_count(df))
    row = df.sample(0.1, seed=7).agg(*[F.percentile_approx(known(c), [i / n for i in range(1, n)], 20 * n).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    cuts = {c: sorted(set(row[f"c{i}"] or [])) for i, c in enumerate(columns)}
    long = numeric_long(df, columns)
    while True:
        sizes = cell_sizes(long, cuts)
        totals = {c: sum(rows for (name, _), (rows, _) in sizes.items() if name == c) for c in columns}
        spots = []
        for c in columns:
            ranks = sorted(k for k in ranks_of(totals[c]) if 0 <= k < totals[c])
            begin = 0
            for b in sorted(b for name, b in sizes if name == c):
                rows = sizes[c, b][0]
                spots += [(c, b, k, begin) for k in ranks if begin <= k < begin + rows]
                begin += rows
        large = {(c, b): sizes[c, b][1] for c, b, _, _ in spots if sizes[c, b][1] > max(1, 0.8 * most)}
        before, cuts = cuts, narrowed(long, cuts, large, most) if large else cuts
        if cuts == before:
            break
    if not spots:
        return totals, {}
    long = long.withColumn("bucket", bucket_by_column(F.col("column"), F.col("value"), cuts))
    keep = F.lit(False)
    for c in columns:
        buckets = {b for name, b, _, _ in spots if name == c}
        if buckets:
            keep = keep | ((F.col("column") == c) & F.col("bucket").isin(sorted(buckets)))
    counts = long.filter(keep).groupBy("column", "bucket", "value").agg(F.count(F.lit(1)).alias("n"))
    inside = Window.partitionBy("column", "bucket").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    table = df.sparkSession.createDataFrame(spots, "column string, bucket int, rank long, start long")
    hits = (counts.withColumn("last", F.sum("n").over(inside)).join(F.broadcast(table), ["column", "bucket"])
            .filter((F.col("start") + F.col("last") > F.col("rank"))
                    & (F.col("start") + F.col("last") - F.col("n") <= F.col("rank"))))
    found = {(r["column"], r["rank"]): (r["value"], r["start"] + r["last"] - r["n"])
             for r in hits.select("column", "rank", "value", "start", "last", "n").collect()}
    return totals, found


def text_cells(distinct: DataFrame, value: str, most: int = 100_000) -> DataFrame:
    """Add ``bucket``, ascending with a text column of different values: about ``most`` rows each.

    Cut points are sampled by the range exchange, so texts with one common beginning are cut as well.
    """
    pieces = max(1, math.ceil(distinct.count() / most))
    return settle(distinct.repartitionByRange(pieces, value).withColumn("bucket", F.spark_partition_id()))


def spread_lookup(rows: DataFrame, table: DataFrame, keys: list[str], take: list[str],
                  size: str, hot_share: float = 0.001) -> DataFrame:
    """Left-join ``table`` (unique on keys, ``size`` = rows per key) without a hot shuffle key.

    Keys holding more than ``hot_share`` of a column's rows are at most 1/hot_share per
    column: they go by broadcast, and so does a rest of at most as many. Otherwise all other keys
    are small and go by shuffle, in tasks of about ``MOST`` rows. The table is written once, since
    both ways read it.
    """
    total = Window.partitionBy(keys[0])
    whole = F.col("total_n") if "total_n" in table.columns else F.sum(size).over(total)
    marked = settle(table.select(*keys, *take, F.col(size).alias("_size"), (F.col(size) > hot_share * whole).alias("_hot")))
    seen = marked.agg(F.sum("_size").alias("rows"), F.count_if(~F.col("_hot")).alias("rest")).first()
    if seen["rest"] <= 1 / hot_share:
        return rows.join(F.broadcast(marked.select(*keys, *take)), keys, "left").select(*rows.columns, *take)
    hot = marked.filter("_hot").select(*keys, *[F.col(t).alias(f"_hot_{t}") for t in take])
    cold = marked.filter("NOT _hot").select(*keys, F.lit(0).alias("_salt"), *take)
    flagged = rows.join(F.broadcast(hot), keys, "left")
    flagged = flagged.withColumn("_salt", F.when(F.col(f"_hot_{take[0]}").isNull() & reduce(Column.__and__, [F.col(k).isNotNull() for k in keys]), F.lit(0))
                                 .otherwise(1 + F.pmod(F.xxhash64(*rows.columns), F.lit(512)).cast("int")))
    pieces = math.ceil(seen["rows"] / MOST)
    if pieces > shuffle_width(rows.sparkSession):
        # dealt by one hash, since a join deals fractions by a normal form of its own, so once more and in the usual number of tasks
        dealt = lambda d: d.withColumn("_hash", F.xxhash64(*keys, "_salt")).repartition(pieces, "_hash")
        cold = dealt(cold).select(*[F.col(c).alias(f"_cold{c}") for c in ("_hash", *keys)], *take).hint("merge")
        same = [(F.col(k) <= F.col(f"_cold{k}")) & (F.col(k) >= F.col(f"_cold{k}")) for k in keys]
        joined = dealt(flagged).join(cold, reduce(Column.__and__, same, F.col("_hash") == F.col("_cold_hash")), "left")
    else:
        joined = flagged.join(cold, [*keys, "_salt"], "left")
    return joined.select(*rows.columns, *[F.coalesce(f"_hot_{t}", t).alias(t) for t in take])


def previous_value(distinct: DataFrame, keys: list[str], value: str, bucket: str = "bucket") -> DataFrame:
    """Add ``prev_<value>``: the next smaller value per key, across bucket borders.

    A bucket's first row takes the largest value of the nearest earlier bucket.
    """
    ends = distinct.groupBy(*keys, bucket).agg(F.max(value).alias("_top"))
    by = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    ends = ends.withColumn("_edge", F.lag("_top").over(by.orderBy(bucket))).drop("_top")
    inside = Window.partitionBy(*keys, bucket).orderBy(value)
    return (distinct.join(ends, [*keys, bucket])
            .withColumn(f"prev_{value}", F.coalesce(F.lag(value).over(inside), F.col("_edge")))
            .drop("_edge"))
