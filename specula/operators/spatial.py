"""Local metric projection, neighbours, autocorrelation, clusters and spatial joins.

Points first collapse to locations, so copies of one place are one row. Neighbour searches
run on a grid; cells that lie wholly inside a radius are counted as cells, never as pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specula.plans.components import connected_components
from specula.plans.ordered import exact_quantiles, spread_lookup
from specula.plans.sequence import with_position
from specula.session import settle, shuffle_width

# Earth radii in metres used by the analysis and by the shaping steps.
EARTH_ANALYSIS = 6371000.0
EARTH_SHAPING = 6371008.8

FEW = 1000        # probes that may be broadcast to every task
DENSE = 64        # locations per cell that a search starts from
BLOCK = 5000      # points of a block whose values in all repetitions a task holds
BUCKET = 50_000   # most rows of a repetition that are put in order at once, about
DEALT = 2_000_000  # dealt values per task; pairs that are compared at once
SIDE = 64         # cells along a block whose clusters a task finds
HALO = 4          # cells around it that the task sees: those within reach and what these reach
BUNDLE = 50_000   # locations of the blocks that are worked on at once, about
CROWDED = 16      # locations of a cell that its block sees one by one, at least
DEEPEST = 12      # times that boxes of a cell are cut in 16


def coordinate_sanity(df: DataFrame, lat: str, lon: str) -> DataFrame:
    """Out-of-range values, a suspected axis swap, and duplicate locations."""
    la, lo = F.col(lat).cast("double"), F.col(lon).cast("double")
    places = df.select(la.alias("la"), lo.alias("lo")).groupBy("la", "lo").agg(F.count(F.lit(1)).alias("k"))
    n, both = F.col("k"), F.col("la").isNotNull() & F.col("lo").isNotNull()
    return places.agg(
        F.sum(F.when(both, n).otherwise(0)).alias("n"),
        F.sum(F.when(~F.col("la").between(-90, 90), n).otherwise(0)).alias("lat_out_of_range"),
        F.sum(F.when(~F.col("lo").between(-180, 180), n).otherwise(0)).alias("lon_out_of_range"),
        ((F.max(F.abs("la")) > 90) & (F.max(F.abs("lo")) <= 90)).alias("axis_swap_suspected"),
        F.sum(F.when(both, n - 1).otherwise(0)).alias("duplicate_locations"))


def centroid(df: DataFrame, lat: str, lon: str) -> tuple[float, float]:
    row = df.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull()).agg(F.avg(lat).alias("a"), F.avg(lon).alias("b")).first()
    return float(row["a"]), float(row["b"])


def project(lat: Column, lon: Column, centre: tuple[float, float], radius: float = EARTH_ANALYSIS) -> tuple[Column, Column]:
    """Equirectangular metres about a centre."""
    lat0, lon0 = centre
    x = F.radians(lon.cast("double") - lon0) * radius * math.cos(math.radians(lat0))
    y = F.radians(lat.cast("double") - lat0) * radius
    return x, y


def projected(df: DataFrame, row_id: str, lat: str, lon: str, radius: float = EARTH_ANALYSIS) -> DataFrame:
    """(id, part, _x, _y) of rows with both coordinates."""
    known = df.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull())
    x, y = project(F.col(lat), F.col(lon), centroid(known, lat, lon), radius)
    return known.select(F.col(row_id).alias("id"), F.lit("all").alias("part"), x.alias("_x"), y.alias("_y"))


def bearing(x: Column, y: Column, x0: Column, y0: Column) -> Column:
    """Degrees clockwise from north, from the point to the reference."""
    return F.pmod(F.degrees(F.atan2(x0 - x, y0 - y)) + 360.0, F.lit(360.0))


def cell_id(x: Column, y: Column, size: float) -> Column:
    return F.concat(F.floor(x / size).cast("string"), F.lit("_"), F.floor(y / size).cast("string"))


def locations(points: DataFrame) -> DataFrame:
    """(part, _x, _y, m): distinct places and how many points share each."""
    return points.groupBy("part", "_x", "_y").agg(F.count(F.lit(1)).alias("m"))


# ------------------------------------------------------------------ counting within a radius

def neighbours_within(points: DataFrame, radius: float) -> DataFrame:
    """(id, n): other points of the same part within the radius.

    Two cells whose farthest corners are within the radius count each other as cells; only
    cell pairs cut by the circle compare locations. Denser data gets finer cells.
    """
    places = locations(points)  # files of points are small for their rows: planned by these, joins would send them through the driver
    coarse = places.groupBy("part", F.floor(F.col("_x") / radius), F.floor(F.col("_y") / radius)).agg(F.count(F.lit(1)).alias("k"))
    crowd = coarse.agg(F.max("k")).first()[0] or 1
    fine = max(1, min(12, math.ceil(math.sqrt(crowd / 16))))
    size = radius / fine
    celled = places.select("*", F.floor(F.col("_x") / size).alias("cx"), F.floor(F.col("_y") / size).alias("cy"))
    cells = celled.groupBy("part", "cx", "cy").agg(F.sum("m").alias("k"))
    inside, cut = [], []
    reach = fine + 1
    for dx in range(-reach, reach + 1):
        for dy in range(-reach, reach + 1):
            far = size * math.hypot(abs(dx) + 1, abs(dy) + 1)
            near = size * math.hypot(max(abs(dx) - 1, 0), max(abs(dy) - 1, 0))
            if far <= radius:
                inside.append((dx, dy))
            elif near <= radius:
                cut.append((dx, dy))
    offsets = lambda pairs: F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a, b in pairs])
    totals = []
    if inside:
        moved = cells.select("part", "cx", "cy", F.inline(offsets(inside))).select(
            "part", "cx", "cy", (F.col("cx") + F.col("dx")).alias("ox"), (F.col("cy") + F.col("dy")).alias("oy"))
        other = cells.select("part", F.col("cx").alias("ox"), F.col("cy").alias("oy"), "k").hint("merge")
        whole = moved.join(other, ["part", "ox", "oy"]).groupBy("part", "cx", "cy").agg(F.sum("k").alias("s"))
        totals.append(celled.join(whole.hint("merge"), ["part", "cx", "cy"]).select("part", "_x", "_y", "s"))
    probes = celled.select("part", "_x", "_y", "cx", "cy", F.inline(offsets(cut))).select(
        "part", "_x", "_y", (F.col("cx") + F.col("dx")).alias("cx"), (F.col("cy") + F.col("dy")).alias("cy"))
    others = celled.select("part", "cx", "cy", F.col("_x").alias("ox"), F.col("_y").alias("oy"), "m").hint("merge")
    close = F.hypot(F.col("_x") - F.col("ox"), F.col("_y") - F.col("oy")) <= radius
    totals.append(probes.join(others, ["part", "cx", "cy"]).filter(close).groupBy("part", "_x", "_y").agg(F.sum("m").alias("s")))
    found = totals[0]
    for t in totals[1:]:
        found = found.union(t)
    sums = found.groupBy("part", "_x", "_y").agg(F.sum("s").alias("s")).join(places.hint("merge"), ["part", "_x", "_y"])
    counted = _at_places(points, sums.select("part", "_x", "_y", "m", "s"), ["s"])
    return counted.select("id", (F.col("s") - 1).alias("n"))


def _at_places(points: DataFrame, table: DataFrame, take: list[str]) -> DataFrame:
    """Bring values of places back to their points; a crowded place does not become a hot key."""
    total = table.agg(F.sum("m").alias("total_n"))
    return spread_lookup(points, table.join(F.broadcast(total), F.lit(True)), ["part", "_x", "_y"], take, "m")


# ------------------------------------------------------------------ nearest neighbours

def _start_size(sites: DataFrame) -> float:
    row = sites.agg(F.count(F.lit(1)).alias("n"), F.max("_x").alias("x1"), F.min("_x").alias("x0"),
                    F.max("_y").alias("y1"), F.min("_y").alias("y0")).first()
    wide = max(row["x1"] - row["x0"], row["y1"] - row["y0"], 1e-6)
    size = max(2 * math.sqrt(max((row["x1"] - row["x0"]) * (row["y1"] - row["y0"]), wide * wide * 1e-6) / max(row["n"], 1)), wide * 1e-9)
    for _ in range(10):
        top = (sites.groupBy("part", F.floor(F.col("_x") / size), F.floor(F.col("_y") / size)).agg(F.count(F.lit(1)).alias("k"))
               .agg(F.max("k")).first()[0])
        if top <= DENSE:
            break
        size /= max(2.0, math.sqrt(top / DENSE))
    return size


def nearest_places(probes: DataFrame, sites: DataFrame, need: str, same_place: bool, size: float | None = None) -> DataFrame:
    """(part, px, py, _x, _y, m, distance): the closest sites of each probe place until ``need`` points are covered.

    Each round searches the 3x3 block of cells around a probe; whatever lies within one cell
    size is final. Probes that still need points go on with cells twice as large, and the last
    few are measured against all sites by every task at once.
    """
    size = size or _start_size(sites)
    open_probes = probes
    found = None
    cell = lambda x, y: [F.floor(F.col(x) / size).alias("cx"), F.floor(F.col(y) / size).alias("cy")]
    block = F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    while True:
        left = open_probes.count()
        if left <= FEW:
            break
        spread = open_probes.select("*", *cell("px", "py"), F.inline(block)).withColumn("cx", F.col("cx") + F.col("dx")).withColumn("cy", F.col("cy") + F.col("dy"))
        pairs = (spread.join(sites.select("*", *cell("_x", "_y")), ["part", "cx", "cy"])
                 .withColumn("distance", F.hypot(F.col("px") - F.col("_x"), F.col("py") - F.col("_y"))).filter(F.col("distance") <= size))
        if not same_place:
            pairs = pairs.filter((F.col("px") != F.col("_x")) | (F.col("py") != F.col("_y")))
        covered = pairs.withColumn("before", _strictly_nearer())
        enough = F.sum("m").over(Window.partitionBy("part", "px", "py")) >= F.col(need)
        tied = F.col("before") < F.col(need)
        done = settle(covered.withColumn("enough", enough).filter(F.col("enough") & tied)
                      .select("part", "px", "py", "_x", "_y", "m", "distance"))
        found = done if found is None else found.union(done)
        open_probes = settle(open_probes.join(done.select("part", "px", "py").distinct(), ["part", "px", "py"], "left_anti"))
        size *= 2
    if left:
        rest = _brute_nearest(open_probes, sites, need, same_place)
        found = rest if found is None else found.union(rest)
    return found


def _strictly_nearer() -> Column:
    """Points at smaller distances than this site's, so sites at equal distance stand or fall together."""
    probe = Window.partitionBy("part", "px", "py")
    upto = probe.orderBy("distance").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return F.sum("m").over(upto) - F.sum("m").over(Window.partitionBy("part", "px", "py", "distance"))


def _brute_nearest(probes: DataFrame, sites: DataFrame, need: str, same_place: bool) -> DataFrame:
    """At most FEW probes against every site: each task keeps its own closest, then the closest of all."""
    few = probes.select("part", "px", "py", need).toPandas()
    shared = probes.sparkSession.sparkContext.broadcast(few)
    most = int(few[need].max())

    def scan(batches):
        p = shared.value
        parts = p["part"].to_numpy()
        for b in batches:
            site_parts = b["part"].to_numpy()
            for part in np.unique(site_parts):
                sites_here, probes_here = np.flatnonzero(site_parts == part), np.flatnonzero(parts == part)
                x, y, m = (b[c].to_numpy()[sites_here] for c in ("_x", "_y", "m"))
                for start in range(0, len(probes_here), 256):
                    mine = probes_here[start:start + 256]
                    px, py = p["px"].to_numpy()[mine, None], p["py"].to_numpy()[mine, None]
                    d = np.hypot(px - x, py - y)
                    if not same_place:
                        d[(px == x) & (py == y)] = np.inf
                    edge = np.partition(d, min(most, d.shape[1]) - 1, axis=1)[:, min(most, d.shape[1]) - 1]
                    i, j = np.nonzero((d <= edge[:, None]) & np.isfinite(d))
                    yield pd.DataFrame({"part": part, "px": px[i, 0], "py": py[i, 0], "_x": x[j], "_y": y[j], "m": m[j],
                                        "distance": d[i, j], need: p[need].to_numpy()[mine][i]})

    rows = sites.select("part", "_x", "_y", "m").mapInPandas(
        scan, f"part string, px double, py double, _x double, _y double, m long, distance double, {need} long")
    return (rows.withColumn("before", _strictly_nearer()).filter(F.col("before") < F.col(need))
            .select("part", "px", "py", "_x", "_y", "m", "distance"))


def nearest(points: DataFrame, k: int) -> DataFrame:
    """(id, rank, other, distance): the k nearest other points of the same part, ties by id.

    A place keeps its k+1 smallest ids, which is all any neighbour list can use of it.
    """
    salted = Window.partitionBy("part", "_x", "_y", F.pmod(F.xxhash64("id"), F.lit(32))).orderBy("id")
    local = points.withColumn("r", F.row_number().over(salted)).filter(F.col("r") <= k + 1)
    first = (local.withColumn("r", F.row_number().over(Window.partitionBy("part", "_x", "_y").orderBy("id")))
             .filter(F.col("r") <= k + 1).groupBy("part", "_x", "_y").agg(F.array_sort(F.collect_list("id")).alias("ids")))
    sites = settle(locations(points).join(first.hint("merge"), ["part", "_x", "_y"]))
    probes = sites.filter(F.col("m") <= k).select("part", F.col("_x").alias("px"), F.col("_y").alias("py"),
                                                  (F.lit(k + 1) - F.col("m")).cast("long").alias("need"))
    if probes.limit(1).count():
        others = nearest_places(probes, sites.select("part", "_x", "_y", "m"), "need", False)
        near = (others.join(sites.select("part", "_x", "_y", "ids"), ["part", "_x", "_y"])
                .select("part", F.col("px").alias("_x"), F.col("py").alias("_y"), "distance", F.explode("ids").alias("other")))
        own = sites.select("part", "_x", "_y", F.lit(0.0).alias("distance"), F.explode("ids").alias("other"))
        both = own.union(near)
    else:
        both = sites.select("part", "_x", "_y", F.lit(0.0).alias("distance"), F.explode("ids").alias("other"))
    best = Window.partitionBy("part", "_x", "_y").orderBy("distance", "other")
    lists = (both.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k + 1)
             .groupBy("part", "_x", "_y").agg(F.array_sort(F.collect_list(F.struct("distance", "other"))).alias("list"))
             .join(sites.select("part", "_x", "_y", "m"), ["part", "_x", "_y"]))
    got = _at_places(points, lists, ["list"])
    mine = F.slice(F.filter("list", lambda e: e["other"] != F.col("id")), 1, k)
    return (got.select("id", F.posexplode(mine).alias("rank", "e"))
            .select("id", (F.col("rank") + 1).cast("long").alias("rank"), F.col("e.other").alias("other"), F.col("e.distance").alias("distance")))


def kth_distances(points: DataFrame, k: int) -> DataFrame:
    """(id, distance): how far the k-th nearest other point of the same part is; points with fewer others are left out.

    Blocks of cells find the distance of every place that two cells around its own cover; rounds of ``nearest_places`` find the others'.
    """
    sites = settle(locations(points))
    size = _start_size(sites)
    total = sites.agg(F.count(F.lit(1)).alias("places"), F.sum("m").alias("points")).first()
    cells = sites.select("*", F.floor(F.col("_x") / size).alias("cx"), F.floor(F.col("_y") / size).alias("cy"))

    def solve(bundle: pd.DataFrame) -> pd.DataFrame:
        return _block_distances(bundle, k, size, SIDE)

    solved = settle(_bundles(cells, SIDE, 2, total["places"]).applyInPandas(solve, "part string, _x double, _y double, m long, distance double"))
    found = solved.filter("distance IS NOT NULL")
    far = solved.filter("distance IS NULL").select("part", F.col("_x").alias("px"), F.col("_y").alias("py"), F.col("m").alias("pm"), (k + 1 - F.col("m")).alias("need"))
    if far.limit(1).count():
        near = nearest_places(far.select("part", "px", "py", "need"), sites, "need", False, 4 * size)
        last = near.groupBy("part", "px", "py").agg(F.max("distance").alias("distance"), F.sum("m").alias("s"))
        found = found.union(far.join(last.hint("merge"), ["part", "px", "py"]).filter(F.col("s") >= F.col("need")).select("part", "px", "py", "pm", "distance"))
    table = found.withColumn("total_n", F.lit(total["points"]))
    return spread_lookup(points, table, ["part", "_x", "_y"], ["distance"], "m").filter("distance IS NOT NULL").select("id", "distance")


def _block_distances(rows: pd.DataFrame, k: int, size: float, side: int) -> pd.DataFrame:
    """(part, _x, _y, m, distance) of blocks' own places; those that are not covered within two cells have no distance."""
    order, start, held, own, home, beside = _cells_of(rows, side, 2)
    part, x, y, m = (rows[c].to_numpy()[order] for c in ("part", "_x", "_y", "m"))
    distance = np.where(m > k, 0.0, np.nan)
    for reach in (1, 2):
        todo = np.flatnonzero(own[home] & np.isnan(distance))
        around = np.column_stack([beside(home[todo], (a, b)) for a in range(-reach, reach + 1) for b in range(-reach, reach + 1)])
        sizes = np.where(around >= 0, held[around], 0)
        ends, done = np.cumsum(sizes.sum(1)), 0
        while done < len(todo):
            to = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + DEALT, "right")))
            n = sizes[done:to].ravel()
            probe = np.repeat(np.repeat(np.arange(to - done), around.shape[1]), n)
            q = np.arange(len(probe)) + np.repeat(start[around[done:to].ravel()] - np.cumsum(n) + n, n)
            p = todo[done:to][probe]
            d = _distance(x[p] - x[q], y[p] - y[q])
            keep = (d <= reach * size) & (p != q)
            probe, q, d = probe[keep], q[keep], d[keep]
            nearer = np.lexsort((d, probe))
            probe, d, upto = probe[nearer], d[nearer], np.concatenate([[0], np.cumsum(m[q[nearer]])])
            first, last = (np.searchsorted(probe, np.arange(to - done), way) for way in ("left", "right"))
            mine = todo[done:to]
            kth = np.searchsorted(upto, upto[first] + k + 1 - m[mine]) - 1
            covered = kth < last
            distance[mine[covered]] = d[kth[covered]]
            done = to
    mine = np.flatnonzero(own[home])
    return pd.DataFrame({"part": part[mine], "_x": x[mine], "_y": y[mine], "m": m[mine], "distance": distance[mine]})


def neighbour_distances(neighbours: DataFrame, k: int) -> DataFrame:
    """Median and 95th percentile of the nearest distance."""
    q = exact_quantiles(neighbours.filter("rank = 1"), ["distance"], [0.5, 0.95])["distance"]
    return neighbours.sparkSession.createDataFrame([(k, q[0], q[1])], "k long, median_m double, p95_m double")


# ------------------------------------------------------------------ autocorrelation

def morans_i(points: DataFrame, neighbours: DataFrame, values: DataFrame, column: str, k: int,
             permutations: int = 199, seed: int = 7) -> DataFrame:
    """Moran's I over k-nearest weights with a permutation p.

    ``values`` is (id, column). Every repetition deals the centred values anew; one row holds a
    point's values in all repetitions. These rows go to the blocks of the map that hold the point
    or one of which it is a neighbour, and the products are summed inside the blocks.
    """
    base = points.select("id").join(values.select("id", F.col(column).cast("double").alias("v")).hint("merge"), "id", "left")
    mean = base.agg(F.avg("v")).first()[0]
    z = settle(base.select("id", F.coalesce(F.col("v") - mean, F.lit(0.0)).alias("z")))
    n = z.count()
    pieces = max(shuffle_width(z.sparkSession), math.ceil(n * permutations / DEALT))
    homes = with_position(z.select("*", F.col("id").cast("double").alias("at"), F.lit(0).alias("one")), ["one"], "at", "id", "to").select("id", "to", "z")
    pairs = settle(neighbours.select("id", "other").join(_blocks(points, n).hint("merge"), "id"))
    needs = pairs.select("block", "id").union(pairs.select("block", F.col("other").alias("id"))).distinct()
    wanted = needs.join(homes.hint("merge"), "id").repartition(pieces, "to")
    vectors = wanted.join(_dealt(z, n, permutations, seed, pieces).repartition(pieces, "to").hint("merge"), "to").select(F.col("block").alias("home"), F.col("id").alias("point"), "z", "zs")

    def products(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        table = np.column_stack([right["z"].to_numpy(), np.frombuffer(b"".join(right["zs"])).reshape(len(right), permutations)])
        order = np.argsort(right["point"].to_numpy())
        ids, total = right["point"].to_numpy()[order], np.zeros(permutations + 1)
        at = [order[np.searchsorted(ids, left[c].to_numpy())] for c in ("id", "other")]
        for start in range(0, len(left), 4096):
            total += np.einsum("ij,ij->j", *[table[i[start:start + 4096]] for i in at])
        return pd.DataFrame({"rep": np.arange(permutations + 1), "s": total})

    by_block = lambda d, key: d.repartition(pieces, key).groupBy(key)
    sums = by_block(pairs, "block").cogroup(by_block(vectors, "home")).applyInPandas(products, "rep int, s double").groupBy("rep").agg(F.sum("s").alias("s"))
    totals = z.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("z") * F.col("z")).alias("den"))
    table = sums.join(F.broadcast(totals), F.lit(True)).withColumn("i", F.col("s") / F.col("den") / k)
    seen = table.filter("rep = 0").select(F.col("i").alias("seen"), F.col("n").alias("points"))
    return (table.filter("rep > 0").join(F.broadcast(seen), F.lit(True)).agg(
        F.max("seen").alias("i"), (-1.0 / (F.max("points") - 1)).alias("expected_i"),
        ((1 + F.sum((F.abs("i") >= F.abs("seen")).cast("long"))) / (1 + F.count(F.lit(1)))).alias("pseudo_p"),
        F.count(F.lit(1)).alias("permutations")).select(F.lit(column).alias("column"), "*", F.lit(k).cast("long").alias("k")))


def _blocks(points: DataFrame, n: int) -> DataFrame:
    """(id, block): squares of the map with about ``BLOCK`` points; a crowded square is split by a hash."""
    row = points.agg(F.max("_x").alias("x1"), F.min("_x").alias("x0"), F.max("_y").alias("y1"), F.min("_y").alias("y0")).first()
    wide = max(row["x1"] - row["x0"], row["y1"] - row["y0"], 1e-6)
    size = math.sqrt(max((row["x1"] - row["x0"]) * (row["y1"] - row["y0"]), wide * wide * 1e-6) * BLOCK / n)
    placed = points.select("id", "part", F.floor(F.col("_x") / size).alias("cx"), F.floor(F.col("_y") / size).alias("cy"))
    crowd = placed.groupBy("part", "cx", "cy").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("split"))
    return placed.join(F.broadcast(crowd), ["part", "cx", "cy"]).select(
        "id", F.concat_ws("_", "part", "cx", "cy", F.pmod(F.xxhash64("id"), "split")).alias("block"))


def _dealt(z: DataFrame, n: int, permutations: int, seed: int, pieces: int) -> DataFrame:
    """(to, zs): the values that repetitions 1 to ``permutations`` deal to each position, as the bytes of their doubles.

    A repetition deals the values in the order of a hash. Hashes are uniform, so their leading bits give
    buckets of even size, and a bucket's first position is the number of rows in those before it.
    """
    bits = (n // BUCKET).bit_length()
    rows = z.repartition(pieces, "id").select("*", F.explode(F.sequence(F.lit(1), F.lit(permutations))).alias("rep"))
    rows = rows.withColumn("draw", F.pmod(F.xxhash64("id", "rep", F.lit(seed)), F.lit(1 << 52))).withColumn("bucket", F.shiftright("draw", 52 - bits))
    upto = Window.partitionBy("rep").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    starts = rows.groupBy("rep", "bucket").agg(F.count(F.lit(1)).alias("k")).select("rep", "bucket", (F.sum("k").over(upto) - F.col("k")).alias("start"))
    inside = Window.partitionBy("rep", "bucket").orderBy("draw", "id")
    placed = (rows.repartition(pieces, "rep", "bucket").withColumn("at", F.row_number().over(inside) - 1).join(F.broadcast(starts), ["rep", "bucket"])
              .select("rep", "z", (F.col("start") + F.col("at")).alias("to")).withColumn("chunk", F.floor(F.col("to") / BLOCK)))

    def gather(rows: pd.DataFrame) -> pd.DataFrame:
        to, first = rows["to"].to_numpy(), int(rows["to"].min())
        table = np.empty((int(to.max()) - first + 1, permutations))
        table[to - first, rows["rep"].to_numpy() - 1] = rows["z"].to_numpy()
        return pd.DataFrame({"to": first + np.arange(len(table)), "zs": [r.tobytes() for r in table]})

    return placed.repartition(pieces, "chunk").groupBy("chunk").applyInPandas(gather, "to long, zs binary")


def gearys_c(neighbours: DataFrame, values: DataFrame, column: str, k: int) -> DataFrame:
    """Geary's C over the neighbour table."""
    v = values.select("id", F.col(column).cast("double").alias("v")).hint("merge")
    squares = (neighbours.select("id", "other").join(v, "id").join(v.select(F.col("id").alias("other"), F.col("v").alias("o")), "other")
               .agg(F.sum((F.col("v") - F.col("o")) ** 2).alias("s"), F.count(F.lit(1)).alias("w")))
    spread = v.agg(F.count("v").alias("n"), F.var_pop("v").alias("var"))
    return squares.join(F.broadcast(spread), F.lit(True)).select(
        F.lit(column).alias("column"), ((F.col("n") - 1) * F.col("s") / (2 * F.col("w") * F.col("n") * F.col("var"))).alias("c"))


# ------------------------------------------------------------------ clusters

def dbscan(points: DataFrame, eps: float, min_samples: int) -> DataFrame:
    """(id, cluster): density clusters; noise has a null cluster.

    Cells are eps/sqrt(2) wide, so points of one cell are always within eps: clusters are
    components of cells, and all points of a cell with ``min_samples`` of them are core. Blocks of
    cells count the neighbours of the others and join cells that have core locations within eps; of
    a crowded cell they see eight corners. Blocks' components are joined over their borders, and
    cells that corners leave apart are then compared by all their locations.
    """
    size, crowded = eps / math.sqrt(2), max(CROWDED, min_samples)
    side = max(2 * HALO, math.isqrt(CROWDED * SIDE * SIDE // crowded))
    cell = [F.floor(F.col("_x") / size).alias("cx"), F.floor(F.col("_y") / size).alias("cy")]
    at = ["part", "cx", "cy"]
    celled = locations(points).select("*", *cell)
    cells = celled.groupBy(*at).agg(F.sum("m").alias("k"), (F.count(F.lit(1)) <= crowded).alias("whole"))
    places = settle(celled.join(cells.hint("merge"), at))
    beside = _beside_crowded(places, min_samples, eps)
    listed = places.filter("whole")
    if beside is None:
        listed = listed.withColumn("more", F.lit(0).cast("long"))
    else:
        more = beside.groupBy("part", "_x", "_y").agg(F.sum("s").alias("more"))
        listed = listed.join(more.hint("merge"), ["part", "_x", "_y"], "left").withColumn("more", F.coalesce("more", F.lit(0)))
    columns = [*at, "_x", "_y", "m", "k", "whole", "more"]
    rows = listed.select(*columns).union(_corners(places).select(*columns))
    total = places.agg(F.count_if("whole").alias("listed"), F.sum("m").alias("points")).first()

    def solve(bundle: pd.DataFrame) -> pd.DataFrame:
        return _block_clusters(bundle, eps, min_samples, side)

    solved = settle(_bundles(rows, side, HALO, total["listed"]).applyInPandas(
        solve, "kind string, part string, _x double, _y double, cx long, cy long, ox long, oy long, k long, node string"))
    own = solved.filter("kind = 'cell'").select(*at, "k", "node")
    other = [F.col("ox").alias("cx"), F.col("oy").alias("cy")]
    over = solved.filter("kind = 'edge'").select("part", *other, F.col("node").alias("src")).join(own.hint("merge"), at).select("src", F.col("node").alias("dst"))
    groups = _grouped_nodes(own, over, "node")
    apart = solved.filter("kind = 'unsure'")
    if apart.limit(1).count():
        name = lambda x, y, to: groups.select("part", F.col("cx").alias(x), F.col("cy").alias(y), F.col("component").alias(to)).hint("merge")
        pairs = settle(apart.select("part", F.col("cx").alias("ax"), F.col("cy").alias("ay"), F.col("ox").alias("bx"), F.col("oy").alias("by"))
                       .join(name("ax", "ay", "src"), ["part", "ax", "ay"]).join(name("bx", "by", "dst"), ["part", "bx", "by"]).filter("src <> dst"))
        if pairs.limit(1).count():
            thin = solved.filter("kind = 'thin'").select("part", "_x", "_y").hint("merge")
            met = _touching(pairs, places.select(*at, "_x", "_y").join(thin, ["part", "_x", "_y"], "left_anti"), size, eps)
            groups = _grouped_nodes(groups.withColumnRenamed("component", "node"), met, "node")
    by_cell = groups.select(*at, "component")
    near = solved.filter("kind = 'near'").select("part", "_x", "_y", *other)
    thin = solved.filter("kind = 'thin'").select("part", "_x", "_y")
    if beside is not None:
        near = near.union(beside.join(thin.hint("merge"), ["part", "_x", "_y"], "left_semi").select("part", "_x", "_y", *other))
    reached = near.join(by_cell.hint("merge"), at).select("part", "_x", "_y", "component")
    edge = (reached.union(thin.withColumn("component", F.lit(None).cast("string"))).groupBy("part", "_x", "_y")
            .agg(F.min("component").alias("reached")).withColumn("thin", F.lit(True)))
    table = groups.withColumn("total_n", F.lit(total["points"]))
    got = spread_lookup(points.select("id", "part", "_x", "_y", *cell), table, at, ["component"], "k")
    return (got.join(edge.hint("merge"), ["part", "_x", "_y"], "left")
            .select("id", F.when(F.col("thin"), F.col("reached")).otherwise(F.col("component")).alias("cluster")))


def _grouped_nodes(cells: DataFrame, edges: DataFrame, node: str) -> DataFrame:
    """(part, cx, cy, k, component): cells with the smallest node that ``edges`` (src, dst) reach from theirs."""
    edges = settle(edges.filter("src <> dst").distinct())
    if not edges.limit(1).count():
        return cells.select("part", "cx", "cy", "k", F.col(node).alias("component"))
    groups = connected_components(edges).withColumnRenamed("node", node)
    return settle(cells.join(groups.hint("merge"), node, "left").select("part", "cx", "cy", "k", F.coalesce("component", node).alias("component")))


def _distance(dx, dy):
    """To the last bit the same in plans (columns) and in tasks (arrays)."""
    return F.sqrt(dx * dx + dy * dy) if isinstance(dx, Column) else np.sqrt(dx * dx + dy * dy)


def _beside_crowded(places: DataFrame, min_samples: int, eps: float) -> DataFrame | None:
    """(part, _x, _y, ox, oy, s): the points of each crowded cell within eps of locations that their own cell does not make core."""
    dense = places.filter("NOT whole")
    crowds = dense.select("part", F.col("cx").alias("ox"), F.col("cy").alias("oy")).distinct()
    if not dense.limit(1).count():
        return None
    offsets = F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a in range(-2, 3) for b in range(-2, 3) if (a, b) != (0, 0)])
    around = crowds.select("*", F.inline(offsets)).select("part", "ox", "oy", (F.col("ox") + F.col("dx")).alias("cx"), (F.col("oy") + F.col("dy")).alias("cy"))
    probes = places.filter(F.col("k") < min_samples).select("part", "cx", "cy", "_x", "_y").join(around.hint("merge"), ["part", "cx", "cy"])
    others = dense.select("part", F.col("cx").alias("ox"), F.col("cy").alias("oy"), F.col("_x").alias("px"), F.col("_y").alias("py"), "m")
    close = _distance(F.col("_x") - F.col("px"), F.col("_y") - F.col("py")) <= eps
    return settle(probes.join(others.hint("merge"), ["part", "ox", "oy"]).filter(close).groupBy("part", "_x", "_y", "ox", "oy").agg(F.sum("m").alias("s")))


def _corners(places: DataFrame) -> DataFrame:
    """Of each crowded cell the outermost location in eight directions."""
    ways = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0)]
    most = [F.max(F.struct((a * F.col("_x") + b * F.col("_y")).alias("to"), "_x", "_y", "m")) for a, b in ways]
    dense = places.filter("NOT whole").groupBy("part", "cx", "cy").agg(F.max("k").alias("k"), F.array(*most).alias("ends"))
    kept = F.array_distinct(F.transform("ends", lambda e: F.struct(e["_x"].alias("_x"), e["_y"].alias("_y"), e["m"].alias("m"))))
    return dense.select("part", "cx", "cy", "k", F.inline(kept)).withColumns({"whole": F.lit(False), "more": F.lit(0).cast("long")})


def _bundles(rows: DataFrame, side: int, halo: int, n: int):
    """Rows with the blocks (bx, by) of ``side`` cells in which, or up to ``halo`` cells beside which, they lie, grouped by bundles of whole blocks."""
    block = lambda c: F.explode(F.array_distinct(F.array(*[F.floor((F.col(c) + d) / side) for d in (-halo, 0, halo)])))
    pieces = max(shuffle_width(rows.sparkSession), math.ceil(n / BUNDLE))
    spread = rows.withColumn("bx", block("cx")).withColumn("by", block("cy"))
    return spread.withColumn("bundle", F.pmod(F.xxhash64("part", "bx", "by"), F.lit(pieces))).repartition(pieces, "bundle").groupBy("bundle")


def _cells_of(rows: pd.DataFrame, side: int, halo: int):
    """Order of a bundle's rows by their cells, each cell's first row, size and whether it is a block's own, each row's cell, and a function for
    the cell (or -1) at an offset of at most two from each of some cells, in the same block."""
    wide, edge = side + 2 * halo + 4, halo + 2
    block = rows.groupby(["part", "bx", "by"], sort=False).ngroup().to_numpy()
    inside = [rows[c].to_numpy() - rows[b].to_numpy() * side + edge for c, b in (("cx", "bx"), ("cy", "by"))]
    code = (block * wide + inside[0]) * wide + inside[1]
    order = np.argsort(code, kind="stable")
    codes, start, home, size = np.unique(code[order], return_index=True, return_inverse=True, return_counts=True)
    own = np.all([(i >= edge) & (i < edge + side) for i in (codes // wide % wide, codes % wide)], axis=0)

    def beside(cells: np.ndarray, offset: tuple[int, int]) -> np.ndarray:
        to = codes[cells] + offset[0] * wide + offset[1]
        at = np.minimum(np.searchsorted(codes, to), len(codes) - 1)
        return np.where(codes[at] == to, at, -1)

    return order, start, size, own, home, beside


def _expand(start: np.ndarray, size: np.ndarray):
    """(which, at): the numbers ``start[i]`` to ``start[i] + size[i]`` of every i, in pieces of bounded size."""
    ends, done = np.cumsum(size), 0
    while done < len(size):
        before = ends[done - 1] if done else 0
        to = max(done + 1, int(np.searchsorted(ends, before + DEALT, "right")))
        n = size[done:to]
        which = np.repeat(np.arange(done, to), n)
        yield which, np.arange(len(which)) + np.repeat(start[done:to] - np.cumsum(n) + n, n)
        done = to


def _merged(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels, each the smallest number of its set, after the sets of ``a`` and ``b`` are joined pair by pair."""
    while (label[a] != label[b]).any():
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        np.minimum.at(label, high, low)
        while (label[label] != label).any():
            label = label[label]
    return label


def _block_clusters(rows: pd.DataFrame, eps: float, min_samples: int, side: int) -> pd.DataFrame:
    """What blocks find, by ``kind``: their core cells with their local component (cell), components that go on in a cell of
    another block (edge), pairs of cells that corners leave open (unsure), locations that are not core (thin) and the core cells near these (near).

    The margin of ``HALO`` cells gives the cells that a block's own reach, and the neighbours of their locations.
    """
    order, start, size, own, home, beside = _cells_of(rows, side, HALO)
    part, cx, cy, x, y, m, k, whole, more = (rows[c].to_numpy()[order] for c in ("part", "cx", "cy", "_x", "_y", "m", "k", "whole", "more"))
    cell_part, cx, cy, cell_whole, cell_k = (v[start] for v in (part, cx, cy, whole, k))
    offsets = sorted(((a, b) for a in range(-2, 3) for b in range(-2, 3)), key=lambda o: (math.hypot(*o), o))
    within = lambda p, q: _distance(x[p] - x[q], y[p] - y[q]) <= eps

    s = (k + more).astype(np.int64)
    for offset in offsets[1:]:
        p = np.flatnonzero(whole & (s < min_samples))
        j = beside(home[p], offset)
        p, j = p[(j >= 0) & cell_whole[j]], j[(j >= 0) & cell_whole[j]]
        for which, q in _expand(start[j], size[j]):
            near = within(p[which], q)
            np.add.at(s, p[which[near]], m[q[near]])
    core = ~whole | (s >= min_samples)

    cores = np.flatnonzero(core)
    held = np.bincount(home[cores], minlength=len(start))
    begin = np.cumsum(held) - held
    x0, x1, y0, y1 = (f.reduceat(v, start) for v in (x, y) for f in (np.minimum, np.maximum))
    label, mine, open_pairs = np.arange(len(start)), np.flatnonzero(own & (held > 0)), []
    for offset in [o for o in offsets if o > (0, 0)]:
        j = beside(mine, offset)
        keep = (j >= 0) & (held[j] > 0) & (label[mine] != label[j])
        i, j = mine[keep], j[keep]
        hit = np.zeros(len(i), dtype=bool)
        for pair, p in _expand(begin[i], held[i]):
            for which, q in _expand(begin[j[pair]], held[j[pair]]):
                hit[pair[which[within(cores[p[which]], cores[q])]]] = True
        label = _merged(label, i[hit], j[hit])
        gap = [np.maximum(0, np.maximum(lo[j] - hi[i], lo[i] - hi[j])) for lo, hi in ((x0, x1), (y0, y1))]
        left = ~hit & ~(cell_whole[i] & cell_whole[j]) & (_distance(*gap) <= eps)
        open_pairs.append(np.column_stack([i[left], j[left]]))
    unsure = np.concatenate(open_pairs)
    unsure = unsure[label[unsure[:, 0]] != label[unsure[:, 1]]]

    thin, near_pairs = np.flatnonzero(~core & own[home]), []
    for offset in offsets:
        j = beside(home[thin], offset)
        keep = (j >= 0) & (held[j] > 0) & cell_whole[j]
        p, j = thin[keep], j[keep]
        for which, q in _expand(begin[j], held[j]):
            close = which[within(p[which], cores[q])]
            near_pairs.append(np.unique(np.column_stack([p[close], j[close]]), axis=0))
    near = np.concatenate([np.empty((0, 2), dtype=int), *near_pairs])

    names = pd.Series([f"{a}_{b}_{c}" for a, b, c in zip(cell_part[mine], cx[mine].tolist(), cy[mine].tolist())], dtype=object)
    node = names.groupby(label[mine]).min()
    on = np.flatnonzero(~own & np.isin(label, label[mine]))
    rows_of = lambda kind, of, **has: pd.DataFrame({"kind": np.repeat(kind, len(of)), "part": of, "_x": 0.0, "_y": 0.0, "cx": 0, "cy": 0, "ox": 0, "oy": 0, "k": 0, "node": ""} | has)
    return pd.concat([
        rows_of("cell", cell_part[mine], cx=cx[mine], cy=cy[mine], k=cell_k[mine], node=node.reindex(label[mine]).to_numpy()),
        rows_of("edge", cell_part[on], ox=cx[on], oy=cy[on], node=node.reindex(label[on]).to_numpy()),
        rows_of("unsure", cell_part[unsure[:, 0]], cx=cx[unsure[:, 0]], cy=cy[unsure[:, 0]], ox=cx[unsure[:, 1]], oy=cy[unsure[:, 1]]),
        rows_of("thin", part[thin], _x=x[thin], _y=y[thin]),
        rows_of("near", part[near[:, 0]], _x=x[near[:, 0]], _y=y[near[:, 0]], ox=cx[near[:, 1]], oy=cy[near[:, 1]])], ignore_index=True)


def _touching(pairs: DataFrame, core: DataFrame, size: float, eps: float) -> DataFrame:
    """(src, dst) of the ``pairs`` of cells (part, ax, ay, bx, by, src, dst) with a location of each within eps.

    Boxes around a cell's locations decide pairs that lie wholly within eps or apart; boxes of the others are cut in 16, until
    few enough locations are left to be compared one by one, or one in each box.
    """
    ends = pairs.select("part", F.col("ax").alias("cx"), F.col("ay").alias("cy")).union(pairs.select("part", "bx", "by")).distinct()
    core = settle(core.join(ends.hint("merge"), ["part", "cx", "cy"], "left_semi"))
    limit, met = max(DEALT, 16 * core.count()), None
    of = ["part", "ax", "ay", "bx", "by", "src", "dst"]
    todo = pairs.select(*of, *[F.lit(0).cast("long").alias(c) for c in ("au", "av", "bu", "bv")])
    for depth in range(DEEPEST + 1):
        inside = lambda c, to: F.floor(F.col(c) / size * 4 ** depth) - F.shiftleft(F.col(to), 2 * depth)
        placed = core.select("part", "cx", "cy", "_x", "_y", inside("_x", "cx").alias("u"), inside("_y", "cy").alias("v"))
        box = placed.groupBy("part", "cx", "cy", "u", "v").agg(*[f(c).alias(n) for c, f, n in (("_x", F.min, "x0"), ("_x", F.max, "x1"), ("_y", F.min, "y0"), ("_y", F.max, "y1"))],
                                                              F.min(F.struct("_x", "_y")).alias("p"), F.count(F.lit(1)).alias("n"))
        to = lambda e, d: d.select("part", F.col("cx").alias(f"{e}x"), F.col("cy").alias(f"{e}y"), F.shiftright("u", 2).alias(f"{e}u"), F.shiftright("v", 2).alias(f"{e}v"),
                                   F.struct("u", "v", "x0", "x1", "y0", "y1", "p", "n").alias(e)).hint("merge")
        both = todo.join(to("a", box), ["part", "ax", "ay", "au", "av"]).join(to("b", box), ["part", "bx", "by", "bu", "bv"])
        v = lambda e, c: F.col(f"{e}.{c}")
        gap = lambda c: F.greatest(v("b", f"{c}0") - v("a", f"{c}1"), v("a", f"{c}0") - v("b", f"{c}1"), F.lit(0.0))
        reach = lambda c: F.greatest(v("b", f"{c}1"), v("a", f"{c}1")) - F.least(v("b", f"{c}0"), v("a", f"{c}0"))
        one = _distance(v("a", "p._x") - v("b", "p._x"), v("a", "p._y") - v("b", "p._y"))
        judged = settle(both.filter(_distance(gap("x"), gap("y")) <= eps).select(
            *of, *[v(e, c).alias(e + c) for e in "ab" for c in "uv"], ((_distance(reach("x"), reach("y")) <= eps) | (one <= eps)).alias("hit"), (v("a", "n") * v("b", "n")).alias("work")))
        hits = judged.filter("hit").select(*of).distinct()
        met = hits if met is None else met.union(hits)
        todo = settle(judged.filter("NOT hit AND work > 1").join(hits.hint("merge"), of, "left_anti"))
        work = todo.agg(F.sum(F.col("work").cast("double"))).first()[0]
        if not work:
            break
        todo = todo.drop("hit", "work")
        if work <= limit or depth == DEEPEST:
            side = lambda e: placed.select("part", *[F.col(c).alias(e + n) for c, n in (("cx", "x"), ("cy", "y"), ("u", "u"), ("v", "v"), ("_x", "p"), ("_y", "q"))]).hint("merge")
            close = _distance(F.col("ap") - F.col("bp"), F.col("aq") - F.col("bq")) <= eps
            met = met.union(todo.join(side("a"), ["part", "ax", "ay", "au", "av"]).join(side("b"), ["part", "bx", "by", "bu", "bv"]).filter(close).select(*of).distinct())
            break
    return met.select("src", "dst")


def cluster_summary(clustered: DataFrame) -> DataFrame:
    return clustered.agg(F.count_distinct("cluster").alias("clusters"), F.avg(F.col("cluster").isNull().cast("int")).alias("noise_share"))


def thinned(df: DataFrame, keep: list[str], order: str, most: int = 1500) -> DataFrame:
    """Every n-th row along the order, about ``most`` of them."""
    step = max(1, df.count() // most)
    placed = with_position(df.withColumn("_one", F.lit(0)), ["_one"], order, order)
    return placed.filter(F.col("_pos") % step == 0).select(*keep)


# ------------------------------------------------------------------ joins

def point_in_polygon(df: DataFrame, row_id: str, lat: str, lon: str, polygons: DataFrame, columns: list[str], how: str = "left") -> DataFrame:
    """Join each point to the polygons that contain it.

    ``polygons`` has one row per vertex: (poly, seq, lat, lon, attributes). A polygon covers
    the grid cells of its bounding box; candidates meet on the cell and an odd number of edge
    crossings of a ray decides.
    """
    shapes = polygons.groupBy("poly").agg(
        F.array_sort(F.collect_list(F.struct("seq", F.col("lon").cast("double").alias("x"), F.col("lat").cast("double").alias("y")))).alias("ring"),
        F.min("lon").alias("x0"), F.max("lon").alias("x1"), F.min("lat").alias("y0"), F.max("lat").alias("y1"),
        *[F.first(c).alias(c) for c in columns])
    span = shapes.agg(F.max(F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")))).first()[0]
    size = max(float(span) / 4, 1e-9)
    cover = (shapes.withColumn("gx", F.explode(F.sequence(F.floor(F.col("x0") / size), F.floor(F.col("x1") / size))))
             .withColumn("gy", F.explode(F.sequence(F.floor(F.col("y0") / size), F.floor(F.col("y1") / size)))))
    x, y = F.col(lon).cast("double"), F.col(lat).cast("double")
    probes = df.select(F.col(row_id).alias("_id"), x.alias("px"), y.alias("py"), F.floor(x / size).alias("gx"), F.floor(y / size).alias("gy")).dropna()
    shifted = F.concat(F.slice("ring", 2, F.size("ring") - 1), F.slice("ring", 1, 1))
    crossing = lambda a, b: F.when(((a["y"] > F.col("py")) != (b["y"] > F.col("py")))
                                   & (F.col("px") < (b["x"] - a["x"]) * (F.col("py") - a["y"]) / (b["y"] - a["y"]) + a["x"]), 1).otherwise(0)
    parity = F.aggregate(F.zip_with("ring", shifted, crossing), F.lit(0), lambda s, v: s + v) % 2
    inside = (probes.join(cover, ["gx", "gy"])
              .filter(F.col("px").between(F.col("x0"), F.col("x1")) & F.col("py").between(F.col("y0"), F.col("y1")))
              .filter(parity == 1).select(F.col("_id").alias(row_id), *columns))
    return df.join(inside, row_id, how)


def nearest_feature(df: DataFrame, row_id: str, lat: str, lon: str, features: DataFrame, columns: list[str],
                    centre: tuple[float, float]) -> DataFrame:
    """Attributes of, and metres to, the nearest of another table's points (lat, lon, attributes)."""
    x, y = project(F.col(lat), F.col(lon), centre, EARTH_SHAPING)
    fx, fy = project(F.col("lat"), F.col("lon"), centre, EARTH_SHAPING)
    sites = settle(features.select(fx.alias("_x"), fy.alias("_y"), *columns).groupBy("_x", "_y")
                   .agg(F.min(F.struct(*columns)).alias("a")).select(F.lit("all").alias("part"), "_x", "_y", F.lit(1).cast("long").alias("m"), "a"))
    placed = df.withColumns({"_px": x, "_py": y})
    probes = placed.select(F.lit("all").alias("part"), F.col("_px").alias("px"), F.col("_py").alias("py")).dropna().distinct().withColumn("need", F.lit(1).cast("long"))
    near = nearest_places(probes, sites.select("part", "_x", "_y", "m"), "need", True)
    found = (near.join(sites, ["part", "_x", "_y", "m"]).select(F.col("px").alias("_px"), F.col("py").alias("_py"), "distance", "a.*"))
    return placed.join(found.withColumnRenamed("distance", "nearest_feature_m"), ["_px", "_py"], "left").drop("_px", "_py")


def duplicate_locations_within(points: DataFrame, radius: float) -> DataFrame:
    """Share of points with another point within the radius."""
    near = neighbours_within(points, radius)
    return near.agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("n") > 0).cast("long")).alias("close"),
                    F.avg((F.col("n") > 0).cast("int")).alias("share"))
