"""Spatial queries over customers with planted coordinates."""

from __future__ import annotations

from pyspark.sql import functions as F

from specula.catalog import query
from specula.operators import spatial
from specula.operators.shaping import Step, run
from specula.plans.longform import rnd

r = lambda c, d=6: rnd(F.col(c), d).alias(c)

PLACED = "(SELECT *, 45 + ((c_custkey * 7919) % 10007) / 100000.0::DOUBLE + c_acctbal / 1e9 AS lat, 7 + ((c_custkey * 104729) % 10009) / 100000.0::DOUBLE AS lon FROM customer)"


def placed(t):
    k = F.col("c_custkey")
    return t.customer.withColumns({"lat": 45 + ((k * 7919) % 10007) / 100000.0 + F.col("c_acctbal") / 1e9, "lon": 7 + ((k * 104729) % 10009) / 100000.0})


def metres(radius, where="true"):
    return f"""(SELECT p.*, radians(lon - lon0) * {radius} * cos(radians(lat0)) AS x, radians(lat - lat0) * {radius} AS y FROM {PLACED} p, (SELECT avg(lat) AS lat0, avg(lon) AS lon0 FROM {PLACED} WHERE {where}))"""


def points(t):
    return spatial.projected(placed(t), "c_custkey", "lat", "lon")


@query("coordinate_sanity", f"""SELECT count(*) AS n, count(*) FILTER (lat NOT BETWEEN -90 AND 90) AS lat_out_of_range, count(*) FILTER (lon NOT BETWEEN -180 AND 180) AS lon_out_of_range, max(abs(lat)) > 90 AND max(abs(lon)) <= 90 AS axis_swap_suspected,
 count(*) - count(DISTINCT (lat, lon)) AS duplicate_locations FROM (SELECT CASE WHEN c_custkey % 100 = 0 THEN 95.0 ELSE 45 + c_custkey % 10 END AS lat, c_custkey % 7 AS lon FROM customer)""")
def coordinate_sanity(t):
    k = F.col("c_custkey")
    return spatial.coordinate_sanity(t.customer.select(F.when(k % 100 == 0, 95.0).otherwise(45 + k % 10).alias("lat"), (k % 7).alias("lon")), "lat", "lon")


@query("local_projection", f"SELECT c_custkey AS id, round(x, 3) + 0.0 AS x, round(y, 3) + 0.0 AS y FROM {metres(6371000.0)}")
def local_projection(t):
    return points(t).select("id", rnd(F.col("_x"), 3).alias("x"), rnd(F.col("_y"), 3).alias("y"))


NEAR = f"(SELECT a.c_custkey AS id, b.c_custkey AS other, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS d, row_number() OVER (PARTITION BY a.c_custkey ORDER BY sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), b.c_custkey) AS rank FROM {metres(6371000.0)} a JOIN {metres(6371000.0)} b ON a.c_custkey <> b.c_custkey QUALIFY rank <= 8)"


@query("nearest_neighbours", f"SELECT id, rank, round(d, 3) AS distance FROM {NEAR}")
def nearest_neighbours(t):
    return spatial.nearest(points(t), 8).select("id", "rank", r("distance", 3))


@query("neighbour_distances", f"SELECT CAST(8 AS BIGINT) AS k, round(quantile_cont(d, 0.5), 4) AS median_m, round(quantile_cont(d, 0.95), 4) AS p95_m FROM {NEAR} WHERE rank = 1")
def neighbour_distances(t):
    return spatial.neighbour_distances(spatial.nearest(points(t), 8), 8).select("k", r("median_m", 4), r("p95_m", 4))


@query("morans_i", f"""WITH n AS (SELECT * FROM {NEAR}), z AS (SELECT c_custkey AS id, lat - (SELECT avg(lat) FROM {PLACED}) AS z FROM {PLACED}) SELECT 'lat' AS "column", round((SELECT sum(a.z * b.z) FROM n JOIN z a ON n.id = a.id JOIN z b ON n.other = b.id) / (SELECT sum(z * z) FROM z) / 8, 6) AS i,
 round(-1.0 / (count(*) - 1), 8) AS expected_i FROM z""")
def morans_i(t):
    p = points(t)
    values = placed(t).select(F.col("c_custkey").alias("id"), "lat")
    return spatial.morans_i(p, spatial.nearest(p, 8), values, "lat", 8, permutations=19).select("column", r("i"), r("expected_i", 8))


@query("morans_i_test")
def morans_i_test(t):
    p = points(t)
    values = placed(t).select(F.col("c_custkey").alias("id"), "c_acctbal")
    return spatial.morans_i(p, spatial.nearest(p, 8), values, "c_acctbal", 8).select("column", r("i"), r("pseudo_p", 4), "permutations")


@query("gearys_c", f"""WITH n AS (SELECT * FROM {NEAR}), v AS (SELECT c_custkey AS id, c_acctbal AS v FROM customer) SELECT 'c_acctbal' AS "column", round((SELECT count(*) - 1 FROM v) * (SELECT sum(pow(a.v - b.v, 2)) FROM n JOIN v a ON n.id = a.id JOIN v b ON n.other = b.id) / (2 * (SELECT count(*) FROM n) * (SELECT sum(pow(v - (SELECT avg(v) FROM v), 2)) FROM v)), 6) AS c""")
def gearys_c(t):
    values = placed(t).select(F.col("c_custkey").alias("id"), "c_acctbal")
    return spatial.gearys_c(spatial.nearest(points(t), 8), values, "c_acctbal", 8).select("column", r("c"))


@query("neighbours_within", f"SELECT a.c_custkey AS id, count(b.c_custkey) AS n FROM {metres(6371000.0)} a LEFT JOIN {metres(6371000.0)} b ON a.c_custkey <> b.c_custkey AND pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= 400.0 * 400.0 GROUP BY 1")
def neighbours_within(t):
    return spatial.neighbours_within(points(t), 400.0)


@query("dbscan", f"""WITH RECURSIVE p AS (SELECT c_custkey AS id, x, y FROM {metres(6371000.0)}), e AS (SELECT a.id, b.id AS o FROM p a JOIN p b ON pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= 250.0 * 250.0),
core AS (SELECT id FROM e GROUP BY id HAVING count(*) >= 4), ce AS (SELECT e.id, e.o FROM e JOIN core a ON e.id = a.id JOIN core b ON e.o = b.id), w(a, b) AS (SELECT id, id FROM core UNION SELECT w.a, ce.o FROM w JOIN ce ON w.b = ce.id), lab AS (SELECT a AS id, min(b) AS c FROM w GROUP BY 1)
SELECT count(DISTINCT c) AS clusters, (SELECT count(*) FROM p) AS n, (SELECT count(*) FROM p WHERE id NOT IN (SELECT e.id FROM e JOIN core ON e.o = core.id)) AS noise FROM lab""")
def dbscan(t):
    c = spatial.dbscan(points(t), 250.0, 4)
    return c.agg(F.count_distinct("cluster").alias("clusters"), F.count(F.lit(1)).alias("n"), F.sum(F.col("cluster").isNull().cast("long")).alias("noise"))


@query("dbscan_summary")
def dbscan_summary(t):
    """eps is the 90th percentile of the 8th neighbour's distance."""
    from specula.plans.ordered import exact_quantiles
    p = points(t)
    kth = spatial.settle(spatial.kth_distances(p, 8).select("distance"))
    eps = exact_quantiles(kth, ["distance"], [0.9])["distance"][0]
    return spatial.cluster_summary(spatial.dbscan(p, eps, 4)).withColumn("eps", F.round(F.lit(eps), 3))


@query("thinned_points", f"SELECT c_custkey, round(lat, 6) AS lat, round(lon, 6) AS lon FROM {PLACED} WHERE c_custkey % greatest(1, (SELECT count(*) FROM customer) // 300) = 0")
def thinned_points(t):
    return spatial.thinned(placed(t), ["c_custkey", "lat", "lon"], "c_custkey", 300).select("c_custkey", r("lat"), r("lon"))


@query("close_locations", f"""SELECT count(*) AS n, count(*) FILTER (k > 0) AS close, round(count(*) FILTER (k > 0) / count(*), 6) AS share FROM (SELECT a.c_custkey, count(b.c_custkey) AS k FROM {metres(6371000.0)} a LEFT JOIN {metres(6371000.0)} b ON a.c_custkey <> b.c_custkey AND pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= 10000.0 GROUP BY 1)""")
def close_locations(t):
    return spatial.duplicate_locations_within(points(t), 100.0).select("n", "close", r("share"))


# ----------------------------------------------------------------- recipe steps

GEO = Step("geo", "parse_geometry", params={"crs": "EPSG:4326", "lat": "lat", "lon": "lon"})
SPLIT = Step("split", "split", params={"kind": "cutoff", "time_column": "joined", "cutoff": "2020-01-01"})
TRAIN = "c_custkey % 4 <> 0"


def shape(t, *steps):
    df = placed(t).withColumn("joined", F.when(F.col("c_custkey") % 4 == 0, F.lit("2021-01-01")).otherwise("2019-01-01").cast("timestamp"))
    return run(df, [GEO, SPLIT, *steps], "c_custkey").df


M = metres(6371008.8, TRAIN)


@query("spatial_reproject", f"SELECT c_custkey, round(x, 3) + 0.0 AS x_m, round(y, 3) + 0.0 AS y_m FROM {M}")
def spatial_reproject(t):
    return shape(t, Step("r", "spatial_reproject")).select("c_custkey", r("x_m", 3), r("y_m", 3))


@query("spatial_distance", f"""SELECT c_custkey, round(sqrt(pow(dx, 2) + pow(dy, 2)), 3) AS distance_m, round((degrees(atan2(dx, dy)) + 360) - 360 * floor((degrees(atan2(dx, dy)) + 360) / 360), 4) AS bearing_deg FROM (
 SELECT c_custkey, radians(7.05 - lon) * 6371008.8 * cos(radians((SELECT avg(lat) FROM {PLACED} WHERE {TRAIN}))) AS dx, radians(45.05 - lat) * 6371008.8 AS dy FROM {PLACED})""")
def spatial_distance(t):
    step = Step("d", "spatial_distance", params={"to": {"lat": 45.05, "lon": 7.05}, "bearing": True})
    return shape(t, step).select("c_custkey", r("distance_m", 3), r("bearing_deg", 4))


@query("spatial_grid", f"""WITH m AS (SELECT *, CAST(floor(x / 500) AS BIGINT) || '_' || CAST(floor(y / 500) AS BIGINT) AS cell_id FROM {M}), a AS (SELECT cell_id, avg(c_acctbal) AS v FROM m WHERE {TRAIN} GROUP BY 1)
SELECT c_custkey, m.cell_id, round(v, 4) + 0.0 AS cell_id_c_acctbal_mean FROM m LEFT JOIN a ON m.cell_id = a.cell_id""")
def spatial_grid(t):
    return shape(t, Step("g", "spatial_grid", params={"size_m": 500, "aggregate": {"c_acctbal": "mean"}})).select("c_custkey", "cell_id", r("cell_id_c_acctbal_mean", 4))


@query("spatial_features", f"""SELECT a.c_custkey, count(b.c_custkey) FILTER (pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= 300.0 * 300.0) AS n_within_300m, round(min(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))), 3) AS nearest_neighbour_m, round(any_value(a.x), 3) + 0.0 AS centroid_x_m
 FROM {M} a LEFT JOIN {M} b ON a.c_custkey <> b.c_custkey AND (a.c_custkey % 4 = 0) = (b.c_custkey % 4 = 0) GROUP BY 1""")
def spatial_features(t):
    step = Step("f", "spatial_features", params={"radius_m": 300, "features": ["n_neighbours_within", "nearest_distance", "centroid_x"]})
    return shape(t, step).select("c_custkey", "n_within_300m", r("nearest_neighbour_m", 3), r("centroid_x_m", 3))


ZONES = """(SELECT n_nationkey AS k, n_name, 45 + (n_nationkey // 5) * 0.02 AS y0, 7 + (n_nationkey % 5) * 0.02 AS x0 FROM nation)"""


def zones(t):
    """One triangle per nation, on a 5 by 5 lattice."""
    k = F.col("n_nationkey")
    y0, x0 = 45 + F.floor(k / 5) * 0.02, 7 + (k % 5) * 0.02
    corners = F.array(*[F.struct(F.lit(i).alias("seq"), (y0 + dy).alias("lat"), (x0 + dx).alias("lon")) for i, (dy, dx) in enumerate([(0.0, 0.0), (0.0, 0.02), (0.02, 0.01)])])
    return t.nation.select(k.alias("poly"), F.col("n_name").alias("zone"), F.inline(corners))


@query("spatial_join", f"""SELECT c_custkey, n_name AS zone FROM {PLACED} LEFT JOIN {ZONES} ON lat >= y0 AND lat - y0 < 2 * (lon - x0) AND lat - y0 < 2 * (x0 + 0.02 - lon)""")
def spatial_join(t):
    return shape(t, Step("j", "spatial_join", params={"polygons": zones(t), "columns": ["zone"], "how": "left"})).select("c_custkey", "zone")


@query("nearest_feature", f"""WITH f AS (SELECT n_name AS shop, radians(7 + ((n_nationkey * 37) % 101) / 1000.0 - lon0) * 6371008.8 * cos(radians(lat0)) AS x, radians(45 + ((n_nationkey * 53) % 97) / 1000.0 - lat0) * 6371008.8 AS y FROM nation, (SELECT avg(lat) AS lat0, avg(lon) AS lon0 FROM {PLACED} WHERE {TRAIN}))
SELECT c_custkey, arg_min(shop, sqrt(pow(f.x - m.x, 2) + pow(f.y - m.y, 2))) AS shop, round(min(sqrt(pow(f.x - m.x, 2) + pow(f.y - m.y, 2))), 3) AS nearest_feature_m FROM {M} m, f GROUP BY 1""")
def nearest_feature(t):
    k = F.col("n_nationkey")
    shops = t.nation.select((45 + ((k * 53) % 97) / 1000.0).alias("lat"), (7 + ((k * 37) % 101) / 1000.0).alias("lon"), F.col("n_name").alias("shop"))
    step = Step("j", "spatial_join", params={"predicate": "nearest", "features": shops, "columns": ["shop"]})
    return shape(t, step).select("c_custkey", "shop", r("nearest_feature_m", 3))


@query("verify_coordinates", f"SELECT count(*) FILTER (lat NOT BETWEEN -90 AND 90) AS lat_out, count(*) FILTER (lon NOT BETWEEN -180 AND 180) AS lon_out, true AS crs_declared FROM {PLACED}")
def verify_coordinates(t):
    from specula.operators import verify
    return verify.coordinate_bounds(run(placed(t), [GEO], "c_custkey"))
