"""Spatial steps of a recipe, on the coordinates a parse_geometry step declared."""

from __future__ import annotations

from pyspark.sql import functions as F

from specula.operators import spatial
from specula.operators.shaping.recipe import Shaped, Step
from specula.operators.shaping.features import _replace


def _metres(state: Shaped):
    """x and y in metres about the training centroid, fitted once."""
    if state.centre is None:
        state.centre = spatial.centroid(state.fit_rows, state.lat, state.lon)
    return spatial.project(F.col(state.lat), F.col(state.lon), state.centre, spatial.EARTH_SHAPING)


def reproject(state: Shaped, step: Step) -> dict:
    x, y = _metres(state)
    names = [step.params.get("x", "x_m"), step.params.get("y", "y_m")]
    state.df = state.df.withColumns({names[0]: x, names[1]: y})
    return {"centre": state.centre, "names": names}


def distance(state: Shaped, step: Step) -> dict:
    """Metres (and optionally the bearing) to one reference point."""
    x, y = _metres(state)
    lat0, lon0 = step.params["to"]["lat"], step.params["to"]["lon"]
    x0, y0 = spatial.project(F.lit(float(lat0)), F.lit(float(lon0)), state.centre, spatial.EARTH_SHAPING)
    name = step.params.get("name", "distance_m")
    made = {name: F.hypot(x - x0, y - y0)}
    if step.params.get("bearing"):
        made[step.params.get("bearing_name", "bearing_deg")] = spatial.bearing(x, y, x0, y0)
    state.df = state.df.withColumns(made)
    return {"to": step.params["to"], "centre": state.centre}


def grid(state: Shaped, step: Step) -> dict:
    """The square cell of each row, and optionally a training aggregate of the cell looked up on every part."""
    x, y = _metres(state)
    size = float(step.params.get("size_m", 1000.0))
    name = step.params.get("name", "cell_id")
    state.df = state.df.withColumn(name, spatial.cell_id(x, y, size))
    functions = {"mean": F.avg, "sum": F.sum, "count": F.count, "min": F.min, "max": F.max}
    fit = state.fit_rows
    for column, how in step.params.get("aggregate", {}).items():
        made = f"{name}_{column}_{how}"
        table = fit.groupBy(F.col(name).alias("cat")).agg(functions[how](column).cast("double").alias("code"), F.count(F.lit(1)).alias("n"))
        state.df = state.df.withColumn(made, F.col(name))
        _replace(state, made, table.filter("cat IS NOT NULL"), None, fit.count())
    return {"size_m": size, "aggregate": step.params.get("aggregate", {})}


def features(state: Shaped, step: Step) -> dict:
    """Neighbours within a radius, nearest neighbour distance and centroid, within each part."""
    p = step.params
    x, y = _metres(state)
    wanted = p.get("features", ["n_neighbours_within"])
    radius = float(p.get("radius_m", 1000.0))
    df = state.df.withColumns({"_x": x, "_y": y})
    points = df.select(F.col(state.row_id).alias("id"), F.col("_part").alias("part"), "_x", "_y").dropna()
    if "n_neighbours_within" in wanted:
        near = spatial.neighbours_within(points, radius)
        df = df.join(near.select(F.col("id").alias(state.row_id), F.col("n").alias(f"n_within_{int(radius)}m")), state.row_id, "left")
    if "nearest_distance" in wanted:
        close = spatial.nearest(points, 1).select(F.col("id").alias(state.row_id), F.col("distance").alias("nearest_neighbour_m"))
        df = df.join(close, state.row_id, "left")
    if "centroid_x" in wanted:
        df = df.withColumn("centroid_x_m", F.col("_x"))
    if "centroid_y" in wanted:
        df = df.withColumn("centroid_y_m", F.col("_y"))
    state.df = df.drop("_x", "_y")
    return {"features": wanted, "radius_m": radius}


def join(state: Shaped, step: Step) -> dict:
    """Attributes of the polygon a point lies in, or of the nearest feature."""
    p = step.params
    if p.get("predicate", "within") == "nearest":
        state.df = spatial.nearest_feature(state.df, state.row_id, state.lat, state.lon, p["features"], p["columns"],
                                           spatial.centroid(state.fit_rows, state.lat, state.lon))
    else:
        state.df = spatial.point_in_polygon(state.df, state.row_id, state.lat, state.lon, p["polygons"], p["columns"], p.get("how", "left"))
    return {"predicate": p.get("predicate", "within"), "columns": p["columns"]}


OPERATIONS = {"spatial_reproject": reproject, "spatial_distance": distance, "spatial_grid": grid,
              "spatial_features": features, "spatial_join": join}
