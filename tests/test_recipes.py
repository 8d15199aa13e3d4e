"""Recipes over frames with planted structure: sizes, guards, protection and repeatability."""

import pytest
from pyspark.sql import functions as F

from specula.operators import verify
from specula.operators.shaping import Cycle, Geometry, Partition, Step, check, preset, run
from specula.sources.sampling import row_digest


@pytest.fixture(scope="module")
def orders(spark):
    k = F.col("id")
    return spark.range(600).select(
        k.alias("row"), F.concat(F.lit("o"), k.cast("string")).alias("order_id"), (k % 40).alias("customer_id"),
        F.expr("timestamp'2024-01-01' + make_interval(0,0,0,CAST(id % 200 AS INT),0,0,0)").alias("order_date"),
        (F.when(k % 2 == 0, 31).otherwise(78) + (k * 7 % 11)).cast("double").alias("unit_price"), (k % 9 + 1).cast("int").alias("qty"),
        (k % 5).cast("double").alias("discount_pct"), (k % 12).cast("string").alias("zip"), F.concat(F.lit("city"), (k % 12).cast("string")).alias("city"),
        (k * 13 % 15).cast("int").alias("delivered_days")).withColumns({
            "total": F.col("unit_price") * F.col("qty"), "late": (F.col("delivered_days") > 7).cast("int")}).withColumn(
            "subtotal", F.col("total") * (1 - F.col("discount_pct") / 100))


GEO = Geometry(roles={"order_id": "identity", "customer_id": "key"}, basis=["unit_price", "qty", "discount_pct", "zip", "order_date", "delivered_days"],
               derivations={"total": ["unit_price", "qty"], "subtotal": ["total", "discount_pct"]},
               cycles=[Cycle("place", ["zip", "city"], {"by_zip": ["city"], "by_city": ["zip"]}, "by_zip")],
               partitions=[Partition("late", leakage=["delivered_days"])])
SPLIT = Step("split", "split", params={"kind": "time", "time_column": "order_date", "test": 0.2, "valid": 0.1})
STEPS = [Step("types", "retype", ["zip"], {"to": "nominal"}), Step("ids", "drop_identity"), Step("place", "orient_cycle", params={"cycle": "place"}),
         Step("derived", "drop_derived"), Step("label", "select_partition", params={"label": "late"}), Step("leak", "drop_leakage"), SPLIT,
         Step("calendar", "datetime_expand", ["order_date"], {"cyclic": True}), Step("scale", "scale", params={"kind": "robust", "columns": ["unit_price"]}),
         Step("codes", "encode", ["zip"], {"strategy": "one-hot"})]


def test_orders_recipe(orders):
    shaped = run(orders, STEPS, "row", GEO)
    assert shaped.counts() == {"train": 420, "valid": 60, "test": 120}
    assert {"total", "subtotal", "city", "order_id", "customer_id", "delivered_days", "zip"}.isdisjoint(shaped.columns)
    assert "late" in shaped.columns and "zip=0" in shaped.columns
    assert all(r["passed"] for r in verify.structural(shaped).filter("check <> 'basis intact'").collect())
    assert all(r["in_order"] for r in verify.time_order(shaped.df, "order_date").collect())
    assert verify.split_overlap(shaped.df, "row").first()["in_two_parts"] == 0
    centre = shaped.fitted["scale"]["fitted"]["unit_price"][0]
    train = shaped.df.filter("_part = 'train'").select("row").join(orders, "row")
    assert centre == train.agg(F.percentile("unit_price", 0.5)).first()[0]
    again = run(orders, STEPS, "row", GEO)
    assert row_digest(shaped.df).first() == row_digest(again.df).first()
    steps = {r["step_id"] for r in shaped.lineage().collect()}
    assert {"ids", "derived", "leak", "calendar", "codes"} <= steps


def test_sensor_recipe_sizes(spark):
    k = F.col("id")
    df = spark.range(1440).select(k.alias("reading_id"), F.expr("timestamp'2024-01-01' + make_interval(0,0,0,0,CAST(id AS INT),0,0)").cast("string").alias("ts"),
                                  F.element_at(F.array(F.lit("hill"), F.lit("river"), F.lit("town")), (k % 3 + 1).cast("int")).alias("station"),
                                  (45.0 + k % 3 / 10).alias("lat"), (7.6 + k * 17 % 40 / 1000).alias("lon"), (20 + k % 24).cast("double").alias("reading_c"),
                                  F.when((k % 3 == 0) & (k % 5 < 3), None).otherwise(k % 7).cast("double").alias("calibration"))
    steps = [Step("t", "parse_datetime", ["ts"]), Step("g", "parse_geometry", params={"crs": "EPSG:4326", "lat": "lat", "lon": "lon"}),
             Step("s", "split", params={"kind": "time", "time_column": "ts", "test": 0.2, "valid": 0.1}),
             Step("i", "impute", ["calibration"], {"strategy": "group-median", "by": ["station"], "indicator": True}),
             Step("l", "lag", ["reading_c"], {"lags": [1, 24], "time_column": "ts", "group_by": "station"}), Step("x", "spatial_reproject"),
             Step("f", "spatial_features", params={"radius_m": 500, "features": ["n_neighbours_within", "nearest_distance"]})]
    shaped = run(df, steps, "reading_id")
    assert shaped.counts() == {"train": 1008, "valid": 144, "test": 288}
    assert shaped.df.filter("calibration IS NULL").count() == 0
    assert shaped.df.filter("calibration_missing = 1").count() == df.filter("calibration IS NULL").count()
    nulls = shaped.df.groupBy("_part").agg(F.sum(F.col("reading_c_lag1").isNull().cast("int")).alias("n")).collect()
    assert {r["n"] for r in nulls} == {3}
    assert shaped.df.filter("n_within_500m IS NULL OR nearest_neighbour_m IS NULL").count() == 0


SCALE = Step("sc", "scale")
BAD = {
    "phase order": [SPLIT, Step("d", "dedupe")],
    "fit before split": [Step("i", "impute", ["qty"]), SPLIT],
    "two splits": [SPLIT, Step("s2", "split", params={"kind": "random"})],
    "target encoding without split": [Step("e", "encode", ["zip"], {"strategy": "target"})],
    "unknown operation": [Step("z", "polish")],
    "same id": [Step("a", "dedupe"), Step("a", "drop_identity")],
    "leakage kept": [Step("p", "select_partition", params={"label": "late"}), SCALE],
    "label is no candidate": [Step("p", "select_partition", params={"label": "qty"})],
    "basis dropped": [Step("c", "drop_constant", ["qty"])],
    "half a derivation": [SPLIT, Step("t", "transform", ["total"], {"kind": "log1p"})],
    "custom without phase": [Step("u", "custom", params={"function": lambda d, c: d}, source="user")],
    "lag after random split": [Step("s", "split"), Step("l", "lag", ["qty"])],
    "no crs": [Step("g", "parse_geometry", params={"lat": "a", "lon": "b"})],
}


@pytest.mark.parametrize("name", list(BAD))
def test_bad_recipes_are_refused(orders, name):
    assert check(BAD[name], GEO)
    with pytest.raises(ValueError):
        run(orders, BAD[name], "row", GEO)


def test_label_survives_drops(orders):
    s = run(orders, [Step("p", "select_partition", params={"label": "late"}), Step("l", "drop_leakage", ["late", "delivered_days"])], "row", GEO)
    assert "late" in s.columns and "delivered_days" not in s.columns


@pytest.mark.parametrize("name", ["train-ready", "clean", "basis-only", "custom"])
def test_presets_pass_their_own_guards(name):
    types = {"unit_price": "numeric", "qty": "numeric", "zip": "nominal"}
    assert check(preset(name, GEO, types, label="late", time_column="order_date"), GEO) == []


def test_broken_derivation_is_seen(orders):
    s = run(orders, [Step("b", "bin", ["qty"], {"kind": "custom", "edges": [0, 3, 6, 20], "replace": True})], "row", GEO)
    row = verify.surviving_derivations(s, {"total": "unit_price × qty"}).first()
    assert not row["confirmed"] and row["agree"] < row["rows"]
