"""How the plans of operators grow, and that what makes them grow less changes no result."""

import math

import pandas as pd
from pyspark.sql import functions as F

from wayfleet import queries
from wayfleet.operators import cdc, folds, geo, merkle, quality
from wayfleet.streaming import lifecycle


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def test_rows_of_few_groups_are_not_shuffled_by_group(spark, monkeypatch):
    seen, held = [], merkle.held
    monkeypatch.setattr(merkle, "held", lambda df: seen.append(df) or held(df))
    rows = spark.range(300).select(F.lit("drive").alias("kind"), "id", F.sha2(F.col("id").cast("string"), 256).alias("digest"))
    tree = merkle.hash_tree(rows.unionByName(rows), ["kind"])
    assert tree.where("level = 0").first().n == 300
    leaves = plan(seen[1])
    assert "BroadcastHashJoin" in leaves and "SortMergeJoin" not in leaves


def test_fences_of_one_centre_count_as_steps_of_radius(spark):
    fences = [(i, 10.0 + 20 * (i % 2), 20.0, float(300 + i * 733 % 4000)) for i in range(40)]
    points = [(k, 10.0 + 20 * (k % 2), 20.0 + 0.0013 * k) for k in range(40)]
    f = spark.createDataFrame(fences, "id long, latitude double, longitude double, radius double")
    got = {r.id: r.geofence_id for r in geo.nearest_geofence(spark.createDataFrame(points, "id long, latitude double, longitude double"), f).collect()}

    def metres(a, b):
        h = math.sin(math.radians(b[1] - a[1]) / 2) ** 2 + math.cos(math.radians(a[1])) * math.cos(math.radians(b[1])) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
        return 2 * 6378168.0 * math.asin(math.sqrt(h))

    want = {p[0]: min((metres(p, x), x[0]) for x in fences if metres(p, x) < x[3])[1] for p in points if any(metres(p, x) < x[3] for x in fences)}
    assert got == want
    steps = geo._unrivalled(f.toDF("geofence_id", "fence_latitude", "fence_longitude", "fence_radius")).orderBy("geofence_id").collect()
    assert len(steps) < 15
    for lat in (10.0, 30.0):
        radii = [r.fence_radius for r in steps if r.fence_latitude == lat]
        assert radii == sorted(set(radii))


def test_a_payload_is_parsed_once(spark):
    rows = [("drive", 1, 1, "upsert", '{"start_soc":101,"start_ms":2,"end_ms":1}', 1), ("drive", 2, 1, "upsert", '{"latitude":91,"longitude":"1"}', 1), ("drive", 3, 1, "upsert", '{"start_soc":101', 1), ("drive", 4, 1, "upsert", '[{"start_soc":101}]', 1), ("drive", 5, 1, "upsert", '{"end_soc":{"a":1},"start_soc":"100"}', 1)]
    out = cdc.validate_delta(spark.createDataFrame(rows, "entity string, id long, car_id long, op string, payload string, seq long"))
    assert sorted((r.id, r.rule) for r in out.collect()) == [(1, "interval"), (1, "soc"), (2, "coordinates")]
    told = out._jdf.queryExecution().optimizedPlan().toString()
    assert told.count("json_tuple(") == 1 and "get_json_object" not in told


def test_orphans_come_with_the_other_rules(spark):
    rows = spark.createDataFrame([(1, 1, -1), (2, 9, 5), (3, 9, -1), (4, None, 1), (4, 1, 1)], "id long, drive_id long, speed long")
    drives = spark.createDataFrame([(1,), (1,), (None,)], "id long")
    out = quality.violations("position", rows, {"speed": quality.non_negative("speed")}, (drives, "drive_id", "drive exists"))
    assert sorted((r.id, r.rule) for r in out.collect()) == [(1, "speed"), (2, "drive exists"), (3, "drive exists"), (3, "speed")]


def test_partitions_that_are_spread_stay_apart(spark, sf_dir):
    rows = spark.range(1000).withColumn("key", F.col("id") % 200)
    out = folds.spread(rows, 1000, "key", per=100).groupBy("key").count()
    assert out.rdd.getNumPartitions() == 10 and out.count() == 200
    assert folds.spread(rows.limit(0), 0, "key").count() == 0
    for frame in (queries._lineage(spark, sf_dir)[0], queries._versions(spark, sf_dir)[1], queries.materialisation_report(spark, sf_dir)):
        assert "RepartitionByExpression" in plan(frame)


def test_one_row_of_each_id_is_read_from_one_table(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, "d"), (3, "d")], "id long, x string")
    out = queries._once(rows)
    assert sorted(r.id for r in out.collect()) == [1, 2, 3] and out.columns == ["id", "x"]
    assert "Scan parquet" in plan(out) and "ExistingRDD" not in plan(out)


def test_columns_of_a_fold_are_read_and_built_whole():
    rows = pd.DataFrame({"car_id": 1, "observation_id": [1, 2, 2, 3], "at_ms": [0, 10, 11, 20], "phase": ["driving", "driving", "driving", None], "charging_state": None, "broken": [False, False, False, True], "odometer": [1.0, None, 2.0, None], "energy": 1.0, "why": ["a", "b", "c", "d"]})
    out = lifecycle.Lifecycle(letters=("why",)).folded(1, lifecycle.Car(None, 10), rows)
    assert out["entity"].tolist() == ["drive_position", "drive_position", "quarantine"] and lifecycle.listed(out["why"]) == [None, None, "d"] and lifecycle.listed(out["observation_id"]) == [1, 2, 3]
    assert set(out.dtypes.astype(str)) == {"Int64", "float64", "object"} and out.columns.tolist() == [*lifecycle.OUT_NAMES, "why"]
    none = lifecycle.Lifecycle().folded(1, lifecycle.Car(None, 10), rows.iloc[:0])
    assert len(none) == 0 and none.columns.tolist() == lifecycle.OUT_NAMES
