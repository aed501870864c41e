"""Imports: whole results, checks that refuse, and the order of what is shown."""

import os

import pytest
from pyspark.sql import functions as F

from wayfleet.operators import imports

SPOT = "id long, car_id long, drive_id long, latitude double, longitude double, battery_level long"
DRIVE = "id long, car_id long, start_ms long, end_ms long, start_position_id long, end_position_id long, start_address_id long, end_address_id long, start_geofence_id long, end_geofence_id long"
SAMPLE = "id long, charge_id long, date_ms long, energy double, power long, battery_level long, ideal_km double, fast_present boolean, fast_type string, phases long, current long, voltage long, rated_km double"
FENCE = "id long, name string, billing_type string, cost_per_unit double, session_fee double"


def tables(spark, **other):
    rows = {
        "cars": ([(1, "a", "models", "100d", 0.15), (2, None, None, None, None)], "id long, name string, model string, trim string, efficiency double"),
        "drives": ([(1, 1, 0, 10, 1, 2, 7, None, None, 3), (2, 1, 20, None, 99, None, None, None, None, None), (3, 2, 0, 10, None, None, None, None, None, None)], DRIVE),
        "positions": ([(2, 1, 1, 1.5, 2.5, 40), (1, 1, 1, 1.0, 2.0, 50), (3, 1, 2, 1.0, 2.0, 39), (4, 1, None, 1.0, 2.0, 39), (5, 2, 3, 1.0, 2.0, 39)], SPOT),
        "charges": ([(1, 1, 100, 200, 4, 7, 3), (2, 2, 100, None, None, None, None)], "id long, car_id long, start_ms long, end_ms long, position_id long, address_id long, geofence_id long"),
        "samples": ([(1, 1, 90, 1.0, 5, 50, 1.0, True, "x", 1, 1, 230, 1.0), (2, 1, 210, 3.0, 5, 60, 1.0, True, "x", 1, 1, 230, 1.0), (3, 9, 1, None, None, None, None, None, None, None, None, None, None)], SAMPLE),
        "states": ([(1, 1, "online", 50, None), (2, 1, "asleep", 10, 50)], "id long, car_id long, state string, start_ms long, end_ms long"),
        "updates": ([(1, 1, 50, 60, " 2024.2 "), (2, 1, 10, 20, "2024.1"), (3, 1, 70, None, "2024.3"), (4, 1, 70, 80, " "), (5, 2, 9, 8, "1")], "id long, car_id long, start_ms long, end_ms long, version string"),
        "addresses": ([(7, "here", "home")], "id long, display_name string, name string"),
        "geofences": ([(3, "yard", "per_kwh", 0.3, 1.0)], FENCE),
    } | other
    return {name: spark.createDataFrame(*r) if isinstance(r, tuple) else r for name, r in rows.items()}


def test_an_import_is_whole_counted_and_in_order(spark, tmp_path):
    report = {r.counter: r.n for r in imports.import_history(tables(spark), str(tmp_path), "all").collect()}
    assert report == {
        "completed_drives": 2, "skipped_open_drives": 1, "skipped_unattached_positions": 1, "projected_positions": 4, "projected_charges": 2, "projected_charge_samples": 2,
        "projected_states": 2, "projected_updates": 2, "skipped_incomplete_updates": 3, "logical_rows": 2 + 2 + 4 + 2 + 2 + 2 + 2,
    }
    read = lambda entity: imports.read_import(spark, str(tmp_path), "all", entity)
    assert {r.counter: r.n for r in read("report").collect()} == report
    assert [r.id for r in read("position").coalesce(1).collect()] == [1, 2, 4, 5]
    assert [r.id for r in read("state").coalesce(1).collect()] == [2, 1] and [(r.id, r.version) for r in read("update").coalesce(1).collect()] == [(2, "2024.1"), (1, "2024.2")]
    drive = read("drive").where("id = 1").first()
    assert (drive.start_latitude, drive.end_soc, drive.start_address, drive.end_geofence) == (1.0, 40, "here", "yard")
    charge = read("charge").where("id = 1").first()
    assert (charge.start_ms, charge.end_ms, charge.start_latitude, charge.address, charge.location_name, charge.cost_per_unit, charge.energy_added) == (90, 210, 1.0, "here", "home", 0.3, 2.0)
    assert {r.id: r.firmware_version for r in read("car").collect()} == {1: "2024.2", 2: None}
    assert not set(imports.FLAGS) & set(read("drive").columns)
    with pytest.raises(imports.Refused, match="already"):
        imports.import_history(tables(spark), str(tmp_path), "all")


def test_one_car_of_many(spark, tmp_path):
    report = {r.counter: r.n for r in imports.import_history(tables(spark), str(tmp_path), "two", 2).collect()}
    assert report["logical_rows"] == 1 + 1 + 1 + 1 and report["projected_charge_samples"] == 0 and report["skipped_incomplete_updates"] == 1
    with pytest.raises(imports.Refused, match="selected car"):
        imports.import_history(tables(spark), str(tmp_path), "nine", 9)


def test_what_breaks_a_rule_refuses_the_import(spark, tmp_path):
    good = tables(spark)
    twice = lambda name, n: good[name].unionByName(good[name].where(F.col("id") == n))
    changed = {
        "updates": twice("updates", 3), "charges": good["charges"].withColumn("position_id", F.lit(5).cast("bigint")),  # another car's position for 1
        "drives": good["drives"].withColumns({"id": F.when(F.col("id") != 2, F.col("id")), "start_geofence_id": F.when(F.col("id") == 1, F.lit(8).cast("bigint")), "start_position_id": F.when(F.col("id") == 1, F.lit(5).cast("bigint"))}),
        "states": good["states"].withColumn("state", F.when(F.col("id") == 1, "driving").otherwise(F.col("state"))),
    }
    doubled = {"positions": twice("positions", 5), "geofences": twice("geofences", 3)}
    findings = [
        [("charge", "keys name nothing", 1), ("drive", "keys name nothing", 2), ("drive", "rows have no positive id", 1), ("state", "states are outside their domain", 1), ("update", "rows repeat an id", 1)],
        [("charge", "rows repeat an id", 1), ("drive", "rows repeat an id", 1), ("geofence", "ids are repeated or not positive", 1), ("position", "rows repeat an id", 1)],
    ]
    for other, want in zip((changed, doubled), findings, strict=True):
        with pytest.raises(imports.Refused) as told:
            imports.import_history(good | other, str(tmp_path), "x")
        assert sorted(told.value.findings) == want
    assert not os.path.exists(tmp_path / "x") and not os.listdir(tmp_path / "draft")


def test_empty_tables(spark, tmp_path):
    none = {name: t.where("false") for name, t in tables(spark).items()}
    report = imports.import_history(none, str(tmp_path), "none").collect()
    assert {r.n for r in report} == {0} and imports.read_import(spark, str(tmp_path), "none", "drive").count() == 0
