"""Short scenarios with known results."""

import hashlib
import random
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from wayfleet.functions import scalars as S
from wayfleet.operators import cdc, drives, geo, intervals, merkle, quality, reconcile, relations, sessions
from wayfleet.sources import observations as live
from wayfleet.sources import commits, schema, sinks
from wayfleet.streaming import lifecycle

MIN = 60_000


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_scaled_rounding_and_units(spark):
    r = one(spark, S.scaled_round(F.lit(1.005), 2), S.miles_to_km(F.lit(103.0) - 100, 6), S.mph_to_kmh(F.lit(40.0)))
    assert list(r) == [1.0, 4.828032, 64]


def test_json_fields_are_strict(spark):
    body = F.lit('{"a": 12, "b": "12", "c": 2.5, "d": true, "e": "  ", "f": null, "g": -2.5}')
    r = one(spark, *[f(body, f"$.{k}") for f, k in ((S.int_field, "a"), (S.int_field, "b"), (S.int_field, "c"), (S.int_field, "g"), (S.bool_field, "d"), (S.bool_field, "a"), (S.text_field, "e"), (S.float_field, "f"), (S.timestamp_field, "b"), (S.timestamp_field, "c"))])
    assert list(r) == [12, None, 3, -3, True, None, None, None, 12, None]
    assert one(spark, S.int_field(F.lit("{broken"), "$.a"))[0] is None


def test_firmware_order(spark):
    r = one(spark, S.firmware_newer(F.lit("2026.2 abc"), F.lit("2026.1.9")), S.firmware_newer(F.lit("2026.10"), F.lit("2026.9")), S.firmware_newer(F.lit("2026.x"), F.lit("2026.0")))
    assert list(r) == [True, True, False]


def test_names(spark):
    r = one(spark, S.normalize_model(F.lit(" Model S ")), S.normalize_model(F.lit("modely")), S.normalize_model(F.lit("Cyber ")), S.vehicle_key(F.lit(5), F.lit("V")), S.vehicle_key(F.lit(0), F.lit(" V ")), S.clean_text(F.lit("a\x07b")), S.normalize_efficiency(F.lit(0.15)))
    assert list(r) == ["S", "Y", "Cyber", "eid:5", "vin:V", None, 150.0]
    r = one(spark, *[S.normalize_model(F.lit(m)) for m in ("Model S Plaid", "s", "Lychee", "model3x", "Tamarind")])
    assert list(r) == ["S", "s", "S", "3", "X"]
    r = one(spark, *[S.marketing_name(F.lit(m), F.lit(t), F.lit(raw)) for m, t, raw in (("Model S", "p100d", "Lychee"), ("3", " 74d", "x"), ("S", "100D", "other"), ("models2", "100D", "models2"), ("Y", None, ""))])
    assert list(r) == ["Plaid", "LR AWD", None, "LR+", None]
    for wrong in (S.normalize_efficiency(F.lit(-1.0)), S.normalize_efficiency(F.lit(float("nan"))), S.vehicle_key(F.lit(0), F.lit(" "))):
        with pytest.raises(Exception):  # noqa: B017
            one(spark, wrong)


def test_exact_times_and_numbers(spark):
    r = one(spark, *[S.pg_us(F.lit(t)) for t in ("2000-01-01 00:00:00.5", "infinity", "-infinity", "2000-02-30 00:00:00", "2000-1-1 00:00:00")])
    assert list(r) == [500_000, S.INFINITE_FUTURE, S.INFINITE_PAST, None, None]
    assert list(one(spark, *S.fixed_numeric(F.lit("1.25"), 4), *S.fixed_numeric(F.lit("NaN"), 4))) == [12500, False, None, True]


def test_charge_cost(spark):
    cost = lambda b, u, f, a, x, m, free: S.charge_cost(F.lit(b), F.lit(u).cast("double"), F.lit(f).cast("double"), F.lit(a).cast("double"), F.lit(x).cast("double"), F.lit(m), F.lit(free))
    r = one(spark, cost("per_kwh", 0.3, 2, 10, 12, 30, True), cost("per_kwh", 0.3, 2, 10, 12, 30, False), cost("per_minute", 0.1, 2, 10, 12, 30, False), cost(None, None, None, 10, 12, 30, False))
    more = one(spark, cost("per_kwh", None, 2, 10, None, 30, False), cost("per_kwh", None, None, 10, None, 30, False), cost("per_kwh", 0.5, None, -3, 4, None, False), cost("per_minute", 0.1, None, 1, 1, -1, False), cost("per_minute", None, 2, 1, 1, 5, False), cost("per_kwh", float("nan"), None, 10, None, 30, False), cost("per_kwh", 0.5, float("inf"), 10, None, 30, False))
    assert list(more) == [2.0, None, 2.0, None, None, 0.0, 5.0]
    assert list(one(spark, S.free_session(F.lit(True), F.lit("Tesla V3")), S.free_session(F.lit(True), F.lit("CCS")), S.free_session(F.lit(True), F.lit(None).cast("string")))) == [True, False, False]
    assert r[0] == 0 and r[1] == pytest.approx(5.6) and r[2] == pytest.approx(5.0) and r[3] is None


def test_chain_digest(spark):
    import hashlib

    assert one(spark, S.chain_digest(F.lit("a" * 64), F.lit("b" * 64)))[0] == hashlib.sha256(f"delta-v2/{'a' * 64}:{'b' * 64}".encode()).hexdigest()


def obs(spark, rows, cols="at_ms long, phase string, odometer double"):
    return spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], f"car_id long, observation_id long, {cols}")


def test_state_intervals(spark):
    rows = obs(spark, [(1000, "online"), (1500, "unknown"), (2000, "asleep"), (3000, "online")], "at_ms long, phase string").withColumn("state", intervals.logical_state(F.col("phase")))
    assert sorted(tuple(r)[1:] for r in intervals.state_intervals(rows).collect()) == [("asleep", 2000, 3000), ("online", 1000, 2000), ("online", 3000, None)]


def test_complete_drive(spark):
    rows = obs(spark, [(0, "driving", 160.9344), (MIN, "driving", 162.9), (2 * MIN, "driving", 165.762432), (3 * MIN, "online", None)])
    done = sessions.drive_sessions(rows).withColumns({"drive_id": F.col("session"), "date_ms": F.col("at_ms"), "id": F.col("observation_id"), "speed": F.element_at(F.array(*map(F.lit, (32, 64, 48))), (F.col("observation_id") + 1).cast("int")), "power": F.lit(1)})
    for c in ("outside_temp", "inside_temp", "ideal_km", "rated_km", "battery_level", "latitude", "longitude"):
        done = done.withColumn(c, F.when(F.col("observation_id") != 1, F.lit(20.0) + F.col("observation_id")))
    r = drives.finalize_drives(done).first()
    assert (r.n_positions, r.duration_min, r.distance_km, r.speed_max, r.end_ms, r.inside_temp_avg) == (3, 2, pytest.approx(3 * 1.609344), 64, 2 * MIN, 21.0)


def test_offline_timeout_closes_a_drive(spark):
    early = [(0, "driving", 1.0), (30_000, "offline", None), (MIN, "driving", 2.0)]
    late = [(0, "driving", 1.0), (16 * MIN, "offline", None), (17 * MIN, "driving", 2.0)]
    count = lambda rows: sessions.drive_sessions(obs(spark, rows)).select("session").distinct().count()
    assert count(early) == 1 and count(late) == 2


def test_charge_sessions_follow_explicit_states(spark):
    rows = [(0, "charging", "Charging"), (1, "online", None), (2, "offline", None), (3, "charging", "charging"), (4, "online", "Complete"), (5, "charging", "Starting"), (6, "asleep", None)]
    got = sessions.charge_sessions(obs(spark, rows, "at_ms long, phase string, charging_state string")).orderBy("at_ms").collect()
    assert [(r.at_ms, r.session, r.endpoint) for r in got] == [(0, 1, False), (3, 1, False), (4, 1, True), (5, 2, False), (6, 2, True)]
    assert [r.sample for r in got] == [True, True, True, True, False]
    done = drives.finalize_charges(sessions.charge_sessions(obs(spark, [(r[0] * MIN, *r[1:], float(i)) for i, r in enumerate(rows)], "at_ms long, phase string, charging_state string, energy double")).selectExpr("session AS charge_id", "car_id", "at_ms AS date_ms", "observation_id AS id", "energy", "sample", "CAST(NULL AS double) AS battery_level", "1.0D AS rated_km", "1 AS power", "false AS fast_present"))
    assert [(r.n_samples, r.start_ms, r.end_ms, r.energy_added, r.duration_min) for r in done.orderBy("charge_id").collect()] == [(3, 0, 4 * MIN, 4.0, 4), (1, 5 * MIN, 6 * MIN, 1.0, 1)]


def test_effective_phase_needs_what_is_open(spark):
    cols = "at_ms long, phase string, charging_state string, drive_data boolean"
    rows = [(0, "offline", None, None), (1, "charging", "Charging", False), (2, "offline", None, None), (3, "online", None, False), (4, "online", "Complete", False), (5, "offline", None, None), (6, "driving", None, True), (7, "online", None, False), (8, "offline", None, None), (9, "online", None, True), (10, "offline", None, None), (11, "updating", None, None), (12, "offline", None, None), (13, "charging", None, None), (14, "offline", None, None)]
    got = intervals.effective_phase(sessions.with_open(obs(spark, rows, cols))).orderBy("at_ms").collect()
    assert [r.effective for r in got] == ["offline", "charging", "charging", "charging", "online", "offline", "driving", "driving", "driving", "online", "offline", "updating", "updating", "charging", "offline"]
    car = lifecycle.Car(None, 10**9)
    seen = []
    for at, phase, told, data in rows:
        list(car.step(at, phase, told, None, None, False, drive_data=data))
        seen.append(car.s["phase"])
    assert seen == [r.effective for r in got]


def test_moving_rows_keep_a_drive_open(spark):
    rows = [(0, "driving", True, None), (1, "charging", True, None), (2, "charging", False, None), (3, "driving", None, None), (4, "offline", None, 1 + 16 * MIN)]
    got = sessions.drive_sessions(obs(spark, rows, "at_ms long, phase string, moving boolean, drive_ts long")).orderBy("at_ms").collect()
    assert [(r.at_ms, r.session, r.endpoint) for r in got] == [(0, 1, False), (1, 1, False), (2, 1, True), (3, 2, False)]


def test_charge_delta_and_fallback(spark):
    cols = "id long, charge_id long, car_id long, date_ms long, energy double, power long, phases long, current long, voltage long, battery_level long, rated_km double, fast_present boolean"
    rows = [(i, 1, 1, i * MIN, e, p, None, None, None, 50, 1.0, None) for i, (e, p) in enumerate([(1.0, None), (2.0, 5), (2.5, None), (0.0, None)])]
    samples = spark.createDataFrame(rows, cols)
    assert drives.finalize_charges(samples).first().energy_added == 1.5
    assert drives.energy_used(samples).first().energy_used is None
    assert drives.energy_used_phase_aware(samples).first().energy_used == pytest.approx(5 / 60, abs=1e-4)


def samples(spark, rows):
    return spark.createDataFrame([(i, 1, i * MIN, *r) for i, r in enumerate(rows)], "id long, charge_id long, date_ms long, power double, current double, voltage double, phases long")


def test_phases_and_energy_by_them(spark):
    known = lambda rows: drives.determine_phases(samples(spark, rows)).first().phases_used
    assert known([(11.0, 16.0, 230.0, 3)] * 15) is None and known([(11.0, 16.0, 230.0, 3)] * 16) == 3
    assert known([(11.0, 27.7, 230.0, 3)] * 16) == pytest.approx(3**0.5) and known([(7.4, 32.0, 230.0, 3)] * 16) == 1
    assert known([(9.0, 16.0, 230.0, 3)] * 16) is None and known([(0.0, 16.0, 230.0, 3), (None, 0.0, 230.0, None)] * 9) is None
    used = lambda rows: drives.energy_used_phase_aware(samples(spark, rows)).first().energy_used
    assert used([(7.4, 32.0, 230.0, 3)] * 16) == pytest.approx(15 / 60 * 32 * 230 / 1000, abs=1e-4)
    assert used([(7.4, 32.0, 230.0, 3)] * 5) is None and used([(-5.0, None, None, None), (6.0, None, None, None), (0.0, None, None, None)]) == pytest.approx(0.1)
    assert drives.energy_used(samples(spark, [(-5.0, None, None, None), (6.0, None, None, None), (-1.0, None, None, None), (3.0, None, None, None)])).first().energy_used == pytest.approx(0.1)


def test_stationary_thinning(spark):
    rows = [(0, "online"), (299_999, "online"), (300_000, "online"), (300_001, "charging"), (600_001, "charging")]
    kept = sessions.stationary_positions(obs(spark, rows, "at_ms long, phase string"))
    assert sorted(r.at_ms for r in kept.collect()) == [0, 300_000, 300_001, 600_001]


def test_clock_never_goes_back(spark):
    rows = obs(spark, [(10, 10, 1), (20, 5, 12), (30, 4, 3), (40, None, 50), (50, 13, 1)], "at_ms long, c long, f long")
    got = sessions.monotonic_ts(rows, "c", "f").orderBy("observation_id").collect()
    assert [r.clock for r in got] == [10, 12, 12, 50, 13]
    day = 86_400_000
    rows = obs(spark, [(0, 100 * day, 0), (20 * day, 90 * day, 200 * day), (40 * day, 150 * day, 3), (60 * day, 0, 7)], "at_ms long, c long, f long")
    assert [r.clock // day for r in sessions.monotonic_ts(rows, "c", "f").orderBy("observation_id").collect()] == [100, 200, 200, 200]


def test_missed_update(spark):
    rows = obs(spark, [(0, "online", "2026.1"), (1, "online", "2026.2"), (2, "online", "2026.2")], "at_ms long, phase string, version string")
    assert [(r.at_ms, r.version) for r in intervals.missed_updates(rows).collect()] == [(1, "2026.2")]


def test_geofence_boundary_and_ties(spark):
    fences = spark.createDataFrame([(2, "b", 10.0, 20.0, 100.0), (1, "a", 10.0, 20.0, 100.0), (3, "big", 0.0, 0.0, 6000.0), (4, "dateline", 0.0, 179.999, 1000.0), (5, "pole", 89.99, 0.0, 4000.0)], "id long, name string, latitude double, longitude double, radius double")
    points = spark.createDataFrame([(1, 10.0, 20.0), (2, 10.01, 20.0), (3, 0.0, 0.0), (4, 0.0, -179.999), (5, 89.99, 179.0), (6, None, 1.0)], "id long, latitude double, longitude double")
    got = {r.id: r.geofence_id for r in geo.nearest_geofence(points, fences).collect()}
    assert got == {1: 1, 4: 4, 5: 5}


def test_tiles(spark, tmp_path):
    (tmp_path / "N47E008.hgt").write_bytes((b"\x00\x7b\x80\x00" + b"\x00\x01" * (1201 * 1201 - 3) + b"\x00\x09"))
    grid = live.read_elevation_tiles(spark, str(tmp_path))
    points = spark.createDataFrame([(1, 47.99999, 8.0, None), (2, 47.99999, 8.0009, None), (3, 47.5, 8.5, 7), (4, -1.5, -0.5, None), (5, 47.5, 8.5, None), (6, None, 8.5, None)], "id long, latitude double, longitude double, elevation long")
    got = {r.id: r.elevation for r in geo.elevations(points, grid).collect()}
    assert got == {1: 123, 2: None, 3: 7, 4: None, 5: 1, 6: None}
    assert one(spark, S.tile_name(F.lit(-1.5), F.lit(-0.5)))[0] == "S02W001"


def test_tile_files(spark, tmp_path):
    (tmp_path / "N47E008.hgt").write_bytes((b"\x00\x7b\x80\x00" + b"\x00\x01" * (1201 * 1201 - 2)))
    rows = live.read_elevation_tiles(spark, str(tmp_path)).select("tile", "side", "row", F.slice("cells", 1, 3).alias("c"), F.size("cells").alias("n")).orderBy("row").collect()
    assert len(rows) == 1201 and [r.row for r in rows] == list(range(1201))
    assert tuple(rows[0])[:2] == ("N47E008", 1201) and rows[0].c == [123, -32768, 1] and rows[0].n == 1201


def test_dangling_keys_stop_an_import(spark):
    drives = spark.createDataFrame([(1, 5, 0, 10, 1, 2, 7, None, None, None)], "id long, car_id long, start_ms long, end_ms long, start_position_id long, end_position_id long, start_address_id long, end_address_id long, start_geofence_id long, end_geofence_id long")
    spots = spark.createDataFrame([(1, 5, 1.0, 2.0, 50), (2, 6, 1.0, 2.0, 49)], "id long, car_id long, latitude double, longitude double, battery_level long")
    names = spark.createDataFrame([(7, "here")], "id long, display_name string")
    fences = spark.createDataFrame([], "id long, name string")
    done = relations.project_drive(drives, spots, names, fences)
    assert done.first().n_dangling == 1  # the end is another car's position
    with pytest.raises(Exception, match="another car"):
        relations.require_lookups(done).collect()
    own = spots.withColumn("car_id", F.lit(5).cast("bigint"))
    assert relations.require_lookups(relations.project_drive(drives, own, names, fences)).count() == 1


def test_copy_text(spark):
    df = spark.createDataFrame([('1,\\N,"",x',), ('2,"\\N","a ""b"", c",',), ('3,"q\\"r",1,2,3',)], "line string")
    got = [tuple(r)[1:] for r in live.read_copy_csv(df, "line", ["a", "b", "c", "d"]).orderBy("a").collect()]
    assert got[0] == ("1", None, "", "x", False) and got[1][2] == 'a "b", c' and got[1][3] == "" and got[2][-1]


def test_geocode(spark):
    df = spark.createDataFrame([('{"osm_type":"way","osm_id":"7","display_name":" Here ","lat":"1.5","lon":"2","address":{"city":"X"}}',), ('{"error":"no"}',), ("junk",)], "body string")
    got = live.parse_geocode_json(df).select("valid", "osm_id", "display_name", "latitude", "city").collect()
    assert [tuple(r) for r in got] == [(True, 7, "Here", 1.5, "X"), (False, None, None, None, None), (False, None, None, None, None)]


def test_frames_round_trip_into_the_log(spark):
    df = spark.createDataFrame([('{"tag":"t","timestamp":"1700000000000","value":"10,100,50,7,1,2,3,4,D,5,6,8"}',)], "value string")
    frame = live.parse_stream_frames(df).withColumn("car_id", F.lit(1))
    log = live.frame_payload(frame).withColumn("observation_id", F.lit(1))
    r = live.parsed(log).first()
    assert (r.drive_ts, r.shift_state, r.battery_level, r.elevation, r.odometer, r.latitude) == (1700000000000, "D", 50, None, pytest.approx(160.9344), 2.0)


def version(spark, rows):
    return spark.createDataFrame(rows, "entity string, id long, car_id long, digest string, payload string")


def test_change_capture(spark):
    a = version(spark, [("drive", 1, 1, "x", "p"), ("drive", 2, 1, "y", "q"), ("drive", 3, 1, "z", "r"), ("car", 9, 9, "c", "c")])
    b = version(spark, [("drive", 1, 1, "x", "p"), ("drive", 2, 1, "Y", "Q"), ("drive", 4, 1, "n", "n")])
    delta = cdc.build_delta(a, b, 5)
    assert sorted((r.id, r.op, r.payload) for r in delta.collect()) == [(2, "upsert", "Q"), (3, "delete", None), (4, "upsert", "n")]
    state = {(r.entity, r.id): r.payload for r in cdc.apply_deltas(a, delta).collect()}
    assert state == {("drive", 1): "p", ("drive", 2): "Q", ("drive", 4): "n", ("car", 9): "c"}
    more = delta.unionByName(cdc.build_delta(b, a.where("entity = 'drive'"), 6))
    again = {(r.entity, r.id): r.payload for r in cdc.apply_deltas(a, cdc.compact(more, 0)).collect()}
    assert again == {(r.entity, r.id): r.payload for r in cdc.apply_deltas(a, more).collect()}
    assert cdc.validate_delta(delta).isEmpty() and not cdc.validate_delta(delta.unionByName(delta)).isEmpty()


def test_delta_contract(spark):
    good = '{"start_ms": 1, "end_ms": 2, "start_soc": 50, "latitude": 1.5, "longitude": 2.5}'
    rows = [("drive", 1, 5, "upsert", good, 1), ("drive", 2, 5, "upsert", '{"start_ms": 3, "end_ms": 2}', 1), ("drive", 3, 5, "upsert", '{"end_soc": 101}', 1), ("position", 4, 5, "upsert", '{"latitude": 91, "longitude": 0}', 1), ("position", 5, 5, "upsert", '{"latitude": 1}', 1), ("car", 5, 5, "delete", None, 1), ("drive", 0, 5, "upsert", None, 1), ("drive", 7, 5, "upsert", "junk", 1), ("drive", 7, 5, "delete", None, 1)]
    delta = spark.createDataFrame(rows, "entity string, id long, car_id long, op string, payload string, seq long")
    got = {(r.rule, r.id) for r in cdc.validate_delta(delta).collect()}
    assert got == {("interval", 2), ("soc", 3), ("coordinates", 4), ("coordinates", 5), ("deleted car", 5), ("positive id", 0), ("payload missing", 0), ("upsert and delete", 7)}
    assert {r.rule for r in cdc.validate_delta(delta.where("id = 1"), cdc.ZERO).collect()} == {"parent digest"}
    assert cdc.validate_delta(delta.where("id = 1"), "a" * 64).isEmpty()


def test_snapshot_contract(spark):
    drives = spark.createDataFrame([(1, 5, 10, 20, -1.0, 101)], "id long, car_id long, start_ms long, end_ms long, distance_km double, end_soc long")
    spots = spark.createDataFrame([(1, 5, 1, 10, 1.0, 2.0, 50, 1.0, 1.0, 1, float("nan"))], "id long, car_id long, drive_id long, date_ms long, latitude double, longitude double, battery_level long, odometer double, outside_temp double, speed long, inside_temp double")
    charges = drives.select("id", F.lit(6).cast("bigint").alias("car_id"), "start_ms", "end_ms", F.lit(float("inf")).alias("cost"))
    samples = spark.createDataFrame([(1, 5, 1, 0, 50, 1.0, -2.0)], "id long, car_id long, charge_id long, date_ms long, battery_level long, energy double, power double")
    cars = spark.createDataFrame([(5, " ", "S")], "id long, name string, model string")
    got = {(r.entity, r.rule) for r in quality.validate_snapshot(drives, spots, charges, samples, cars).collect()}
    assert got == {("drive", "distance_km"), ("drive", "end_soc"), ("position", "inside_temp"), ("charge", "cost"), ("charge", "car exists"), ("charge_sample", "positive time"), ("charge_sample", "power"), ("car", "name")}


def chain(n, base="b" * 64):
    """Packs of a sound lineage with n deltas after a base of two packs, and its head."""
    packs, parent = [(1, "base", i, 5, 5, "0" * 64, base, base, f"b{i}", 3, 3) for i in range(2)], base
    for k in range(n):
        digest = f"{k:064x}"
        packs.append((1, "delta", None, 5 + k, 6 + k, parent, commits.chained(parent, digest), digest, f"p{k}", 1, 1))
        parent = packs[-1][6]
    return packs, (1, 5, base, 5 + n, parent)


def breaches(spark, packs, head, **limits):
    return sorted((r.rule, r.to_seq) for r in cdc.lineage_check(spark.createDataFrame(packs, cdc.PACKS), spark.createDataFrame([head], cdc.HEADS), **limits).collect())


def spoilt(packs, at, **columns):
    names = [c.split()[0] for c in cdc.PACKS.split(", ")]
    row = dict(zip(names, packs[at], strict=True)) | columns
    return [*packs[:at], tuple(row.values()), *packs[at + 1 :]]


def test_lineage(spark):
    packs, head = chain(3)
    assert breaches(spark, packs, head) == [] and breaches(spark, *chain(0)) == []
    assert breaches(spark, spoilt(packs, 3, chain="x"), head) == [("chain digest", 7), ("parent digest", 8)]
    assert breaches(spark, spoilt(packs, 3, from_seq=5), head) == [("contiguous", 7)]
    assert breaches(spark, spoilt(packs, 3, pack="p0"), head) == [("unique pack", 6), ("unique pack", 7)]
    assert breaches(spark, spoilt(packs, 1, ordinal=2), head) == [("base pack", 5)]
    assert breaches(spark, spoilt(packs, 4, rows=2), head) == [("declared rows", 8)]
    assert breaches(spark, packs[:-1], head) == [("head", 7)]
    assert breaches(spark, packs[:2], head) == [("head", None)]
    assert breaches(spark, packs[2:], head) == [("base", None)]
    assert breaches(spark, packs, (1, 5, "0" * 64, 8, head[4])) == [("base digest", None), ("parent digest", 6)]
    assert breaches(spark, packs, head, most=4, pack_rows=2) == [("pack rows", 5), ("pack rows", 5), ("too many packs", None), ("too many rows", None)]
    assert cdc.lineage_check(spark.createDataFrame(packs, cdc.PACKS), spark.createDataFrame([], cdc.HEADS)).where("rule = 'no head'").count() == 5


def test_compaction_plans(spark):
    cols = "car_id long, kind string, from_seq long, to_seq long, parent string, chain string, rows long, bytes long"
    packs = lambda car, sizes: [(car, "base", 0, 0, "0", "b", 1, 1), *[(car, "delta", k, k + 1, f"c{k}", f"c{k + 1}", n, 10 * n) for k, n in enumerate(sizes)]]
    rows = packs(1, [1] * 5) + packs(2, [50, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11]) + packs(3, [90] * 12) + packs(4, [90] * 20) + packs(5, [5] * 30)
    plan = {r.car_id: tuple(r)[1:] for r in cdc.compaction_plan(spark.createDataFrame(rows, cols), most=20, max_rows=100, max_bytes=490).collect()}
    assert plan[1] == ("none", *[None] * 6) and plan[3] == ("defer", *[None] * 6) and plan[4] == ("exhausted", *[None] * 6)
    assert plan[2] == ("compact", 7, "c7", 12, 5, 45, 450) and plan[5] == ("compact", 21, "c21", 30, 9, 45, 450)


def feed(spark, rows):
    return spark.createDataFrame(rows, "entity string, id long, car_id long, op string, payload string")


def state(spark, path, **at):
    return sorted((r.entity, r.id, r.payload) for r in commits.read(spark, path, **at).collect())


def test_commits(spark, tmp_path):
    path = str(tmp_path)
    assert commits.head(spark, path) is None
    base = spark.createDataFrame([("drive", i, 1, f"v{i}") for i in range(1, 5)], "entity string, id long, car_id long, payload string")
    first = commits.commit_snapshot(base, path, 10)
    second = commits.commit_delta(feed(spark, [("drive", 2, 1, "upsert", "new"), ("drive", 3, 1, "delete", None)]), path, 11, first["chain"])
    assert second["chain"] == commits.chained(first["chain"], second["digest"]) and (second["from_seq"], second["rows"]) == (10, 2)
    assert state(spark, path) == [("drive", 1, "v1"), ("drive", 2, "new"), ("drive", 4, "v4")] and len(state(spark, path, at_seq=10)) == 4
    with pytest.raises(commits.Stale):  # made on a head that has moved
        commits.commit_delta(feed(spark, [("drive", 9, 1, "upsert", "x")]), path, 12, first["chain"])
    for rows, to_seq in (([], 12), ([("drive", 1, 1, "upsert", None)], 12), ([("car", 1, 1, "delete", None)], 12), ([("drive", 1, 1, "upsert", "x")], 11)):
        with pytest.raises(ValueError):
            commits.commit_delta(feed(spark, rows), path, to_seq, second["chain"])
    assert commits.head(spark, path) == second
    packs, heads = commits.lineage(spark, path)
    assert cdc.lineage_check(packs, heads).isEmpty()
    again = commits.commit_snapshot(base.where("id < 3"), path, 20)
    assert commits.head(spark, path) == again and len(state(spark, path)) == 2


def test_of_two_writers_one_wins_and_a_dead_one_leaves_the_head(spark, tmp_path):
    path = str(tmp_path)
    base = spark.createDataFrame([("drive", 1, 1, "v")], "entity string, id long, car_id long, payload string")
    first = commits.commit_snapshot(base, path, 1)
    ids = [commits.stage(feed(spark, [("drive", 1, 1, "upsert", w)]).withColumn("seq", F.lit(2).cast("long")), path) for w in ("a", "b")]
    assert commits.leftovers(spark, path) == sorted(ids) and state(spark, path) == [("drive", 1, "v")]
    manifests = []
    for id in ids:
        digest, n = commits.pack_digest(commits.staged(spark, path, id))
        manifests.append({"number": 1, "kind": "delta", "data": id, "from_seq": 1, "to_seq": 2, "parent": first["chain"], "digest": digest, "chain": commits.chained(first["chain"], digest), "rows": n})
    with ThreadPoolExecutor(2) as pool:
        ways = [pool.submit(commits.publish, spark, path, m) for m in manifests]
    lost = [w.exception() is not None for w in ways]
    assert sum(lost) == 1 and isinstance(ways[lost.index(True)].exception(), commits.Stale)
    assert state(spark, path) == [("drive", 1, "ab"[lost.index(False)])] and commits.leftovers(spark, path) == [ids[lost.index(True)]]


def test_compaction_keeps_what_is_read(spark, tmp_path):
    path = str(tmp_path)
    top = commits.commit_snapshot(spark.createDataFrame([("drive", i, 1, "v") for i in range(1, 4)], "entity string, id long, car_id long, payload string"), path, 0)
    for k in range(1, 6):
        top = commits.commit_delta(feed(spark, [("drive", k, 1, "upsert", f"n{k}"), ("drive", 1 + k % 2, 1, "delete" if k == 4 else "upsert", None if k == 4 else "m" * k)] if k != 1 else [("drive", 1, 1, "upsert", "n1")]), path, k, top["chain"])
    before, third = state(spark, path), state(spark, path, at_seq=2)
    assert commits.compact(spark, path) is None
    done = commits.compact(spark, path, most=6, max_rows=7)
    assert (done["kind"], done["from_seq"], done["to_seq"]) == ("compact", 2, 5) and state(spark, path) == before and state(spark, path, at_seq=2) == third
    assert [m["to_seq"] for m in commits.live(commits.manifests(spark, path))] == [0, 1, 2, 5]
    assert cdc.lineage_check(*commits.lineage(spark, path)).isEmpty()
    commits.commit_delta(feed(spark, [("drive", 7, 1, "upsert", "x")]), path, 6, done["chain"])
    with pytest.raises(ValueError):
        commits.compact(spark, path, most=4, max_rows=1)


def test_hash_trees(spark):
    row = lambda i, v=0: (i % 2, i, f"{i}:{v}")
    frame = lambda rows: spark.createDataFrame(rows, "lot long, id long, digest string")
    rows = {i: row(i) for i in range(2500)} | {i: (9, i, "x") for i in range(5000, 5003)}
    tree = merkle.hash_tree(frame(list(rows.values())), ["lot"])
    depth = {r.lot: r.level for r in tree.where("leaf").collect()}
    assert depth == {0: 2, 1: 2, 9: 1} and {r.lot: r.n for r in merkle.roots(tree, ["lot"]).collect()} == {0: 1250, 1: 1250, 9: 3}
    later = {k: v for k, v in rows.items() if k not in (10, 12)} | {20: row(20, 1), 21: row(21, 1), 7001: row(7001)} | {i: (9, i, "x") for i in range(8000, 9100)} | {9999: (4, 9999, "new")}
    changed = [(v[0], k) for k in rows.keys() | later.keys() for v in [later.get(k) or rows[k]] if rows.get(k) != later.get(k)]
    got = merkle.refreshed(tree, frame(list(later.values())), spark.createDataFrame(changed, "lot long, id long"), ["lot"])
    want = merkle.hash_tree(frame(list(later.values()) * 2), ["lot"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    spots = {(r.lot, r.prefix) for r in merkle.differing(tree.where("lot < 2"), want.where("lot < 2"), ["lot"]).collect()}
    assert spots == {(lot, hashlib.sha256(str(k).encode()).hexdigest()[:2]) for lot, k in changed if lot < 2}
    assert merkle.differing(want, want, ["lot"]).isEmpty()


def test_evidence_tells_whether_ids_rise(spark):
    rows = lambda ids: spark.createDataFrame([(i, i, p) for p, i in enumerate(ids)], "id long, value long, place long").repartition(4)
    told = lambda ids, place: reconcile.evidence_fingerprint({"a": rows(ids) if place else rows(ids).drop("place"), "b": rows([1, 2])}).first()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert [told(ids, True).increasing for ids in ([1, 5, 9, 12, 40, 41], [1, 5, 4, 12], [1, 1], [None, 3], [], [1, 2, 3, 0])] == [True, False, False, False, True, False]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert told([9, 1, 5], False).increasing and not told([9, 1, 9], False).increasing
    assert told([9, 1, 5], False).fingerprint == told([1, 5, 9], True).fingerprint != told([1, 5, 8], True).fingerprint


def test_batches_hold_their_caps(spark):
    rows = spark.range(1000).select((F.col("id") % 3).alias("car_id"), "id", (F.col("id") % 90 + 10).alias("bytes"))
    got = cdc.batch_changes(rows, 64, 2000, "car_id").groupBy("car_id", "batch").agg(F.count("*").alias("n"), F.sum("bytes").alias("b"), F.min("id").alias("lo"), F.max("id").alias("hi")).orderBy("car_id", "batch").collect()
    assert all(r.n <= 64 and r.b <= 2000 for r in got) and sum(r.n for r in got) == 1000
    assert all(a.hi < b.lo for a, b in zip(got, got[1:], strict=False) if a.car_id == b.car_id)


def greedy(sizes, max_rows, max_bytes):
    batch, rows, total, out = 0, 0, 0, []
    for size in sizes:
        if rows == max_rows or total + size > max_bytes:
            batch, rows, total = batch + 1, 0, 0
        rows, total = rows + 1, total + size
        out.append(batch)
    return out


@pytest.mark.parametrize("max_rows,max_bytes,shape", [(64, 2000, "any"), (7, 10**6, "one"), (10**6, 1000, "one"), (50, 900, "steps"), (700, 40_000, "any"), (3, 90, "zeros")])
def test_batches_are_greedy_over_many_ranges(spark, max_rows, max_bytes, shape):
    rng = random.Random(max_rows)
    size = {"any": lambda i: rng.randrange(1, 200), "one": lambda i: 30, "steps": lambda i: 900 if i % 97 == 0 else 1 + i // 500, "zeros": lambda i: rng.choice([0, 0, 0, 30, 90])}[shape]
    rows = [("a" if i < 1800 else "b" if i < 1810 else "c", i, size(i)) for i in range(2400)]
    frame = spark.createDataFrame(rows, "entity string, id long, bytes long").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        got = {r.id: r.batch for r in cdc.batch_changes(frame, max_rows, max_bytes).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {i: b for e in "abc" for own in [[r for r in rows if r[0] == e]] for (_, i, _), b in zip(own, greedy([r[2] for r in own], max_rows, max_bytes), strict=True)}


def test_small_rows_behind_large_ones_keep_the_cap(spark):
    rows = spark.range(200).selectExpr("'drive' AS entity", "id", "CASE WHEN id < 10 THEN 500000 ELSE 10 END AS bytes")
    got = cdc.batch_changes(rows, 10, 1_000_000).groupBy("batch").agg(F.count("*").alias("n"), F.sum("bytes").alias("b")).orderBy("batch").collect()
    assert all(r.n <= 10 and r.b <= 1_000_000 for r in got) and [r.batch for r in got] == list(range(len(got))) and sum(r.n for r in got) == 200
    with pytest.raises(Exception):  # noqa: B017
        cdc.batch_changes(rows, 10, 400_000).count()
    few = sinks.assign_fragments(rows, "entity", max_rows=4, most=30)
    assert few.groupBy("fragment").count().agg(F.max("count")).first()[0] == 8 and few.agg(F.max("fragment")).first()[0] < 30


def test_fingerprint_ignores_layout(spark):
    rows = spark.range(500).select((F.col("id") % 2).alias("car_id"), "id", F.sha2(F.col("id").cast("string"), 256).alias("digest"))
    a = reconcile.dataset_fingerprint(rows, ["car_id"]).orderBy("car_id").collect()
    assert a == reconcile.dataset_fingerprint(rows.union(rows).repartition(7), ["car_id"]).orderBy("car_id").collect()
    assert a != reconcile.dataset_fingerprint(rows.where("id > 0"), ["car_id"]).orderBy("car_id").collect()


def test_open_rows_and_reads(spark):
    rows = spark.createDataFrame([(1, 1, None), (2, 1, 5), (3, 2, None), (4, 2, None)], "id long, car_id long, end_ms long")
    assert [r.id for r in relations.open_rows(rows).collect()] == [1]
    assert {r.id: r.end_ms for r in relations.union_newest(rows.where("id < 3"), rows.where("id = 1").withColumn("end_ms", F.lit(9).cast("long"))).collect()} == {1: 9, 2: 5}


def test_schema_contract(spark, tmp_path):
    df = spark.createDataFrame([], schema.schema("states"))
    assert schema.differences(df, "states") == [] and schema.differences(df.drop("state"), "states") == ["state: missing instead of StringType()"]
    df.write.parquet(str(tmp_path / "states.parquet"))
    assert schema.read_table(spark, str(tmp_path), "states", car_id=1).count() == 0


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("drive", 1, 7, "upsert", "p"), ("drive", 2, 7, "delete", None)], "entity string, id long, car_id long, op string, payload string").withColumn("seq", F.lit(3).cast("long"))
    sinks.write_delta(rows, str(tmp_path / "d"), 3, "a" * 64)
    with pytest.raises(ValueError, match="parent digest"):
        sinks.write_delta(rows, str(tmp_path / "z"), 4, "0" * 64)
    assert sinks.read_deltas(spark, str(tmp_path / "d")).count() == 2
    with pytest.raises(ValueError):
        sinks.write_delta(rows.limit(0), str(tmp_path / "e"), 4, "0" * 64)
    sinks.write_snapshot({"drive": rows.select("id", "car_id")}, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s" / "drive")).count() == 2
    assert {r.fragment for r in sinks.assign_fragments(rows.select("id", "car_id"), "car_id", max_rows=1).collect()} == {0, 1}


def test_quality_rules(spark):
    rows = spark.createDataFrame([(1, 0.0, 0.0, 101), (2, 91.0, 0.0, 50), (3, None, None, None), (4, 10.0, 10.0, 0)], "id long, latitude double, longitude double, battery_level long")
    got = quality.violations("position", rows, {"coordinates": quality.coordinates(), "soc": quality.soc("battery_level")}).collect()
    assert sorted((r.id, r.rule) for r in got) == [(1, "coordinates"), (1, "soc"), (2, "coordinates")]


def stream(spark, tmp_path, batches, **how):
    """Runs batches of rows one by one through the lifecycle; gives its output."""
    lifecycle.configure(spark)
    out = []
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, lifecycle.IN).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(lifecycle.IN).parquet(str(tmp_path / "in"))
        run = lifecycle.lifecycle_stream(source, **how).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        run.awaitTermination()
        out = spark.read.schema(lifecycle.OUT).parquet(str(tmp_path / "out")).collect()
        del i
    return sorted(tuple(r) for r in out if r.entity is not None)


def row(i, at, phase, odo=None, state=None, energy=None, broken=False, **more):
    more = {"status": None, "version": None, "latitude": None, "longitude": None, "drive_data": True, "moving": None} | dict.fromkeys(lifecycle.MEASURES) | more
    return (1, i, at, phase, state, odo, energy, broken, *more.values())


def test_stream_restarts_and_replays(spark, tmp_path):
    first = [row(1, 0, "driving", 1.0), row(2, MIN, "driving", 3.0)]
    second = [row(2, MIN, "driving", 3.0), row(3, 2 * MIN, "online", 4.0), row(4, 3 * MIN, "charging", None, "Charging", 1.0), row(5, 4 * MIN, "charging", None, "Complete", 5.0), row(6, 5 * MIN, "asleep")]
    split = stream(spark, tmp_path / "a", [first, second])
    assert split == stream(spark, tmp_path / "b", [first + second[1:]])
    assert [(t[1], t[2], t[5], t[6], t[7]) for t in split if t[6] is not None] == [("charge", 1, 3 * MIN, 4 * MIN, 2), ("drive", 1, 0, 2 * MIN, 3), ("state", None, 0, 5 * MIN, None)]
    assert sorted((t[1], t[3]) for t in split if t[6] is None) == [("charge_sample", 4), ("charge_sample", 5), ("drive_position", 1), ("drive_position", 2), ("drive_position", 3)]


def test_repeats_inside_a_batch_count_once(spark, tmp_path):
    rows = [row(1, 0, "driving", 1.0), row(1, 0, "driving", 1.0), row(2, MIN, "asleep"), row(2, MIN, "asleep")]
    assert [t[1] for t in stream(spark, tmp_path, [rows])] == ["drive_position", "state"]  # a drive of one position is none


def test_late_lower_ids_are_left_out_wherever_batches_end(spark, tmp_path):
    a, b, late = row(1, 0, "driving", 1.0), row(3, 2 * MIN, "driving", 2.0), row(2, MIN, "asleep")
    end = row(4, 3 * MIN, "asleep")
    split = stream(spark, tmp_path / "a", [[a, b], [late, end]])
    assert [t[1] for t in split] == ["drive", "drive_position", "drive_position", "state"]
    assert stream(spark, tmp_path / "b", [[b, a, end]]) == split


def test_sessions_need_drive_data_to_close():
    car = lifecycle.Car(None, lifecycle.OFFLINE_MS)
    rows = [(0, "driving", 1.0, True), (MIN, "driving", 2.0, True), (2 * MIN, "online", None, False), (3 * MIN, "online", 3.0, True)]
    out = [done for at, phase, odo, data in rows for done in car.step(at, phase, None, odo, None, False, drive_data=data)]
    assert [(d[0], d[4], d[5], d[6]) for d in out if d[0] == "drive"] == [("drive", 0, 3 * MIN, 3)]


def test_stream_starts_from_seeds(spark, tmp_path):
    names = [c.split()[0] for c in lifecycle.STATE.split(", ")]
    known = {"last_id": 5, "clock": MIN, "phase": "driving", "state": "online", "since": 0, "drive_no": 4, "drive_start": 0, "drive_last": MIN, "drive_n": 2, "drive_odometer_first": 1.0, "drive_odometer_last": 2.0, "drive_at": MIN}
    seeds = spark.createDataFrame([(1, *(known.get(n) for n in names))], f"car_id long, {lifecycle.STATE}")
    got = stream(spark, tmp_path, [[row(5, MIN, "driving", 9.0), row(6, 2 * MIN, "asleep")]], seeds=seeds)
    assert [(t[1], t[2], t[5], t[6], t[7], t[9]) for t in got] == [("drive", 4, 0, MIN, 2, 2.0), ("state", None, 0, 2 * MIN, None, None)]


def test_broken_payload_drops_what_is_open():
    car = lifecycle.Car(None, lifecycle.OFFLINE_MS)
    rows = [(0, "driving", None, 1.0, None, False), (1, "driving", None, 2.0, None, False), (2, None, None, None, None, True), (3, "online", None, None, None, False), (4, "service", None, None, None, False)]
    assert [done[0] for r in rows for done in car.step(*r) if done[0] != "drive_position"] == ["quarantine"]


def test_forced_close_keeps_the_last_position():
    car = lifecycle.Car(None, lifecycle.OFFLINE_MS)
    rows = [(0, "driving", None, 1.0, None, False), (5, "driving", None, 2.0, None, False), (99, "service", None, None, None, False)]
    assert [(done[0], *done[4:7]) for r in rows for done in car.step(*r) if done[0] == "drive"] == [("drive", 0, 5, 2)]


def test_forced_close_ends_a_charge_at_its_time_and_leaves_the_car_online():
    car = lifecycle.Car(None, lifecycle.OFFLINE_MS)
    rows = [(0, "charging", "Charging", None, 1.0, False), (MIN, "charging", "Charging", None, 2.5, False), (10 * MIN, "service", None, None, None, False)]
    out = [done for r in rows for done in car.step(*r)]
    assert [(d[0], *d[4:9]) for d in out if d[0] == "charge"] == [("charge", 0, 10 * MIN, 2, 1.0, 2.5)]
    assert car.s["phase"] == "online" and list(car.step(11 * MIN, "offline", None, None, None, False))[0][:1] == ("state",)


@pytest.mark.parametrize("last,ended", [((10 * MIN, "online", "Idle", None, 3.0, False), True), ((10 * MIN, "asleep", None, None, 3.0, False), True), ((10 * MIN, "online", None, None, 3.0, False), False), ((10 * MIN, "asleep", "Complete", None, 3.0, False), True)])
def test_a_charge_ends_at_the_row_that_closes_it(last, ended):
    car = lifecycle.Car(None, lifecycle.OFFLINE_MS)
    rows = [(0, "charging", "Charging", None, 1.0, False), (MIN, "charging", "Charging", None, 2.5, False), last]
    out = [d for r in rows for d in car.step(*r)]
    terminal = last[2] == "Complete"
    assert [(*d[4:7], d[9 + lifecycle.FACTS.index("energy_added")], d[9 + lifecycle.FACTS.index("duration_min")]) for d in out if d[0] == "charge"] == ([(0, 10 * MIN, 2 + terminal, 2.0, 10)] if ended else [])
    assert sum(d[0] == "charge_sample" for d in out) == 2 + terminal


@pytest.mark.parametrize("odometers,given", [((1.0, 1.0), 0), ((None, None), 0), ((1.0, 1.005), 0), ((1.0, 1.02), 1), ((1.0, None), 0)])
def test_short_and_unmeasured_drives_are_none(odometers, given):
    car = lifecycle.Car(None, lifecycle.OFFLINE_MS)
    rows = [(0, "driving", None, odometers[0], None, False), (MIN, "driving", None, odometers[1], None, False), (2 * MIN, "asleep", None, None, None, False)]
    assert sum(d[0] == "drive" for r in rows for d in car.step(*r)) == given


def test_gated_rows_keep_the_phase():
    car = lifecycle.Car(None, lifecycle.OFFLINE_MS)
    rows = [(0, "charging", "Charging", None, 1.0, False), (1, None, None, None, None, False), (2, "offline", None, None, None, False), (3, "asleep", None, None, None, False)]
    out = [(d[0], *d[3:6]) for r in rows for d in car.step(*r) if d[0] in ("state", "charge")]
    assert out == [("charge", None, 0, 3), ("state", "online", 0, 3)]


def test_a_car_that_moves_while_it_charges_keeps_its_drive():
    car = lifecycle.Car(None, lifecycle.OFFLINE_MS)
    rows = [(0, "driving", None, 1.0, True), (MIN, "charging", None, 2.0, True), (2 * MIN, "charging", None, 3.0, False)]
    out = [d for at, phase, told, odo, moving in rows for d in car.step(at, phase, told, odo, None, False, moving=moving)]
    assert [(d[4], d[5], d[6]) for d in out if d[0] == "drive"] == [(0, 2 * MIN, 3)]


def test_facts_of_a_streamed_drive():
    car = lifecycle.Car(None, lifecycle.OFFLINE_MS)
    rows = [(0, 1.0, 10.0, 5.0, 80.0, 300.0, 20.0), (MIN, None, 30.0, -8.0, None, 250.0, None), (2 * MIN, 3.5, 20.0, None, 78.0, None, 22.0)]
    out = [d for at, odo, speed, power, soc, ideal, temp in rows for d in car.step(at, "driving", None, odo, None, False, speed=speed, power=power, battery_level=soc, ideal_km=ideal, outside_temp=temp)]
    out += car.step(3 * MIN, "asleep", None, None, None, False)
    got = dict(zip(lifecycle.FACTS, next(d for d in out if d[0] == "drive")[9:], strict=True))
    assert {k: v for k, v in got.items() if v is not None} == {"distance_km": 2.5, "duration_min": 2, "speed_max": 30.0, "power_max": 5.0, "power_min": -8.0, "start_soc": 80.0, "end_soc": 78.0, "start_ideal_km": 300.0, "end_ideal_km": 300.0, "outside_temp_avg": 21.0}


@pytest.mark.parametrize("most", [7, 10_000])
def test_rows_put_aside_give_the_same(spark, tmp_path, most, monkeypatch):
    """One car with all rows in one micro-batch, in any order: pieces of a few rows, and all at once."""
    rng = random.Random(5)
    phases = ["driving", "online", "charging", "asleep", "offline"]
    rows = [row(5000 * i, i * MIN, rng.choice(phases), float(i), rng.choice([None, "Charging", "Complete"]), float(i), latitude=1.0, longitude=1.0) for i in range(1, 300)]
    car, want = lifecycle.Car(None, lifecycle.OFFLINE_MS), []
    names = [c.split()[0] for c in lifecycle.IN.split(", ")]
    for r in rows:
        r = dict(zip(names, r, strict=True))
        r["charging"], r["id"] = r.pop("charging_state"), r.pop("observation_id")
        want += [(r["car_id"], *d) for d in car.step(r.pop("at_ms"), **{k: v for k, v in r.items() if k != "car_id"})]
    rng.shuffle(rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)
    try:
        got = stream(spark, tmp_path, [rows])
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_import_gate_goes_by_group(spark):
    rows = spark.createDataFrame([row(1, 10, "driving", 1.0, "Charging", 1.0, version="v"), row(2, 30, "driving", 1.0, "Charging", 1.0, version="v"), row(3, 4, "asleep", version="v")], lifecycle.IN)
    marks = spark.createDataFrame([(1, 20, 20, 5)], "car_id long, drive_ms long, charge_ms long, vehicle_ms long")
    got = lifecycle.gate(rows, marks).orderBy("observation_id").collect()
    assert [(r.phase, r.charging_state, r.odometer, r.version, r.drive_data) for r in got] == [("driving", None, None, "v", False), ("driving", "Charging", 1.0, "v", True), (None, None, None, None, False)]
    timed = rows.where("observation_id = 1").withColumn("drive_ts", F.lit(25).cast("long"))
    assert [(r.phase, r.charging_state, r.odometer) for r in lifecycle.gate(timed, marks).collect()] == [("driving", None, 1.0)]


def test_stale_frames_are_left_out(spark, tmp_path):
    lifecycle.configure(spark)
    base = 1_700_000_000_000
    cols = "car_id long, received_id long, ts_ms long, received_ms long"
    batches = [[(1, 1, base, base), (1, 2, base - 5, base), (1, 3, base + 10, base), (1, 4, base + 10, base), (2, 5, 5, base)], [(1, 6, base + 9, base), (1, 7, base + 11, base), (1, 8, base + 400_000, base)]]
    for rows in batches:
        spark.createDataFrame(rows, cols).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(cols).parquet(str(tmp_path / "in"))
        lifecycle.fresh_frames(source).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.received_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 3, 7]


def test_publications_are_bounded_and_repeats_do_nothing(spark, tmp_path):
    path, cols = str(tmp_path / "table"), "entity string, id long, car_id long, op string, payload string"
    base = commits.commit_snapshot(spark.createDataFrame([("drive", 99, 1, "v")], "entity string, id long, car_id long, payload string"), path, 100)
    rows = spark.range(1, 26).selectExpr("'drive' AS entity", "id", "1L AS car_id", "'upsert' AS op", "'p' AS payload")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema(cols).parquet(str(tmp_path / "in"))
    lifecycle.publish(source(), path, str(tmp_path / "cp"), most=10).awaitTermination()
    log = commits.manifests(spark, path)
    assert [(m["to_seq"], m["rows"], m.get("tag")) for m in log] == [(100, 1, None), (101, 10, "0/0"), (102, 10, "0/1"), (103, 5, "0/2")] and log[1]["parent"] == base["chain"]
    lifecycle.publish(source(), path, str(tmp_path / "lost checkpoint"), most=10).awaitTermination()  # the same batch tried again
    assert commits.manifests(spark, path) == log and commits.read(spark, path).count() == 26


def test_enrichment_waits_after_a_failure(spark):
    ids = spark.range(5)
    tried = spark.createDataFrame([(1, 0, True), (2, 100, False), (3, 0, False)], "id long, failed_ms long, resolved boolean")
    assert sorted(r.id for r in lifecycle.enrichment_pass(ids, tried, lifecycle.RETRY_MS + 50).collect()) == [0, 3, 4]
