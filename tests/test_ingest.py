"""From the log to facts and dead letters, and enrichment with write-back."""

import json
import random

import pytest
from pyspark.sql import functions as F

from wayfleet.operators import intervals
from wayfleet.sources import commits
from wayfleet.sources import observations as live
from wayfleet.streaming import enrichment, ingest, lifecycle

BASE, MIN = 1_700_000_000_000, 60_000


def record(i, at, state, kind, drive=None, charge=None, vehicle=None, car=1):
    groups = {n: g for n, g in (("drive_state", drive), ("charge_state", charge), ("vehicle_state", vehicle)) if g is not None}
    body = {"record_type": kind} | ({"vehicle_data": groups} if kind == live.FULL else {"fields": groups} if kind == live.UPDATE else {"vehicle_data": groups})
    return (i, car, at, state, json.dumps(body))


def run(spark, tmp_path, batches, marks=None, **how):
    lifecycle.configure(spark)
    for rows in batches:
        spark.createDataFrame(rows, live.LOG).coalesce(1).write.mode("append").json(str(tmp_path / "log"))
        log = live.read_observations(spark, str(tmp_path / "log"), stream=True)
        ingest.write(ingest.facts(log, marks, **how), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    path = str(tmp_path / "out")
    letters = sorted((r.car_id, r.observation_id, r.reason, r.payload) for r in ingest.read_letters(spark, path).collect())
    return sorted((tuple(r) for r in ingest.read_facts(spark, path).collect()), key=repr), letters


def test_defects(spark):
    full, update, found = live.FULL, live.UPDATE, live.DISCOVERY
    cases = [
        (None, "no payload"), ("{", "no JSON"), ("[1]", "no object"), ('"text"', "no object"), ("{}", "unknown record type"), ('{"record_type": 7}', "unknown record type"), ('{"record_type": "x"}', "unknown record type"),
        (f'{{"record_type": "{full}"}}', "no vehicle data"), (f'{{"record_type": "{full}", "vehicle_data": "{{}}"}}', "no vehicle data"), (f'{{"record_type": "{update}", "vehicle_data": {{}}}}', "no fields"),
        (f'{{"record_type": "{full}", "vehicle_data": {{}}}}', None), (f'{{"record_type": "{update}", "fields": {{}}}}', None), (f'{{"record_type": "{found}"}}', None),
    ]
    log = spark.createDataFrame([(i, 1, i, "online", body) for i, (body, _) in enumerate(cases)], live.LOG)
    got = {r.observation_id: (r.reason, r.broken, r.payload) for r in ingest.records(log).collect()}
    assert got == {i: (why, why is not None, body if why else None) for i, (body, why) in enumerate(cases)}


def test_records_take_the_fields_of_their_type(spark):
    drive, vehicle = {"shift_state": "D", "speed": 10, "timestamp": BASE}, {"odometer": 100.0, "software_update": {"status": "installing"}}
    log = spark.createDataFrame([record(1, BASE, "Online", live.FULL, drive, None, {"odometer": 100.0}), record(2, BASE, "online", live.DISCOVERY, drive, None, vehicle), record(3, BASE, "online", live.UPDATE, None, {"charging_state": "Charging"}), record(4, BASE, "online", live.FULL, {}, None, vehicle)], live.LOG)
    got = [(r.phase, r.drive_data, r.moving, r.odometer, r.speed) for r in ingest.records(log).orderBy("observation_id").collect()]
    assert got == [("driving", True, True, 160.9344, 16.0), ("online", False, False, None, None), ("charging", False, False, None, None), ("updating", True, False, 160.9344, None)]


def test_a_discovery_record_moves_states_and_closes_sessions(spark, tmp_path):
    move = lambda i, odo: record(i, BASE + i * MIN, "online", live.FULL, {"shift_state": "D", "timestamp": BASE + i * MIN}, None, {"odometer": odo})
    rows = [move(1, 10.0), move(2, 12.0), record(3, BASE + 3 * MIN, "online", live.DISCOVERY), record(4, BASE + 4 * MIN, "asleep", live.DISCOVERY)]
    facts, letters = run(spark, tmp_path, [rows])
    assert [(t[1], t[5], t[6]) for t in facts if t[6] is not None] == [("drive", BASE + MIN, BASE + 2 * MIN), ("state", BASE + MIN, BASE + 4 * MIN)] and letters == []


def log_of(rng, n, cars):
    """Every type of record, stale and implausible updates, and payloads that are no records."""
    rows = []
    for i in range(1, n):
        at, car = BASE + i * MIN, rng.randrange(cars)
        if rng.random() < 0.06:
            rows.append((i, car, at, rng.choice(["online", "asleep"]), rng.choice(["{", "[]", "{}", json.dumps({"record_type": live.FULL, "vehicle_data": 3})])))
            continue
        kind = rng.choice([live.FULL, live.FULL, live.UPDATE, live.UPDATE, live.DISCOVERY])
        drive = {"timestamp": at - rng.choice([0, 0, 3 * MIN, 10 * MIN]) + rng.choice([0, 0, 0, 900_000]), "shift_state": rng.choice(["D", "D", "P", None]), "speed": rng.choice([None, 0, 30]), "latitude": 1.0, "longitude": 2.0}
        charge = {"charging_state": rng.choice(["Charging", "Complete", None, None]), "charge_energy_added": float(i % 40), "battery_level": i % 100}
        vehicle = {"odometer": i * 0.5, "car_version": f"2024.{i // 60}"}
        some = lambda g: g if rng.random() < 0.8 else None
        rows.append(record(i, at, rng.choice(["online"] * 5 + ["asleep", "offline"]), kind, some(drive), some(charge) if rng.random() < 0.4 else None, some(vehicle), car))
    return rows


def by_hand(rows, marks):
    """Facts and letters of a log in plain Python: each car's rows in order, parsed one by one, folded by Car."""
    cars, newest, facts, letters = {}, {}, [], []
    for i, car, at, state, body in sorted(rows):
        c = cars.setdefault(car, lifecycle.Car(None, lifecycle.OFFLINE_MS))
        try:
            root = json.loads(body)
        except ValueError:
            root = None
        kind = root.get("record_type") if isinstance(root, dict) else None
        data = {live.FULL: "vehicle_data", live.UPDATE: "fields"}.get(kind)
        if kind not in (live.FULL, live.UPDATE, live.DISCOVERY) or (data and not isinstance(root.get(data), dict)):
            letters.append((car, i, body))
            list(c.step(at, state, None, None, None, True))
            continue
        groups = root[data] if data else {}
        drive, charge, vehicle = (groups.get(g) for g in ("drive_state", "charge_state", "vehicle_state"))
        get = lambda g, name: (g or {}).get(name)
        when = get(drive, "timestamp") or at
        if kind == live.UPDATE:
            if when > at + 300_000 or when <= newest.get(car, 0):
                continue
            newest[car] = when
        told, speed = get(charge, "charging_state"), get(drive, "speed")
        speed = None if speed is None else int(speed * 1.60934 + 0.5)
        driving = get(drive, "shift_state") in intervals.DRIVING_SHIFTS or (speed or 0) > 0
        phase = state if state != "online" else "charging" if told == "Charging" else "driving" if driving else "online"
        mark = marks.get(car, (0, 0, 0))
        old = [t <= m for t, m in zip((when, at, at), mark, strict=True)]
        place = (None, None) if old[0] else (get(drive, "latitude"), get(drive, "longitude"))
        odo = None if old[0] or get(vehicle, "odometer") is None else round(vehicle["odometer"] * 1.609344, 6)
        data_here = drive is not None and not old[0]
        energy, told = (None, None) if old[1] else (get(charge, "charge_energy_added"), told)
        level = get(charge, "battery_level")
        out = c.step(at, None if all(old) else phase, told, odo, energy, False, None, None if old[2] else get(vehicle, "car_version"), *place, data_here, i, driving and data_here, speed=speed and float(speed) if speed is not None else None, battery_level=None if level is None else float(level))
        facts += [(car, *d) for d in out]
    return facts, letters


def near(rows):
    return sorted((tuple(round(v, 4) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("parts", [1, 3])
def test_the_whole_plan_against_plain_python(spark, tmp_path, parts):
    rows = log_of(random.Random(3), 600, 3)
    marks = {1: (BASE + 90 * MIN, BASE + 60 * MIN, BASE + 120 * MIN)}
    table = spark.createDataFrame([(car, *m) for car, m in marks.items()], ingest.MARKS)
    cut = [rows[len(rows) * p // parts : len(rows) * (p + 1) // parts] for p in range(parts)]
    facts, letters = run(spark, tmp_path, cut, table)
    want, dead = by_hand(rows, marks)
    assert near(facts) == near(want) and {t[1] for t in want} >= {"drive", "charge", "state", "position", "missed_update"}
    assert [(car, i, body) for car, i, _, body in letters] == sorted(dead) and letters


def test_replays_and_repeated_batches_give_no_second_letter(spark, tmp_path):
    good = record(1, BASE, "online", live.FULL, {"shift_state": "D"}, None, {"odometer": 1.0})
    bad = (2, 1, BASE + MIN, "online", "{")
    first = run(spark, tmp_path, [[good, bad], [bad]])
    assert first[1] == [(1, 2, "no JSON", "{")]
    rows = spark.createDataFrame([(1, "quarantine", None, 9, *[None] * 20, "late", "x")], ingest.ROUTED)
    draft = str(tmp_path / "again")
    rows.withColumn("to", F.lit("letters")).write.partitionBy("to").parquet(draft)
    assert not commits.renamed(spark, draft, str(tmp_path / "out" / "batches" / "batch=0"))  # its number is taken
    assert not (tmp_path / "again").exists() and run(spark, tmp_path, [[bad]])[1] == first[1]


def test_a_writer_that_dies_shows_nothing(spark, tmp_path, monkeypatch):
    """A micro-batch that fails between its files and its rename is run again, and readers see it once."""
    bad = [(i, 1, BASE + i, "online", "{") for i in range(1, 4)]
    real = commits.renamed

    def dies(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(commits, "renamed", dies)
    with pytest.raises(Exception, match="lost"):
        run(spark, tmp_path, [bad])
    assert ingest.read_letters(spark, str(tmp_path / "out")).count() == 0
    monkeypatch.setattr(commits, "renamed", real)
    assert [r[1] for r in run(spark, tmp_path, [[bad[0]]])[1]] == [1, 2, 3]


ROW = "entity string, id long, car_id long, payload string"
HOUR = 3_600_000


def heights(spark, tmp_path, now, fails=(), page=100):
    """A pass that gives position i the height 10 * i, but for those that fail."""
    wanted = lambda rows: rows.where(F.get_json_object("payload", "$.height").isNull())
    asked = F.col("id").isin(*fails) if fails else F.lit(False)
    resolve = lambda rows: rows.select("id", F.when(~asked, (F.col("id") * 10).cast("string")).alias("answer"), F.when(asked, "no tile").alias("error"))
    merge = lambda payload, answer: F.concat(F.rtrim(payload, F.lit("}")), F.lit(', "height": '), answer, F.lit("}"))
    return enrichment.run_pass(spark, str(tmp_path / "table"), str(tmp_path / "tries"), "position", wanted, resolve, merge, now, page)


def shown(spark, tmp_path):
    rows = commits.read(spark, str(tmp_path / "table")).where("entity = 'position'").collect()
    return {r.id: json.loads(r.payload).get("height") for r in rows}


def start(spark, tmp_path, n=5):
    rows = [("position", i, 1, '{"at": 1}') for i in range(1, n + 1)] + [("drive", 1, 1, "v")]
    return commits.commit_snapshot(spark.createDataFrame(rows, ROW), str(tmp_path / "table"), 1)


def test_enrichment_writes_back_in_pages_and_tries_failures_again(spark, tmp_path):
    start(spark, tmp_path)
    assert heights(spark, tmp_path, 0, fails=(2,), page=3) == 2
    assert shown(spark, tmp_path) == {1: 10, 2: None, 3: 30, 4: None, 5: None}
    assert heights(spark, tmp_path, HOUR) == 2  # 2 waits
    assert heights(spark, tmp_path, 5 * HOUR) == 0 and shown(spark, tmp_path)[2] is None
    assert heights(spark, tmp_path, 6 * HOUR) == 1 and shown(spark, tmp_path) == {i: 10 * i for i in range(1, 6)}
    assert [(m["rows"], m.get("tag")) for m in commits.manifests(spark, str(tmp_path / "table"))] == [(6, None), (2, "enrichment/position/0"), (2, "enrichment/position/1"), (1, "enrichment/position/2")]
    errors = enrichment.attempts(spark, str(tmp_path / "tries")).where("not resolved").collect()
    assert [(r.id, r.error) for r in errors] == [(2, "no tile")]


def test_an_answer_is_for_the_payload_it_was_made_for(spark, tmp_path, monkeypatch):
    """Between answers and commit one row changes and one goes; the dead pass is finished by the next."""
    base = start(spark, tmp_path, 3)
    table = str(tmp_path / "table")
    with monkeypatch.context() as m:
        m.setattr(enrichment, "write_back", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            heights(spark, tmp_path, 0, fails=(3,))
    assert set(shown(spark, tmp_path).values()) == {None}
    commits.commit_delta(spark.createDataFrame([("position", 1, 1, "upsert", '{"at": 2}'), ("position", 2, 1, "delete", None)], "entity string, id long, car_id long, op string, payload string"), table, 2, base["chain"])
    assert heights(spark, tmp_path, HOUR) == 1  # nothing of the dead pass holds; 1 is asked anew, 3 waits
    assert shown(spark, tmp_path) == {1: 10, 3: None}
    assert json.loads(commits.read(spark, table).where("entity = 'position' AND id = 1").first().payload)["at"] == 2


def test_a_dead_pass_is_finished_once(spark, tmp_path, monkeypatch):
    start(spark, tmp_path, 2)
    with monkeypatch.context() as m:
        m.setattr(commits, "commit_delta", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            heights(spark, tmp_path, 0)
    assert heights(spark, tmp_path, 1) == 2 and heights(spark, tmp_path, 2) == 0
    assert shown(spark, tmp_path) == {1: 10, 2: 20} and len(commits.manifests(spark, str(tmp_path / "table"))) == 2
