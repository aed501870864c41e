"""Registered queries of the telemetry operators, on the adapters' frames, and their DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfleet.functions import scalars as S
from wayfleet.operators import cdc, drives, folds, geo, imports, intervals, merkle, quality, reconcile, relations, sessions
from wayfleet.plans import adapters as A
from wayfleet.plans import more_queries
from wayfleet.plans.adapters import with_frames
from wayfleet.sources import observations as live
from wayfleet.sources import schema
from wayfleet.streaming import enrichment, ingest, lifecycle

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
HOUR = 3_600_000


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Query]:
    return QUERIES | more_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    return SQL | more_queries.SQL


# Observations -----------------------------------------------------------------------------------

STATED = with_frames("observations") + """, stated AS (SELECT *, CASE WHEN phase IN ('online', 'driving', 'charging') THEN 'online' ELSE phase END AS state FROM observations WHERE phase IS NOT NULL),
  changed AS (SELECT *, lag(state) OVER (PARTITION BY car_id ORDER BY at_ms, observation_id) AS before FROM stated),
  intervals AS (SELECT car_id, state, at_ms AS start_ms, lead(at_ms) OVER (PARTITION BY car_id ORDER BY at_ms, observation_id) AS end_ms FROM changed WHERE before IS DISTINCT FROM state)"""


def _stated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.observations(spark, sf_dir).withColumn("state", intervals.logical_state(F.col("phase")))


@query(STATED + " SELECT * FROM intervals")
def state_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.state_intervals(_stated(spark, sf_dir))


@query(STATED + " SELECT car_id, state, CAST(sum(coalesce(end_ms - start_ms, 0)) AS BIGINT) AS closed_ms, count(*) AS n_intervals, count(*) FILTER (end_ms IS NULL) AS n_open FROM intervals GROUP BY ALL")
def time_in_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.time_in_state(state_intervals(spark, sf_dir))


@query(with_frames("observations") + """, w AS (SELECT *, max(CASE WHEN phase = 'driving' THEN at_ms END) OVER (PARTITION BY car_id ORDER BY at_ms, observation_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM observations),
  k AS (SELECT *, CASE WHEN phase = 'driving' THEN 'in' WHEN phase IN ('asleep', 'updating', 'online', 'charging') THEN 'close' WHEN phase = 'offline' AND at_ms - last >= 7200000 THEN 'close' END AS kind FROM w),
  b AS (SELECT *, lag(kind) OVER (PARTITION BY car_id ORDER BY at_ms, observation_id) AS before FROM k WHERE kind IS NOT NULL),
  s AS (SELECT *, sum(CASE WHEN kind = 'in' AND before IS DISTINCT FROM 'in' THEN 1 ELSE 0 END) OVER (PARTITION BY car_id ORDER BY at_ms, observation_id ROWS UNBOUNDED PRECEDING) AS session FROM b)
  SELECT car_id, CAST(session AS BIGINT) AS session, count(*) AS n_rows, count(*) FILTER (kind = 'close') AS n_endpoints, min(at_ms) AS start_ms, max(at_ms) AS end_ms FROM s
  WHERE kind = 'in' OR (before = 'in' AND phase IN ('online', 'charging')) GROUP BY ALL""")
def drive_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two hours stand for the offline time-out, as these observations lie hours apart."""
    rows = sessions.drive_sessions(A.observations(spark, sf_dir), offline_ms=2 * HOUR)
    return rows.groupBy("car_id", "session").agg(F.count("*").alias("n_rows"), F.count_if("endpoint").alias("n_endpoints"), F.min("at_ms").alias("start_ms"), F.max("at_ms").alias("end_ms"))


def _charging_state() -> Column:
    return F.when(F.col("phase") == "charging", "Charging").when(F.col("soc") % 10 == 0, "Complete").when((F.col("phase") == "online") & (F.col("soc") % 2 == 0), "Idle")


@query(with_frames("observations") + """, c AS (SELECT *, CASE WHEN phase = 'charging' THEN 'charging' WHEN soc % 10 = 0 THEN 'complete' WHEN phase = 'online' AND soc % 2 = 0 THEN 'idle' END AS cs FROM observations),
  k AS (SELECT *, CASE WHEN phase IN ('asleep', 'updating') THEN 'close' WHEN cs = 'charging' THEN 'in' WHEN cs = 'complete' THEN 'close' WHEN cs IS NOT NULL AND phase = 'online' THEN 'close' END AS kind FROM c),
  b AS (SELECT *, lag(kind) OVER (PARTITION BY car_id ORDER BY at_ms, observation_id) AS before FROM k WHERE kind IS NOT NULL),
  s AS (SELECT *, sum(CASE WHEN kind = 'in' AND before IS DISTINCT FROM 'in' THEN 1 ELSE 0 END) OVER (PARTITION BY car_id ORDER BY at_ms, observation_id ROWS UNBOUNDED PRECEDING) AS session FROM b)
  SELECT car_id, CAST(session AS BIGINT) AS session, count(*) AS n_rows, count(*) FILTER (kind = 'close') AS n_endpoints, count(*) FILTER (kind = 'in' OR cs = 'complete') AS n_samples, min(at_ms) AS start_ms, max(at_ms) AS end_ms FROM s WHERE kind = 'in' OR before = 'in' GROUP BY ALL""")
def charge_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sessions.charge_sessions(A.observations(spark, sf_dir).withColumn("charging_state", _charging_state()))
    return rows.groupBy("car_id", "session").agg(F.count("*").alias("n_rows"), F.count_if("endpoint").alias("n_endpoints"), F.count_if("sample").alias("n_samples"), F.min("at_ms").alias("start_ms"), F.max("at_ms").alias("end_ms"))


@query(with_frames("observations") + " SELECT observation_id, car_id, last_value(power IGNORE NULLS) OVER w AS power, last_value(version IGNORE NULLS) OVER w AS version FROM observations WINDOW w AS (PARTITION BY car_id ORDER BY at_ms, observation_id ROWS UNBOUNDED PRECEDING)")
def fill_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.fill_sparse(A.observations(spark, sf_dir), "power", "version").select("observation_id", "car_id", "power", "version")


@query(with_frames("observations") + """, v AS (SELECT *, lag(version) OVER (PARTITION BY car_id ORDER BY at_ms, observation_id) AS before FROM observations WHERE version IS NOT NULL)
  SELECT car_id, at_ms, version, before FROM v WHERE CAST(split_part(version, '.', 2) AS BIGINT) > CAST(split_part(before, '.', 2) AS BIGINT)""")
def missed_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.missed_updates(A.observations(spark, sf_dir))


@query(with_frames("observations") + """, e AS (SELECT *, CASE soc % 10 WHEN 0 THEN 'start' WHEN 1 THEN 'cancel' ELSE CASE WHEN phase NOT IN ('asleep', 'offline') AND version IS NOT NULL THEN 'done' END END AS event FROM observations),
  b AS (SELECT *, lag(event) OVER (PARTITION BY car_id ORDER BY at_ms, observation_id) AS before FROM e WHERE event IS NOT NULL),
  n AS (SELECT *, lead(event) OVER w AS next, lead(at_ms) OVER w AS next_ms, lead(CASE WHEN phase NOT IN ('asleep', 'offline') THEN version END) OVER w AS next_version FROM b WHERE event <> 'start' OR before IS DISTINCT FROM 'start' WINDOW w AS (PARTITION BY car_id ORDER BY at_ms, observation_id))
  SELECT car_id, at_ms AS start_ms, next_ms AS end_ms, next_version AS version FROM n WHERE event = 'start' AND (next IS NULL OR next = 'done')""")
def software_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("soc") % 10 == 0, "installing").when(F.col("soc") % 10 == 1, "available")
    return intervals.software_updates(A.observations(spark, sf_dir).withColumn("status", status))


PARKED = ", rows AS (SELECT *, phase <> 'charging' OR soc % 3 <> 0 AS drive_data, CASE WHEN soc % 7 <> 0 THEN 10.0 END AS latitude FROM observations)"


LIFECYCLE = with_frames("observations").replace("WITH", "WITH RECURSIVE", 1) + PARKED + """, o AS (SELECT *, phase = 'driving' OR coalesce(phase = 'charging' AND soc % 11 = 0, false) AS moving, CASE WHEN phase = 'charging' THEN 'charging' WHEN soc % 10 = 0 THEN 'complete' WHEN phase = 'online' AND soc % 2 = 0 THEN 'idle' END AS cs, CASE soc % 10 WHEN 3 THEN 'installing' WHEN 4 THEN 'available' END AS status,
    max(CASE WHEN phase = 'driving' THEN at_ms END) OVER (PARTITION BY car_id ORDER BY at_ms, observation_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS driven FROM rows),
  k AS (SELECT *, CASE WHEN phase = 'driving' THEN 'in' WHEN phase = 'asleep' OR (phase IN ('online', 'charging') AND coalesce(drive_data, false) AND NOT moving) OR (phase = 'offline' AND at_ms - driven >= 7200000) THEN 'close' END AS dk,
    CASE WHEN phase = 'asleep' THEN 'close' WHEN cs = 'charging' THEN 'in' WHEN cs = 'complete' OR (phase = 'online' AND cs IS NOT NULL) THEN 'close' END AS ck FROM o),
  d0 AS (SELECT *, lag(dk) OVER w AS before FROM k WHERE dk IS NOT NULL WINDOW w AS (PARTITION BY car_id ORDER BY at_ms, observation_id)),
  d1 AS (SELECT *, CAST(sum(CASE WHEN dk = 'in' AND before IS DISTINCT FROM 'in' THEN 1 ELSE 0 END) OVER (PARTITION BY car_id ORDER BY at_ms, observation_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM d0),
  d AS (SELECT *, power AS value FROM d1 WHERE dk = 'in' OR (before = 'in' AND phase IN ('online', 'charging') AND power IS NOT NULL)),
  dclosed AS (SELECT DISTINCT car_id, session FROM d1 WHERE dk = 'close' AND before = 'in'),
  c0 AS (SELECT *, lag(ck) OVER w AS before FROM k WHERE ck IS NOT NULL WINDOW w AS (PARTITION BY car_id ORDER BY at_ms, observation_id)),
  c1 AS (SELECT *, CAST(sum(CASE WHEN ck = 'in' AND before IS DISTINCT FROM 'in' THEN 1 ELSE 0 END) OVER (PARTITION BY car_id ORDER BY at_ms, observation_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM c0),
  c AS (SELECT *, ck = 'in' OR cs = 'complete' AS sample FROM c1 WHERE ck = 'in' OR before = 'in'),
  cclosed AS (SELECT DISTINCT car_id, session FROM c1 WHERE ck = 'close' AND before = 'in'),
  open AS (SELECT *, last_value(dk IGNORE NULLS) OVER w = 'in' AS drive_open, last_value(ck IGNORE NULLS) OVER w = 'in' AS charge_open FROM k WINDOW w AS (PARTITION BY car_id ORDER BY at_ms, observation_id ROWS UNBOUNDED PRECEDING)),
  n AS (SELECT *, row_number() OVER (PARTITION BY car_id ORDER BY at_ms, observation_id) AS nth FROM open),
  e AS (SELECT car_id, nth, phase AS effective FROM n WHERE nth = 1 UNION ALL SELECT n.car_id, n.nth, CASE WHEN n.phase = 'offline' AND ((e.effective = 'charging' AND n.charge_open) OR (e.effective = 'driving' AND n.drive_open)) THEN e.effective
    WHEN n.phase = 'online' AND ((e.effective = 'charging' AND n.cs IS NULL AND n.charge_open) OR (e.effective = 'driving' AND NOT coalesce(n.drive_data, false) AND n.drive_open)) THEN e.effective ELSE n.phase END FROM e JOIN n ON n.car_id = e.car_id AND n.nth = e.nth + 1),
  f AS (SELECT n.*, e.effective, CASE WHEN e.effective IN ('online', 'driving', 'charging') THEN 'online' ELSE e.effective END AS state FROM n JOIN e ON e.car_id = n.car_id AND e.nth = n.nth),
  s0 AS (SELECT *, lag(state) OVER (PARTITION BY car_id ORDER BY nth) AS before FROM f), s AS (SELECT car_id, state, at_ms AS start_ms, lead(at_ms) OVER (PARTITION BY car_id ORDER BY nth) AS end_ms FROM s0 WHERE before IS DISTINCT FROM state),
  u0 AS (SELECT *, CASE status WHEN 'installing' THEN 'start' WHEN 'available' THEN 'cancel' ELSE CASE WHEN phase NOT IN ('asleep', 'offline') AND version IS NOT NULL THEN 'done' END END AS event FROM f),
  u1 AS (SELECT *, lag(event) OVER (PARTITION BY car_id ORDER BY nth) AS before FROM u0 WHERE event IS NOT NULL),
  u2 AS (SELECT *, lead(event) OVER w AS next, lead(at_ms) OVER w AS next_ms, lead(version) OVER w AS next_version FROM u1 WHERE event <> 'start' OR before IS DISTINCT FROM 'start' WINDOW w AS (PARTITION BY car_id ORDER BY nth)),
  v0 AS (SELECT *, last_value(version IGNORE NULLS) OVER w AS known, last_value(event IGNORE NULLS) OVER w AS told FROM u0 WINDOW w AS (PARTITION BY car_id ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  p0 AS (SELECT *, max(CASE WHEN drive_data THEN at_ms END) OVER w AS prior, lag(effective) OVER (PARTITION BY car_id ORDER BY nth) AS was FROM f WINDOW w AS (PARTITION BY car_id ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  p1 AS (SELECT *, was IS DISTINCT FROM phase OR prior IS NULL AS enters, row_number() OVER (PARTITION BY car_id ORDER BY nth) AS place FROM p0 WHERE phase IN ('online', 'charging') AND latitude IS NOT NULL AND (prior IS NULL OR at_ms > prior)),
  walk AS (SELECT car_id, place, observation_id, phase, at_ms, true AS kept, at_ms AS last FROM p1 WHERE place = 1
    UNION ALL SELECT p1.car_id, p1.place, p1.observation_id, p1.phase, p1.at_ms, p1.enters OR p1.at_ms - w.last >= 7200000, CASE WHEN p1.enters OR p1.at_ms - w.last >= 7200000 THEN p1.at_ms ELSE w.last END FROM walk w JOIN p1 ON p1.car_id = w.car_id AND p1.place = w.place + 1)"""


def _carries_drive_data() -> Column:
    return F.coalesce((F.col("phase") != "charging") | (F.col("soc") % 3 != 0), F.lit(False))


@query(LIFECYCLE.replace("AND NOT moving", "").replace("phase = 'driving' OR coalesce(phase = 'charging' AND soc % 11 = 0, false)", "phase = 'driving'") + " SELECT observation_id, effective FROM f")
def effective_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = A.observations(spark, sf_dir).withColumns({"charging_state": _charging_state(), "drive_data": _carries_drive_data()})
    return intervals.effective_phase(sessions.with_open(obs, offline_ms=2 * HOUR)).select("observation_id", "effective")


@query(with_frames("observations") + " SELECT car_id, arg_max(power, (at_ms, observation_id)) FILTER (power IS NOT NULL) AS power, arg_max(version, (at_ms, observation_id)) FILTER (version IS NOT NULL) AS version FROM observations GROUP BY car_id")
def merge_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.merge_metadata(A.observations(spark, sf_dir), "power", "version")


@query(with_frames("observations") + " SELECT car_id, max(observation_id) AS observation_id, arg_max(at_ms, observation_id) AS at_ms, max(observation_id) > car_id * 100 AS newer FROM observations GROUP BY car_id")
def observation_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = A.observations(spark, sf_dir)
    given = obs.select("car_id").distinct().select("car_id", (F.col("car_id") * 100).alias("observation_id"))
    return intervals.newer_than(intervals.observation_watermark(obs), given)


@query(with_frames("observations").replace("WITH", "WITH RECURSIVE", 1) + PARKED + """, p AS (SELECT *, max(CASE WHEN drive_data THEN at_ms END) OVER w AS prior, lag(phase) OVER (PARTITION BY car_id ORDER BY at_ms, observation_id) AS before FROM rows WINDOW w AS (PARTITION BY car_id ORDER BY at_ms, observation_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  e AS (SELECT car_id, observation_id, phase, at_ms, before IS DISTINCT FROM phase OR prior IS NULL AS enters, row_number() OVER (PARTITION BY car_id ORDER BY at_ms, observation_id) AS n FROM p WHERE phase IN ('online', 'charging') AND latitude IS NOT NULL AND (prior IS NULL OR at_ms > prior)),
  walk AS (SELECT car_id, n, observation_id, phase, at_ms, true AS kept, at_ms AS last FROM e WHERE n = 1
    UNION ALL SELECT e.car_id, e.n, e.observation_id, e.phase, e.at_ms, e.enters OR e.at_ms - w.last >= 7200000, CASE WHEN e.enters OR e.at_ms - w.last >= 7200000 THEN e.at_ms ELSE w.last END FROM walk w JOIN e ON e.car_id = w.car_id AND e.n = w.n + 1)
  SELECT car_id, observation_id, phase, at_ms FROM walk WHERE kept""")
def stationary_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some rows lack drive data and some coordinates."""
    data = F.coalesce((F.col("phase") != "charging") | (F.col("soc") % 3 != 0), F.lit(False))
    rows = A.observations(spark, sf_dir).withColumns({"drive_data": data, "latitude": F.when(F.col("soc") % 7 != 0, 10.0), "longitude": F.lit(20.0)})
    return sessions.stationary_positions(rows, thin_ms=2 * HOUR)


@query(with_frames("observations").replace("WITH", "WITH RECURSIVE", 1) + """, r AS (SELECT car_id, observation_id, CASE WHEN soc % 11 = 0 THEN at_ms - 60000 WHEN soc % 3 <> 0 THEN at_ms - soc * 600000 END AS c, at_ms - 60000 AS f, row_number() OVER (PARTITION BY car_id ORDER BY at_ms, observation_id) AS n FROM observations),
  walk AS (SELECT car_id, n, observation_id, coalesce(c, f) AS shown, c AS clock FROM r WHERE n = 1
    UNION ALL SELECT r.car_id, r.n, r.observation_id, CASE WHEN w.clock IS NULL THEN coalesce(r.c, r.f) WHEN r.c >= w.clock THEN r.c WHEN r.f >= w.clock THEN r.f ELSE w.clock END,
      CASE WHEN r.c IS NULL THEN w.clock WHEN w.clock IS NULL OR r.c >= w.clock THEN r.c WHEN r.f >= w.clock THEN r.f ELSE w.clock END FROM walk w JOIN r ON r.car_id = w.car_id AND r.n = w.n + 1)
  SELECT car_id, observation_id, shown AS clock FROM walk""")
def monotonic_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    candidate = F.when(F.col("soc") % 11 == 0, 0).when(F.col("soc") % 3 != 0, F.col("at_ms") - F.col("soc") * 600_000)
    shifted = A.observations(spark, sf_dir).withColumns({"candidate": candidate, "fallback": F.col("at_ms") - 60_000})
    return sessions.monotonic_ts(shifted, "candidate", "fallback")


@query(with_frames("observations") + """, base AS (SELECT car_id, max(observation_id) % 1000 + 1 AS next_id FROM observations GROUP BY car_id)
  SELECT observation_id, car_id, next_id + row_number() OVER (PARTITION BY car_id ORDER BY at_ms, observation_id) - 1 AS id FROM observations JOIN base USING (car_id)""")
def assign_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = A.observations(spark, sf_dir)
    bases = obs.groupBy("car_id").agg((F.max("observation_id") % 1000 + 1).alias("next_id"))
    return sessions.assign_ids(obs, bases, "at_ms", "observation_id").select("observation_id", "car_id", "id")


def _snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations as JSON payloads of full snapshots."""
    n = F.col("soc")
    shift = F.when(F.col("phase") == "driving", "D")
    vehicle = F.struct((n % 3 != 0).alias("locked"), (n % 7 == 0).alias("sentry_mode"), (n % 11 == 0).cast("int").alias("df"), F.struct(F.when(n % 13 == 0, "installing").alias("status")).alias("software_update"))
    body = F.struct(F.struct(shift.alias("shift_state"), F.when(n % 5 == 0, n.cast("double") + 0.5).otherwise(0.0).alias("power"), n.cast("string").alias("text")).alias("drive_state"), F.struct(F.when(F.col("phase") == "charging", "Charging").alias("charging_state")).alias("charge_state"), vehicle.alias("vehicle_state"))
    return A.observations(spark, sf_dir).where("soc is not null").withColumn("payload", F.to_json(body))


_POLLED = "CASE WHEN soc % 13 = 0 THEN 'updating' WHEN phase = 'charging' THEN 'charging' WHEN phase = 'driving' THEN 'driving' ELSE 'online' END"


@query(with_frames("observations") + f" SELECT observation_id, {_POLLED} AS polled, {_POLLED} = 'online' AND soc % 3 <> 0 AND soc % 7 <> 0 AND soc % 11 <> 0 AND (soc % 5 <> 0 OR soc + 0.5 <= 0) AS eligible FROM observations WHERE soc IS NOT NULL")
def sleep_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _snapshots(spark, sf_dir).select("observation_id", intervals.poll_phase("payload").alias("polled"), intervals.sleep_eligible("payload").alias("eligible"))


@query(with_frames("observations") + """ SELECT observation_id, CASE WHEN soc % 5 = 0 THEN CAST(soc + 1 AS BIGINT) ELSE 0 END AS as_int, CASE WHEN soc % 5 = 0 THEN soc + CAST(0.5 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS as_float, CAST(NULL AS BIGINT) AS text_int, soc % 3 <> 0 AS as_bool,
  CASE WHEN soc > 0 THEN soc END AS as_time FROM observations WHERE soc IS NOT NULL""")
def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _snapshots(spark, sf_dir)
    power, text = "$.drive_state.power", "$.drive_state.text"
    return rows.select("observation_id", S.int_field("payload", power).alias("as_int"), S.float_field("payload", power).alias("as_float"), S.int_field("payload", text).alias("text_int"), S.bool_field("payload", "$.vehicle_state.locked").alias("as_bool"), S.timestamp_field("payload", text).alias("as_time"))


@query("""SELECT event_id, CASE WHEN event_id % 17 = 0 THEN 'wrong number of values' WHEN event_id % 3 = 0 AND event_id % 19 = 0 THEN 'two timestamps' WHEN event_id % 3 <> 0 AND event_id % 19 <> 0 AND event_id % 23 = 0 THEN 'no timestamp' WHEN event_id % 29 = 0 THEN 'bad tag' WHEN event_id % 31 = 0 THEN 'bad number' END AS reject,
  CASE WHEN event_id % 17 <> 0 AND NOT (event_id % 3 = 0 AND event_id % 19 = 0) AND NOT (event_id % 3 <> 0 AND event_id % 19 <> 0 AND event_id % 23 = 0) AND event_id % 29 <> 0 AND event_id % 31 <> 0 THEN epoch_us(ts) // 1000 END AS ts_ms,
  CASE WHEN event_id % 17 <> 0 AND NOT (event_id % 3 = 0 AND event_id % 19 = 0) AND NOT (event_id % 3 <> 0 AND event_id % 19 <> 0 AND event_id % 23 = 0) AND event_id % 29 <> 0 AND event_id % 31 <> 0 AND event_id % 2 = 0 THEN value END AS power FROM events""")
def parse_stream_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.table(spark, sf_dir, "events")
    e, ts = F.col("event_id"), S.epoch_ms("ts").cast("string")
    own = e % 3 == 0
    power = F.when(e % 2 == 0, F.col("value").cast("string")).otherwise("")
    value = F.concat(F.when(own, F.concat(ts, F.lit(","))).otherwise(""), F.lit("12,"), F.when(e % 31 == 0, "x").otherwise("100.5"), F.lit(",50,,,1.5,2.5,"), power, F.lit(",D,200,190,"), F.lit("7"), F.when(e % 17 == 0, ",1,2").otherwise(""))
    outer = F.when(~own & (e % 19 != 0) & (e % 23 == 0), None).when(~own | (e % 19 == 0), ts)
    body = F.to_json(F.struct(F.when(e % 29 == 0, "no tag!").otherwise("tag-1").alias("tag"), outer.alias("timestamp"), value.alias("value")))
    return live.parse_stream_frames(rows.select("event_id", body.alias("value"))).select("event_id", "reject", "ts_ms", "power")


@query(LIFECYCLE + """ SELECT car_id, 'state' AS entity, CAST(NULL AS BIGINT) AS session, CAST(NULL AS BIGINT) AS observation_id, state AS label, start_ms, end_ms, CAST(NULL AS BIGINT) AS n FROM s WHERE end_ms IS NOT NULL
  UNION ALL BY NAME SELECT car_id, 'drive' AS entity, session, min(at_ms) AS start_ms, max(at_ms) AS end_ms, count(*) AS n, arg_min(power, (at_ms, observation_id)) FILTER (power IS NOT NULL) AS first, arg_max(power, (at_ms, observation_id)) FILTER (power IS NOT NULL) AS last,
    round((last - first) * 1e6) / 1e6 AS distance_km, CAST(floor((max(at_ms) - min(at_ms)) / 60000 + 0.5) AS BIGINT) AS duration_min, CAST(max(soc % 50) AS DOUBLE) AS speed_max, max(power) AS power_max, min(power) AS power_min, arg_min(CAST(soc AS DOUBLE), (at_ms, observation_id)) FILTER (soc IS NOT NULL) AS start_soc, arg_max(CAST(soc AS DOUBLE), (at_ms, observation_id)) FILTER (soc IS NOT NULL) AS end_soc,
    arg_min(soc * 3.5::DOUBLE, (at_ms, observation_id)) FILTER (soc IS NOT NULL AND power IS NOT NULL) AS start_ideal_km, arg_max(soc * 3.5::DOUBLE, (at_ms, observation_id)) FILTER (soc IS NOT NULL AND power IS NOT NULL) AS end_ideal_km, avg(soc / 4) AS outside_temp_avg, avg(soc % 30) AS inside_temp_avg
    FROM d SEMI JOIN dclosed USING (car_id, session) GROUP BY car_id, session HAVING count(*) >= 2 AND distance_km >= 0.01
  UNION ALL BY NAME SELECT car_id, 'drive_position' AS entity, session, observation_id, at_ms AS start_ms, power AS first FROM d
  UNION ALL BY NAME SELECT car_id, 'charge' AS entity, session, min(at_ms) AS start_ms, max(at_ms) AS end_ms, count(*) FILTER (sample) AS n, arg_min(CAST(soc AS DOUBLE), (at_ms, observation_id)) FILTER (soc IS NOT NULL) AS first, arg_max(CAST(soc AS DOUBLE), (at_ms, observation_id)) FILTER (soc IS NOT NULL) AS last,
    CASE WHEN CASE WHEN last > 0 THEN last ELSE max(soc) END - first >= 0 THEN CASE WHEN last > 0 THEN last ELSE max(soc) END - first END AS energy_added, (max(at_ms) - min(at_ms)) // 60000 AS duration_min, max(power) FILTER (sample) AS power_max, first AS start_soc, last AS end_soc, first * 3.5 AS start_ideal_km, last * 3.5 AS end_ideal_km, avg(soc / 4) FILTER (sample) AS outside_temp_avg
    FROM c SEMI JOIN cclosed USING (car_id, session) GROUP BY car_id, session
  UNION ALL BY NAME SELECT car_id, 'charge_sample' AS entity, session, observation_id, at_ms AS start_ms, CAST(soc AS DOUBLE) AS first FROM c WHERE sample
  UNION ALL BY NAME SELECT car_id, 'update' AS entity, next_version AS label, at_ms AS start_ms, next_ms AS end_ms FROM u2 WHERE event = 'start' AND next = 'done'
  UNION ALL BY NAME SELECT car_id, 'missed_update' AS entity, version AS label, at_ms AS start_ms, at_ms AS end_ms FROM v0 WHERE event = 'done' AND told IS DISTINCT FROM 'start' AND CAST(split_part(version, '.', 2) AS BIGINT) > CAST(split_part(known, '.', 2) AS BIGINT)
  UNION ALL BY NAME SELECT car_id, 'position' AS entity, observation_id, phase AS label, at_ms AS start_ms, 10.0::DOUBLE AS first, 20.0::DOUBLE AS last FROM walk WHERE kept""")
def lifecycle_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that the stream closes and adds, run over what is there and written in the shared folder. Power stands for the odometer."""
    session = spark.newSession()
    lifecycle.configure(session)
    top = f"{folds.shared_folder(spark)}/lifecycle/{uuid.uuid4().hex}"
    source = session.readStream.option("maxFilesPerTrigger", 64).schema("event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").parquet(f"{sf_dir}/events.parquet*")
    soc = F.col("soc")
    status = F.when(soc % 10 == 3, "installing").when(soc % 10 == 4, "available")
    moving = (F.col("phase") == "driving") | F.coalesce((F.col("phase") == "charging") & (soc % 11 == 0), F.lit(False))
    real = lambda c: c.cast("double")
    measures = {"speed": real(soc % 50), "power": F.col("power"), "battery_level": real(soc), "ideal_km": soc * 3.5, "rated_km": F.lit(None).cast("double"), "outside_temp": soc / 4, "inside_temp": real(soc % 30)}
    obs = A.observed(source).select("car_id", "observation_id", "at_ms", "phase", _charging_state().alias("charging_state"), F.col("power").alias("odometer"), real(soc).alias("energy"), F.lit(False).alias("broken"), status.alias("status"), "version", F.when(soc % 7 != 0, 10.0).alias("latitude"), F.lit(20.0).alias("longitude"), _carries_drive_data().alias("drive_data"), moving.alias("moving"), *[c.alias(n) for n, c in measures.items()])
    run = lifecycle.lifecycle_stream(obs, offline_ms=2 * HOUR, thin_ms=2 * HOUR).writeStream.format("parquet").option("path", f"{top}/out").option("checkpointLocation", f"{top}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(lifecycle.OUT).parquet(f"{top}/out").select("car_id", "entity", "session", "observation_id", "label", "start_ms", "end_ms", "n", "first", "last", *[c for c in lifecycle.FACTS if "rated" not in c])


_LETTER = {"no JSON": "{", "no object": "[1]", "unknown record type": '{"record_type":"x"}', "no vehicle data": f'{{"record_type":"{live.FULL}"}}'}
_DEFECT = "CASE WHEN event_id % 13 = 0 THEN 'no JSON' WHEN event_id % 17 = 0 THEN 'no object' WHEN event_id % 19 = 0 THEN 'unknown record type' WHEN event_id % 23 = 0 THEN 'no vehicle data' END"


def _logged(spark: SparkSession, sf_dir: str) -> tuple[SparkSession, str]:
    """Events as a log of full snapshots, stream updates, discovery records and what is none, through the ingest plan into the shared folder."""
    session = spark.newSession()
    lifecycle.configure(session)
    top = f"{folds.shared_folder(spark)}/ingest/{uuid.uuid4().hex}"
    source = session.readStream.option("maxFilesPerTrigger", 64).schema("event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").parquet(f"{sf_dir}/events.parquet*")
    n, phase = F.col("observation_id"), F.col("phase")
    kind = F.when(n % 3 == 0, live.UPDATE).when(n % 7 == 0, live.DISCOVERY).otherwise(live.FULL)
    timestamp = F.col("at_ms") - F.when(n % 4 == 0, 2 * HOUR).otherwise(0)
    drive = F.struct(timestamp.alias("timestamp"), F.when(phase == "driving", "D").alias("shift_state"), F.lit(10.0).alias("latitude"), F.lit(20.0).alias("longitude"))
    charge = F.struct(F.when(phase == "charging", "Charging").when(F.col("soc") % 5 == 0, "Complete").alias("charging_state"), F.col("soc").cast("double").alias("charge_energy_added"), F.col("soc").alias("battery_level"))
    vehicle = F.struct(F.col("power").alias("odometer"), F.col("version").alias("car_version"))
    groups = F.struct(F.when(F.col("soc") % 7 != 0, drive).alias("drive_state"), charge.alias("charge_state"), vehicle.alias("vehicle_state"))
    body = F.to_json(F.struct(kind.alias("record_type"), F.when(kind == live.FULL, groups).alias("vehicle_data"), F.when(kind == live.UPDATE, groups).alias("fields")))
    defect = F.expr(_DEFECT.replace("event_id", "observation_id"))
    broken = F.coalesce(*[F.when(defect == why, text) for why, text in _LETTER.items()])
    log = A.observed(source).select("observation_id", "car_id", F.col("at_ms").alias("observed_at_ms"), F.when(phase.isin("asleep", "offline"), phase).otherwise("online").alias("vehicle_state"), F.coalesce(broken, body).alias("payload"))
    seen = A.observations(session, sf_dir).where("car_id % 2 = 0").groupBy("car_id").agg(F.min("at_ms").alias("at"))
    marks = seen.select("car_id", *[(F.col("at") + h * HOUR).alias(f"{g}_ms") for g, h in (("drive", 24), ("charge", 12), ("vehicle", 48))])
    ingest.write(ingest.facts(log, marks, offline_ms=2 * HOUR, thin_ms=2 * HOUR), f"{top}/out", f"{top}/checkpoint").awaitTermination()
    return spark, f"{top}/out"


@query("SELECT car_id, observation_id, reason, CASE reason " + " ".join(f"WHEN '{why}' THEN '{text}'" for why, text in _LETTER.items()) + f" END AS payload FROM (SELECT user_id AS car_id, event_id AS observation_id, {_DEFECT} AS reason FROM events) WHERE reason IS NOT NULL")
def dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the ingest plan couldn't read, with payloads."""
    return ingest.read_letters(*_logged(spark, sf_dir)).select("car_id", "observation_id", "reason", "payload")


@query(with_frames("positions") + " SELECT id, car_id FROM positions WHERE elevation IS NULL AND NOT (id % 11 <> 0 AND (id % 5 = 0 OR (id % 7 = 0 AND id % 12 < 6)))")
def enrichment_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions without a height that a pass would ask for: answered ones are out, failed ones wait six hours, changed ones are asked anew."""
    n, now = F.col("id"), 1_000 * HOUR
    rows = A.positions(spark, sf_dir).where("elevation IS NULL").select("id", "car_id", F.concat(F.lit("car "), F.col("car_id").cast("string")).alias("payload"))
    seen = enrichment.witness(F.when(n % 11 == 0, "another").otherwise(F.col("payload")))
    answered = rows.where(n % 5 == 0).select("id", seen.alias("seen"), F.lit(now).alias("at_ms"), F.lit(True).alias("resolved"))
    failed = rows.where(n % 7 == 0).select("id", seen.alias("seen"), (now - n % 12 * HOUR).alias("at_ms"), F.lit(False).alias("resolved"))
    return enrichment.due(rows, answered.union(failed), now).select("id", "car_id")


# Drives and charges -----------------------------------------------------------------------------


@query(with_frames("positions") + """ SELECT drive_id, min(car_id) AS car_id, count(*) AS n_positions, min(date_ms) AS start_ms, max(date_ms) AS end_ms,
  round((arg_max(odometer, (date_ms, id)) FILTER (odometer IS NOT NULL) - arg_min(odometer, (date_ms, id)) FILTER (odometer IS NOT NULL)) * 1e6) / 1e6 AS distance_km, max(speed) AS speed_max, max(power) AS power_max, min(power) AS power_min,
  arg_min(ideal_km, (date_ms, id)) FILTER (ideal_km IS NOT NULL AND odometer IS NOT NULL) AS start_ideal_km, arg_max(ideal_km, (date_ms, id)) FILTER (ideal_km IS NOT NULL AND odometer IS NOT NULL) AS end_ideal_km, arg_min(battery_level, (date_ms, id)) AS start_soc, arg_max(battery_level, (date_ms, id)) AS end_soc,
  CAST(round((max(date_ms) - min(date_ms)) / 60000) AS BIGINT) AS duration_min FROM positions GROUP BY drive_id HAVING count(*) >= 2 AND distance_km >= 0.01""")
def drive_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drives.finalize_drives(A.positions(spark, sf_dir))
    return out.select("drive_id", "car_id", "n_positions", "start_ms", "end_ms", "distance_km", "speed_max", "power_max", "power_min", "start_ideal_km", "end_ideal_km", "start_soc", "end_soc", "duration_min")


@query(with_frames("samples") + """, g AS (SELECT charge_id, min(car_id) AS car_id, count(*) AS n_samples, min(date_ms) AS start_ms, max(date_ms) AS end_ms, arg_min(energy, (date_ms, id)) FILTER (energy IS NOT NULL) AS f, arg_max(energy, (date_ms, id)) FILTER (energy IS NOT NULL) AS l, max(energy) AS m,
  max(power) AS max_power, coalesce(bool_or(fast_present), false) AS is_dc, arg_max(battery_level, (date_ms, id)) AS end_battery_level FROM samples GROUP BY charge_id)
  SELECT charge_id, car_id, n_samples, start_ms, end_ms, max_power, is_dc, end_battery_level, (CASE WHEN (CASE WHEN l > 0 THEN l ELSE m END) - f >= 0 THEN (CASE WHEN l > 0 THEN l ELSE m END) - f END) AS energy_added, (end_ms - start_ms) // 60000 AS duration_min FROM g""")
def charge_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drives.finalize_charges(A.samples(spark, sf_dir)).select("charge_id", "car_id", "n_samples", "start_ms", "end_ms", "max_power", "is_dc", "end_battery_level", "energy_added", "duration_min")


FACTS = """facts AS (SELECT charge_id, coalesce(bool_or(fast_present), false) AS is_dc, max(power) AS max_power, arg_min(battery_level, (date_ms, id)) AS start_battery_level, arg_max(battery_level, (date_ms, id)) AS end_battery_level,
  arg_max(fast_type, (date_ms, id)) FILTER (power > 0 AND fast_type IS NOT NULL) AS fast_type, min(date_ms) AS first_ms, max(date_ms) AS last_ms, count(*) AS n_samples,
  CASE WHEN arg_max(energy, (date_ms, id)) FILTER (energy IS NOT NULL) - arg_min(energy, (date_ms, id)) FILTER (energy IS NOT NULL) >= 0 THEN arg_max(energy, (date_ms, id)) FILTER (energy IS NOT NULL) - arg_min(energy, (date_ms, id)) FILTER (energy IS NOT NULL) END AS energy_added FROM samples GROUP BY charge_id)"""


@query(with_frames("samples") + f", {FACTS} SELECT * FROM facts")
def charge_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drives.charge_facts(A.samples(spark, sf_dir)).drop("start_ideal_km", "end_ideal_km")


@query(with_frames("samples", "charges", "geofences") + f""", {FACTS}, j AS (SELECT c.id, f.energy_added, (c.end_ms - c.start_ms) // 60000 AS minutes, g.*  EXCLUDE (id, name) FROM charges c LEFT JOIN facts f ON f.charge_id = c.id LEFT JOIN geofences g ON g.id = c.geofence_id)
  SELECT id, CASE WHEN id % 10 = 0 THEN CAST(0 AS DOUBLE) WHEN billing_type = 'per_kwh' AND energy_added >= 0 AND (cost_per_unit IS NOT NULL OR session_fee IS NOT NULL) THEN coalesce(cost_per_unit * energy_added, 0) + coalesce(session_fee, 0) WHEN billing_type = 'per_minute' AND minutes >= 0 THEN cost_per_unit * minutes + coalesce(session_fee, 0) END AS cost FROM j""")
def charge_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = drives.charge_facts(A.samples(spark, sf_dir)).select(F.col("charge_id").alias("id"), "energy_added")
    fences = A.geofences(spark, sf_dir).select(F.col("id").alias("geofence_id"), "billing_type", "cost_per_unit", "session_fee")
    rows = A.charges(spark, sf_dir).join(facts, "id", "left").join(fences, "geofence_id", "left")
    minutes = F.floor((F.col("end_ms") - F.col("start_ms")) / 60000)
    return rows.select("id", S.charge_cost(F.col("billing_type"), F.col("cost_per_unit"), F.col("session_fee"), F.col("energy_added"), F.lit(None).cast("double"), minutes, F.col("id") % 10 == 0).alias("cost"))


@query(with_frames("samples") + """, u AS (SELECT * REPLACE (CASE WHEN power >= 0 THEN power END AS power) FROM samples), w AS (SELECT *, date_ms - lag(date_ms) OVER o AS dt, last_value(power IGNORE NULLS) OVER (PARTITION BY charge_id ORDER BY date_ms, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM u WINDOW o AS (PARTITION BY charge_id ORDER BY date_ms, id))
  SELECT charge_id, round(sum(CASE WHEN power IS NOT NULL AND dt > 0 THEN before * dt END) / 3.6e6 * 1e4) / 1e4 AS energy_used, count(CASE WHEN power IS NOT NULL AND dt > 0 THEN before * dt END) AS n_intervals FROM w GROUP BY charge_id""")
def energy_used(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drives.energy_used(A.samples(spark, sf_dir))


PHASES = """, r AS (SELECT *, CASE WHEN power * 1000.0 / nullif(current * voltage, 0) > 0 THEN CAST(power * 1000 AS DOUBLE) / nullif(current * voltage, 0) END AS ratio FROM samples),
  p AS (SELECT car_id, count(*) AS n, avg(ratio) AS p, round(avg(phases)) AS r FROM r GROUP BY car_id),
  known AS (SELECT car_id, n, CASE WHEN n <= 15 OR p IS NULL THEN NULL WHEN r = round(p) THEN r WHEN r = 3 AND abs(p / sqrt(3) - 1) <= 0.1 THEN sqrt(3) WHEN abs(round(p) - p) <= 0.3 THEN round(p) END AS phases_used FROM p)"""


@query(with_frames("samples") + PHASES + " SELECT car_id AS charge_id, n, phases_used FROM known")
def phases_of_car(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phases by car, as charges here have few samples."""
    return drives.determine_phases(A.samples(spark, sf_dir).withColumn("charge_id", F.col("car_id")))


@query(with_frames("samples") + PHASES + """, w AS (SELECT s.*, k.phases_used, lead(date_ms) OVER (PARTITION BY s.car_id ORDER BY date_ms, id) - date_ms AS dt FROM samples s JOIN known k ON k.car_id = s.car_id),
  v AS (SELECT car_id, dt, CASE WHEN phases IS NULL THEN CAST(power AS DOUBLE) ELSE current * voltage * phases_used / 1000 END AS kw FROM w)
  SELECT car_id AS charge_id, round(sum(CASE WHEN dt > 0 AND kw >= 0 THEN kw * dt END) / 3.6e6 * 1e4) / 1e4 AS energy_used FROM v GROUP BY car_id""")
def energy_used_phase_aware(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By car, so that there are the samples to determine phases."""
    return drives.energy_used_phase_aware(A.samples(spark, sf_dir).withColumn("charge_id", F.col("car_id")))


@query(with_frames("positions") + """, s AS (SELECT drive_id, elevation - lag(elevation) OVER (PARTITION BY drive_id ORDER BY date_ms, id) AS step FROM positions WHERE elevation IS NOT NULL),
  t AS (SELECT drive_id, CAST(coalesce(sum(greatest(step, 0)), 0) AS BIGINT) AS a, CAST(coalesce(sum(greatest(-step, 0)), 0) AS BIGINT) AS d FROM s GROUP BY drive_id)
  SELECT drive_id, CASE WHEN a >= 32768 THEN 0 ELSE a END AS ascent, CASE WHEN d >= 32768 THEN 0 ELSE d END AS descent FROM t""")
def elevation_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drives.elevation_gain_loss(A.positions(spark, sf_dir), "drive_id", "date_ms", "id")


# Relational import ------------------------------------------------------------------------------


_ENDS = "ends AS (SELECT drive_id, min(id) AS start_id, max(id) AS end_id FROM positions GROUP BY drive_id)"


@query(with_frames("drives", "positions", "addresses", "geofences") + f""", {_ENDS} SELECT d.id, d.car_id, d.start_ms, d.end_ms, a.display_name AS start_address, b.display_name AS end_address, g.name AS start_geofence, h.name AS end_geofence,
  p.latitude AS start_latitude, p.longitude AS start_longitude, p.battery_level AS start_soc, q.latitude AS end_latitude, q.longitude AS end_longitude, q.battery_level AS end_soc, CASE WHEN p.car_id <> d.car_id THEN 1 ELSE 0 END AS n_dangling
  FROM drives d LEFT JOIN ends e ON e.drive_id = d.id LEFT JOIN positions p ON p.id = e.start_id LEFT JOIN positions q ON q.id = e.end_id
  LEFT JOIN addresses a ON a.id = d.start_address_id LEFT JOIN addresses b ON b.id = d.end_address_id LEFT JOIN geofences g ON g.id = d.start_geofence_id LEFT JOIN geofences h ON h.id = d.end_geofence_id WHERE d.end_ms IS NOT NULL""")
def project_drives(spark: SparkSession, sf_dir: str) -> DataFrame:
    spots = A.positions(spark, sf_dir)
    rows = A.with_positions(A.drives(spark, sf_dir), spots, start_position_id="min", end_position_id="max")
    done = relations.project_drive(rows, spots, A.addresses(spark, sf_dir), A.geofences(spark, sf_dir))
    return done.select("id", "car_id", "start_ms", "end_ms", *[f"{side}_{c}" for side in ("start", "end") for c in ("address", "geofence", "latitude", "longitude", "soc")], "n_dangling")


@query(with_frames("positions", "drives") + " SELECT p.id, p.car_id, p.drive_id, p.date_ms FROM positions p LEFT JOIN drives d ON d.id = p.drive_id AND d.end_ms IS NOT NULL WHERE p.drive_id IS NULL OR d.id IS NOT NULL")
def project_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.project_position(A.positions(spark, sf_dir), A.drives(spark, sf_dir)).select("id", "car_id", "drive_id", "date_ms")


@query(with_frames("samples", "charges", "positions", "geofences", "addresses") + f""", {FACTS}, {_ENDS} SELECT c.id, c.car_id, least(c.start_ms, f.first_ms) AS start_ms, CASE WHEN c.end_ms IS NOT NULL THEN greatest(c.end_ms, f.last_ms) END AS end_ms, a.display_name AS address, a.name AS location_name, g.name AS geofence, g.billing_type, g.cost_per_unit, g.session_fee,
  p.latitude AS start_latitude, p.longitude AS start_longitude, coalesce(f.is_dc, false) AS is_dc, f.max_power, f.energy_added
  FROM charges c LEFT JOIN facts f ON f.charge_id = c.id LEFT JOIN geofences g ON g.id = c.geofence_id LEFT JOIN addresses a ON a.id = c.address_id LEFT JOIN ends e ON e.drive_id = c.id LEFT JOIN positions p ON p.id = e.start_id""")
def project_charges(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts, spots = drives.charge_facts(A.samples(spark, sf_dir)), A.positions(spark, sf_dir)
    rows = A.with_positions(A.charges(spark, sf_dir), spots, position_id="min")
    done = relations.project_charge(rows, facts, A.addresses(spark, sf_dir), A.geofences(spark, sf_dir), spots)
    return done.select("id", "car_id", "start_ms", "end_ms", "address", "location_name", "geofence", "billing_type", "cost_per_unit", "session_fee", "start_latitude", "start_longitude", "is_dc", "max_power", "energy_added")


def _once(rows: DataFrame) -> DataFrame:
    """rows as a table, one of each id: the import reads it often, and only the rows of a repeated id are shuffled whole."""
    rows = folds.held(rows)
    twice = folds.held(rows.groupBy("id").count().where("count > 1").select("id"))
    return rows.join(twice, "id", "left_anti").unionByName(rows.join(twice, "id", "left_semi").dropDuplicates(["id"]))


def _imported(spark: SparkSession, sf_dir: str) -> str:
    """All tables through one import into the shared folder. The star schema's keys begin at 0 and a few of the ids made of them come twice: each is one higher here and once."""
    top = f"{folds.shared_folder(spark)}/imports/{uuid.uuid4().hex}"
    spots, samples = _once(A.positions(spark, sf_dir)), _once(A.samples(spark, sf_dir))
    tables = {f.__name__: f(spark, sf_dir) for f in (A.cars, A.states, A.updates, A.addresses, A.geofences)} | {"positions": spots, "samples": samples}
    tables["drives"] = folds.held(A.with_positions(A.drives(spark, sf_dir), spots, start_position_id="min", end_position_id="max"))
    ends = tables["drives"].select("id", F.col("start_position_id").alias("position_id"))
    tables["charges"] = folds.held(A.charges(spark, sf_dir).join(ends, "id", "left"))
    higher = lambda t: t.withColumns({c: F.col(c) + 1 for c in t.columns if c == "id" or c.endswith("_id")})
    imports.import_history({name: higher(t) for name, t in tables.items()}, top, "first")
    return top


@query(with_frames("cars", "drives", "positions", "charges", "samples", "observations") + """, u AS (SELECT observation_id % 3 <> 0 AND observation_id % 7 <> 0 AND observation_id % 11 <> 0 AS sound FROM observations WHERE version IS NOT NULL),
  p AS (SELECT DISTINCT p.id, d.end_ms IS NOT NULL OR p.drive_id IS NULL AS kept FROM positions p LEFT JOIN drives d ON d.id = p.drive_id),
  c AS (SELECT 'completed_drives' AS counter, count(*) AS n FROM drives WHERE end_ms IS NOT NULL UNION ALL SELECT 'skipped_open_drives', count(*) FROM drives WHERE end_ms IS NULL
  UNION ALL SELECT 'skipped_unattached_positions', count(*) FROM p WHERE NOT kept UNION ALL SELECT 'projected_positions', count(*) FROM p WHERE kept UNION ALL SELECT 'projected_charges', count(*) FROM charges
  UNION ALL SELECT 'projected_charge_samples', count(DISTINCT id) FROM samples WHERE charge_id IN (SELECT id FROM charges) UNION ALL SELECT 'projected_states', count(*) FROM observations WHERE phase IN ('online', 'offline', 'asleep')
  UNION ALL SELECT 'projected_updates', count(*) FROM u WHERE sound UNION ALL SELECT 'skipped_incomplete_updates', count(*) FROM u WHERE NOT sound)
  SELECT * FROM c UNION ALL SELECT 'logical_rows', CAST((SELECT sum(n) FROM c WHERE NOT starts_with(counter, 'skipped')) + (SELECT count(*) FROM cars) AS BIGINT)""")
def import_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counters of an import of all cars."""
    return imports.read_import(spark, _imported(spark, sf_dir), "first", "report")


@query(with_frames("observations") + """, u AS (SELECT observation_id AS id, car_id, at_ms AS start_ms, at_ms + 1800000 AS end_ms, version FROM observations WHERE version IS NOT NULL AND observation_id % 3 <> 0 AND observation_id % 7 <> 0 AND observation_id % 11 <> 0)
  SELECT CAST(c.c_custkey + 1 AS BIGINT) AS id, arg_max(u.version, (u.end_ms, u.start_ms, u.id)) AS firmware_version, CAST(count(u.id) AS BIGINT) AS n_updates FROM customer c LEFT JOIN u ON u.car_id = c.c_custkey GROUP BY c.c_custkey""")
def imported_firmware(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each car's firmware and number of updates, as its import shows them."""
    top = _imported(spark, sf_dir)
    n = imports.read_import(spark, top, "first", "update").groupBy(F.col("car_id").alias("id")).agg(F.count("*").alias("n_updates"))
    cars = imports.read_import(spark, top, "first", "car").select(F.col("id").cast("bigint").alias("id"), "firmware_version")
    return cars.join(n, "id", "left").withColumn("n_updates", F.coalesce("n_updates", F.lit(0).cast("bigint")))


@query(with_frames("cars") + """, c AS (SELECT *, CASE model WHEN 'models2' THEN 'S' WHEN ' Model 3 ' THEN '3' WHEN 'tamarind' THEN 'X' END AS m, upper(trim(trim)) AS t FROM cars)
  SELECT id, coalesce(nullif(trim(name), ''), 'Car ' || id) AS name, coalesce(m, 'Unknown Tesla') AS model, t AS trim, CASE WHEN efficiency > 0 AND efficiency < 1 THEN efficiency * 1000 ELSE efficiency END AS efficiency_wh_per_km,
  CASE WHEN m = 'S' AND t = '100D' THEN 'LR+' WHEN m = '3' AND t = '74D' THEN 'LR AWD' WHEN m = 'X' AND t = '100D' THEN 'LR' END AS marketing_name FROM c""")
def project_cars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.project_car(A.cars(spark, sf_dir)).select("id", "name", "model", "trim", "efficiency_wh_per_km", "marketing_name")


@query(with_frames("drives", "charges", "addresses", "geofences") + """ SELECT 'address' AS kind, id FROM addresses WHERE id IN (SELECT start_address_id FROM drives UNION SELECT end_address_id FROM drives UNION SELECT address_id FROM charges)
  UNION ALL SELECT 'geofence', id FROM geofences WHERE id IN (SELECT start_geofence_id FROM drives UNION SELECT end_geofence_id FROM drives UNION SELECT geofence_id FROM charges)""")
def referenced_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, c = A.drives(spark, sf_dir), A.charges(spark, sf_dir)
    a = relations.referenced(A.addresses(spark, sf_dir), (d, "start_address_id"), (d, "end_address_id"), (c, "address_id"))
    g = relations.referenced(A.geofences(spark, sf_dir), (d, "start_geofence_id"), (d, "end_geofence_id"), (c, "geofence_id"))
    return a.select(F.lit("address").alias("kind"), "id").unionByName(g.select(F.lit("geofence").alias("kind"), "id"))


@query(with_frames("positions", "drives") + " SELECT p.id, p.drive_id FROM positions p JOIN drives d ON d.id = p.drive_id WHERE p.date_ms < d.start_ms OR p.date_ms > d.end_ms")
def positions_outside_drive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.position_in_drive(A.positions(spark, sf_dir), A.drives(spark, sf_dir)).select("id", "drive_id")


@query(with_frames("drives") + " SELECT id, car_id FROM (SELECT *, count(*) OVER (PARTITION BY car_id) AS n FROM (SELECT id, car_id, CASE WHEN o_totalprice < 250000 THEN start_ms ELSE end_ms END AS end_ms FROM drives) WHERE end_ms IS NULL) WHERE n = 1")
def open_drives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cheaper orders count as closed, so that some cars have a single open drive."""
    closed = F.when(F.col("o_totalprice") < 250_000, F.col("start_ms")).otherwise(F.col("end_ms"))
    return relations.open_rows(A.drives(spark, sf_dir).withColumn("end_ms", closed)).select("id", "car_id")


@query(with_frames("drives") + """, a AS (SELECT *, 1 AS rd FROM drives WHERE id % 3 <> 0), b AS (SELECT * REPLACE (start_ms + 1000 AS start_ms), 2 AS rd FROM drives WHERE id % 2 = 0), u AS (SELECT * FROM a UNION ALL SELECT * FROM b)
  SELECT id, car_id, start_ms FROM u QUALIFY row_number() OVER (PARTITION BY id ORDER BY rd DESC) = 1""")
def cutover_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two overlapping reads of the drives, the second a second later."""
    d = A.drives(spark, sf_dir)
    return relations.union_newest(d.where("id % 3 <> 0"), d.where("id % 2 = 0").withColumn("start_ms", F.col("start_ms") + 1000)).select("id", "car_id", "start_ms")


@query(with_frames("drives", "positions", "charges", "samples") + " SELECT 'drive' AS \"table\", count(*) AS n FROM drives UNION ALL SELECT 'position', count(*) FROM positions UNION ALL SELECT 'charge', count(*) FROM charges UNION ALL SELECT 'sample', count(*) FROM samples")
def source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.source_counts(drive=A.drives(spark, sf_dir), position=A.positions(spark, sf_dir), charge=A.charges(spark, sf_dir), sample=A.samples(spark, sf_dir))


@query(with_frames("drives", "positions") + """, k AS (SELECT count(*) AS s, count(*) FILTER (end_ms IS NOT NULL) AS p, count(*) FILTER (end_ms IS NULL) AS o FROM drives), q AS (SELECT count(*) AS s, count(*) FILTER (d.end_ms IS NOT NULL) AS p, count(*) FILTER (d.end_ms IS NULL) AS o FROM positions JOIN drives d ON d.id = drive_id)
  SELECT 'drive' AS "table", s AS source, p AS projected, o AS skipped, s - p - o AS unexplained FROM k UNION ALL SELECT 'position', s, p, o, s - p - o FROM q""")
def count_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, p = A.drives(spark, sf_dir), A.positions(spark, sf_dir)
    open_ones = d.where("end_ms is null")
    skipped = reconcile.source_counts(drive=open_ones, position=p.join(open_ones.select(F.col("id").alias("drive_id")), "drive_id", "left_semi"))
    return reconcile.count_reconciliation(reconcile.source_counts(drive=d, position=p), reconcile.source_counts(drive=d.where("end_ms is not null"), position=relations.project_position(p, d)), skipped)


@query(with_frames("drives", "positions") + " SELECT 'drive' AS \"table\", max(id) AS max_id, greatest(max(start_ms), max(end_ms)) AS max_ms FROM drives UNION ALL SELECT 'position', max(id), max(date_ms) FROM positions")
def source_watermarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.source_watermarks(drive=(A.drives(spark, sf_dir), ["start_ms", "end_ms"]), position=(A.positions(spark, sf_dir), ["date_ms"]))


@query(with_frames("drives", "positions") + " SELECT 'drive' AS entity, greatest(max(id) + 1, 1) AS next_id FROM drives UNION ALL SELECT 'position', greatest(max(id) + 1, 1) FROM positions")
def next_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, p = A.drives(spark, sf_dir), A.positions(spark, sf_dir)
    return reconcile.next_ids({"drive": d.where("id % 2 = 0"), "position": p}, {"drive": d.where("id % 2 = 1")})


UPDATES = ", updates AS (SELECT observation_id AS id, car_id, at_ms AS start_ms, CASE WHEN soc % 4 <> 0 THEN at_ms + 60000 END AS end_ms, CASE WHEN soc % 3 <> 0 THEN version WHEN soc % 2 = 0 THEN '' END AS version FROM observations WHERE version IS NOT NULL)"


def _updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    version = F.when(F.col("soc") % 3 != 0, F.col("version")).when(F.col("soc") % 2 == 0, "")
    return A.observations(spark, sf_dir).where("version is not null").select(F.col("observation_id").alias("id"), "car_id", F.col("at_ms").alias("start_ms"), F.when(F.col("soc") % 4 != 0, F.col("at_ms") + 60000).alias("end_ms"), version.alias("version"))


@query(with_frames("observations") + UPDATES + " SELECT car_id, arg_max_null(version, (end_ms, start_ms, id)) AS version FROM updates WHERE end_ms IS NOT NULL GROUP BY car_id")
def latest_firmware(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.latest_firmware(_updates(spark, sf_dir))


@query(with_frames("observations") + UPDATES + " SELECT count(*) AS rows, count(end_ms) AS completed, count(*) FILTER (end_ms IS NULL) AS open, count(*) FILTER (version IS NULL) AS null_version, count(*) FILTER (version = '') AS empty_version, min(start_ms) AS min_start_ms, max(start_ms) AS max_start_ms, min(end_ms) AS min_end_ms, max(end_ms) AS max_end_ms FROM updates")
def update_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.update_summary(_updates(spark, sf_dir))


@query(with_frames("observations") + UPDATES + " SELECT id, car_id, trim(version) AS version, start_ms, end_ms FROM updates WHERE end_ms IS NOT NULL AND trim(coalesce(version, '')) <> '' AND start_ms > 0 AND end_ms >= start_ms")
def project_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.project_update(_updates(spark, sf_dir)).select("id", "car_id", "version", "start_ms", "end_ms")


@query(with_frames("positions") + " SELECT drive_id, count(DISTINCT id) AS n FROM positions WHERE drive_id IS NOT NULL GROUP BY drive_id")
def materialisation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.positions(spark, sf_dir).select("id", "drive_id")
    return reconcile.materialisation_report(folds.spread(rows, A.table(spark, sf_dir, "lineitem").count(), "drive_id", per=250_000), "drive_id")


@query("SELECT 'line' AS entity, l_orderkey * 10 + l_linenumber AS id, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1 OR l_orderkey * 10 + l_linenumber <= 0")
def duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.duplicate_ids(line=A.table(spark, sf_dir, "lineitem").select(F.expr("l_orderkey * 10 + l_linenumber").alias("id")))


@query("WITH m AS (SELECT greatest(max(o_orderkey), 1) AS top FROM orders) SELECT o_orderkey, greatest(0, least((o_orderkey - 1) * 8 // top, 7)) AS shard FROM orders, m")
def id_range_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema.id_range_shards(A.table(spark, sf_dir, "orders").select("o_orderkey"), 8, "o_orderkey").select("o_orderkey", "shard")


# Geography --------------------------------------------------------------------------------------

_NEAR = """, p AS (SELECT id, latitude, longitude FROM positions), m AS (SELECT p.id, g.id AS geofence_id, g.radius, pow(sin(radians(g.latitude - p.latitude) / 2), 2) + cos(radians(p.latitude)) * cos(radians(g.latitude)) * pow(sin(radians(g.longitude - p.longitude) / 2), 2) AS a
  FROM p JOIN geofences g ON abs(g.latitude - p.latitude) < 0.1 WHERE g.radius > 0 AND g.radius < 5000),
  near AS (SELECT id, geofence_id, 2 * 6378168.0 * atan2(sqrt(least(1, greatest(0, a))), sqrt(1 - least(1, greatest(0, a)))) AS d, radius FROM m)"""


@query(with_frames("positions", "geofences") + _NEAR + " SELECT id, arg_min(geofence_id, (round(d * 1000), geofence_id)) AS geofence_id, round(min(d) * 10) / 10 AS distance_m FROM near WHERE d < radius GROUP BY id")
def nearest_geofence(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = geo.nearest_geofence(A.positions(spark, sf_dir), A.geofences(spark, sf_dir))
    return out.select("id", "geofence_id", S.scaled_round(F.col("distance_m"), 1).alias("distance_m"))


@query(with_frames("positions", "geofences") + _NEAR + """, best AS (SELECT id, arg_min(geofence_id, (round(d * 1000), geofence_id)) AS geofence_id FROM near WHERE d < radius GROUP BY id)
  SELECT p.id, coalesce(CASE WHEN p.id % 5 = 0 THEN 'home' END, g.name) AS geofence FROM positions p LEFT JOIN best b ON b.id = p.id LEFT JOIN geofences g ON g.id = b.geofence_id""")
def geofence_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each position as the start of a drive."""
    spots = A.positions(spark, sf_dir).select("id", F.col("latitude").alias("start_latitude"), F.col("longitude").alias("start_longitude"), F.lit(None).cast("double").alias("end_latitude"), F.lit(None).cast("double").alias("end_longitude"), F.expr("CASE WHEN id % 5 = 0 THEN 'home' END").alias("start_geofence"), F.lit(None).cast("string").alias("end_geofence"))
    return geo.fill_labels(spots, A.geofences(spark, sf_dir)).select("id", F.col("start_geofence").alias("geofence"))


@query(with_frames("positions") + """ SELECT id, (CASE WHEN latitude < 0 THEN 'S' ELSE 'N' END) || lpad(CAST(abs(CAST(floor(latitude) AS INT)) AS VARCHAR), 2, '0') || (CASE WHEN longitude < 0 THEN 'W' ELSE 'E' END) || lpad(CAST(abs(CAST(floor(longitude) AS INT)) AS VARCHAR), 3, '0') AS tile,
  CAST(trunc((floor(latitude) + 1 - latitude) * 1200) AS INT) * 1201 + CAST(trunc((longitude - floor(longitude)) * 1200) AS INT) AS cell FROM positions""")
def tile_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.positions(spark, sf_dir).select("id", S.tile_name(F.col("latitude"), F.col("longitude")).alias("tile"), S.tile_cell(F.col("latitude"), F.col("longitude"), F.lit(1201)).alias("cell"))


# Change capture ---------------------------------------------------------------------------------


def _version(rows: DataFrame, entity: str = "drive") -> DataFrame:
    digest = S.row_digest(F.lit(entity), F.col("id"), F.col("car_id"), "o_totalprice")
    return rows.select(F.lit(entity).alias("entity"), "id", "car_id", digest.alias("digest"), F.col("o_totalprice").cast("decimal(20,2)").cast("string").alias("payload"))


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = A.drives(spark, sf_dir)
    d = folds.spread(d.select("id", "car_id", "o_totalprice"), d.count(), "id", per=250_000)
    later = d.where("id % 7 <> 0").withColumn("o_totalprice", F.when(F.col("id") % 5 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return _version(d.where("id % 3 <> 0")), _version(later)


VERSIONS = with_frames("drives") + """, prior AS (SELECT 'drive' AS entity, id, car_id, CAST(CAST(o_totalprice AS DECIMAL(20,2)) AS VARCHAR) AS payload FROM drives WHERE id % 3 <> 0),
  now AS (SELECT 'drive' AS entity, id, car_id, CAST(CAST(CASE WHEN id % 5 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS DECIMAL(20,2)) AS VARCHAR) AS payload FROM drives WHERE id % 7 <> 0)"""


@query(VERSIONS + " SELECT n.entity, n.id, CASE WHEN p.id IS NULL THEN 'new' WHEN p.payload = n.payload THEN 'unchanged' ELSE 'changed' END AS status FROM now n LEFT JOIN prior p ON p.id = n.id")
def classify_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cdc.classify_changes(*_versions(spark, sf_dir)).select("entity", "id", "status")


@query(VERSIONS + " SELECT entity, id, car_id FROM prior WHERE id NOT IN (SELECT id FROM now)")
def tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cdc.tombstones(*_versions(spark, sf_dir))


@query(VERSIONS + " SELECT entity, id, car_id, payload FROM now")
def apply_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    prior, now = _versions(spark, sf_dir)
    return cdc.apply_deltas(prior, cdc.build_delta(prior, now, 1))


def _feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.table(spark, sf_dir, "lineitem")
    op = F.when(F.col("l_partkey") % 5 == 0, "delete").otherwise("upsert")
    return rows.groupBy(F.col("l_orderkey").alias("id"), F.col("l_linenumber").cast("bigint").alias("seq")).agg(F.min("l_partkey").alias("l_partkey")).select(F.lit("drive").alias("entity"), "id", (F.col("id") % 100).alias("car_id"), op.alias("op"), F.when(op == "upsert", F.col("l_partkey").cast("string")).alias("payload"), "seq")


FEED = "WITH feed AS (SELECT 'drive' AS entity, l_orderkey AS id, l_orderkey % 100 AS car_id, CASE WHEN min(l_partkey) % 5 = 0 THEN 'delete' ELSE 'upsert' END AS op, CASE WHEN min(l_partkey) % 5 <> 0 THEN CAST(min(l_partkey) AS VARCHAR) END AS payload, CAST(l_linenumber AS BIGINT) AS seq FROM lineitem GROUP BY l_orderkey, l_linenumber)"


@query(FEED + " SELECT * FROM feed WHERE seq <= 3 UNION ALL SELECT entity, id, car_id, op, payload, (SELECT max(seq) FROM feed) AS seq FROM feed WHERE seq > 3 QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1")
def compact_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cdc.compact(_feed(spark, sf_dir), 3)


@query(FEED + ", last AS (SELECT * FROM feed WHERE seq <= 5 QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1), base AS (SELECT 'drive' AS entity, o_orderkey AS id, o_orderkey % 100 AS car_id, 'base' AS payload FROM orders) SELECT b.entity, b.id, b.car_id, coalesce(l.payload, b.payload) AS payload FROM base b LEFT JOIN last l ON l.id = b.id WHERE l.op IS DISTINCT FROM 'delete'")
def replay_to_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = A.table(spark, sf_dir, "orders").select(F.lit("drive").alias("entity"), F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 100).alias("car_id"), F.lit("base").alias("payload"))
    return cdc.apply_deltas(base, _feed(spark, sf_dir), at_seq=5)


@query(FEED + " SELECT CASE WHEN op = 'delete' THEN 'tombstone' ELSE entity END AS entity, count(*) AS n, CASE WHEN op = 'delete' THEN 3 ELSE 1 END AS rank FROM feed GROUP BY ALL")
def tables_in_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cdc.tables_in_delta(_feed(spark, sf_dir))


@query(FEED + """, d AS (SELECT *, CAST(payload AS BIGINT) AS p FROM feed) SELECT 'soc' AS rule, entity, id FROM d WHERE p % 110 > 100 UNION ALL SELECT 'interval', entity, id FROM d WHERE p % 9 = 0
  UNION ALL SELECT 'coordinates', entity, id FROM d WHERE p % 7 = 0 UNION ALL SELECT 'positive id', entity, id FROM feed WHERE id <= 0 UNION ALL SELECT 'one car', NULL, seq FROM feed GROUP BY seq HAVING count(DISTINCT car_id) > 1""")
def delta_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed with payloads of levels, times and places, some of them out of bounds."""
    p = F.col("payload").cast("bigint")
    body = F.to_json(F.struct((p % 110).alias("start_soc"), F.lit(10).alias("start_ms"), F.when(p % 9 == 0, 9).otherwise(10).alias("end_ms"), F.when(p % 7 == 0, 91.0).otherwise(45.0).alias("latitude"), F.lit(1.0).alias("longitude")))
    return cdc.validate_delta(_feed(spark, sf_dir).withColumn("payload", F.when(p.isNotNull(), body)), "a" * 64)


def _lineage(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two base packs and a chain of deltas for each customer's orders, spoilt by order key in one way or another; and heads."""
    rows = A.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("car_id"), F.col("o_orderkey").alias("to_seq"))
    chains = folds.spread(rows, rows.count(), "car_id").groupBy("car_id").agg(F.array_sort(F.collect_list("to_seq")).alias("seqs"))  # some orders a customer
    base = F.sha2(F.concat(F.lit("base"), F.col("car_id").cast("string")), 256)
    walk = "aggregate(seqs, named_struct('at', -1L, 'digest', {base}, 'all', array()), (s, x) -> named_struct('at', x, 'digest', sha2(concat('delta-v2/', s.digest, ':', sha2(concat('pack', x), 256)), 256), 'all', concat(s.all, array(named_struct('from_seq', s.at, 'to_seq', x, 'parent', s.digest, 'chain', sha2(concat('delta-v2/', s.digest, ':', sha2(concat('pack', x), 256)), 256))))))"
    typed = "cast(array() as array<struct<from_seq: bigint, to_seq: bigint, parent: string, chain: string>>)"
    walked = chains.withColumn("base_digest", base).withColumn("w", F.expr(walk.replace("{base}", "base_digest").replace("array())", f"{typed})", 1)))
    d = walked.select("car_id", F.explode("w.all").alias("d")).select("car_id", "d.*")
    spoilt = lambda k, c, other: F.when(F.col("to_seq") % k == 0, other).otherwise(F.col(c)).alias(c)
    deltas = d.select("car_id", F.lit("delta").alias("kind"), F.lit(None).cast("bigint").alias("ordinal"), spoilt(13, "from_seq", F.col("from_seq") - 1), "to_seq", spoilt(11, "parent", F.lit("x")), spoilt(19, "chain", F.lit("y")), F.sha2(F.concat(F.lit("pack"), F.col("to_seq").cast("string")), 256).alias("digest"), F.concat(F.lit("p"), F.when(F.col("to_seq") % 23 == 0, F.lit(0)).otherwise(F.col("to_seq")).cast("string")).alias("pack"), (F.col("to_seq") % 40).alias("rows"), F.when(F.col("to_seq") % 17 == 0, -1).otherwise(F.col("to_seq") % 40).cast("bigint").alias("declared_rows"))
    bases = walked.where("car_id % 10 <> 0").select("car_id", F.lit("base").alias("kind"), F.explode(F.array(F.lit(0).cast("bigint"), F.when(F.col("car_id") % 7 == 0, 2).otherwise(1).cast("bigint"))).alias("ordinal"), F.lit(-1).cast("bigint").alias("from_seq"), F.lit(-1).cast("bigint").alias("to_seq"), F.lit(cdc.ZERO).alias("parent"), F.col("base_digest").alias("chain"), F.col("base_digest").alias("digest"))
    bases = bases.withColumns({"pack": F.concat(F.lit("b"), "ordinal"), "rows": F.lit(5).cast("bigint"), "declared_rows": F.lit(5).cast("bigint")})
    heads = walked.select("car_id", F.lit(-1).cast("bigint").alias("base_seq"), F.when(F.col("car_id") % 29 == 0, cdc.ZERO).otherwise(F.col("base_digest")).alias("base_digest"), F.when(F.col("car_id") % 3 == 0, F.col("w.at") + 1).otherwise(F.col("w.at")).alias("head_seq"), F.col("w.digest").alias("head_digest"))
    return bases.unionByName(deltas), heads


LINEAGE = f"""WITH RECURSIVE o AS (SELECT o_custkey AS car_id, o_orderkey AS x, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders),
  chain AS (SELECT car_id, CAST(0 AS BIGINT) AS k, CAST(-1 AS BIGINT) AS from_seq, CAST(-1 AS BIGINT) AS to_seq, '' AS parent, sha256('base' || car_id) AS chain FROM o WHERE k = 1
    UNION ALL SELECT o.car_id, o.k, c.to_seq, o.x, c.chain, sha256('delta-v2/' || c.chain || ':' || sha256('pack' || o.x)) FROM chain c JOIN o ON o.car_id = c.car_id AND o.k = c.k + 1),
  deltas AS (SELECT car_id, 'delta' AS kind, NULL AS ordinal, CASE WHEN to_seq % 13 = 0 THEN from_seq - 1 ELSE from_seq END AS from_seq, to_seq, CASE WHEN to_seq % 11 = 0 THEN 'x' ELSE parent END AS parent, CASE WHEN to_seq % 19 = 0 THEN 'y' ELSE chain END AS chain, sha256('pack' || to_seq) AS digest,
    'p' || CASE WHEN to_seq % 23 = 0 THEN 0 ELSE to_seq END AS pack, to_seq % 40 AS rows, CASE WHEN to_seq % 17 = 0 THEN -1 ELSE to_seq % 40 END AS declared_rows FROM chain WHERE k > 0),
  bases AS (SELECT car_id, 'base' AS kind, unnest([0, CASE WHEN car_id % 7 = 0 THEN 2 ELSE 1 END]) AS ordinal, -1 AS from_seq, -1 AS to_seq, '{cdc.ZERO}' AS parent, chain, chain AS digest, 5 AS rows FROM chain WHERE k = 0 AND car_id % 10 <> 0),
  heads AS (SELECT car_id, -1 AS base_seq, CASE WHEN car_id % 29 = 0 THEN '{cdc.ZERO}' ELSE sha256('base' || car_id) END AS base_digest, CASE WHEN car_id % 3 = 0 THEN to_seq + 1 ELSE to_seq END AS head_seq, chain AS head_digest FROM chain QUALIFY row_number() OVER (PARTITION BY car_id ORDER BY k DESC) = 1),
  d AS (SELECT *, lag(to_seq) OVER w AS prior, lag(chain) OVER w AS prior_chain, lead(to_seq) OVER w AS next, count(*) OVER (PARTITION BY car_id, pack) AS twice FROM deltas WINDOW w AS (PARTITION BY car_id ORDER BY to_seq))"""


@query(LINEAGE + f""" SELECT car_id, 'base pack' AS rule, CAST(-1 AS BIGINT) AS to_seq FROM bases WHERE ordinal = 2
  UNION ALL SELECT car_id, 'contiguous', to_seq FROM d WHERE from_seq <> coalesce(prior, -1) UNION ALL SELECT car_id, 'forward', to_seq FROM d WHERE to_seq <= from_seq
  UNION ALL SELECT car_id, 'parent digest', to_seq FROM d JOIN heads USING (car_id) WHERE parent <> coalesce(prior_chain, base_digest) UNION ALL SELECT car_id, 'chain digest', to_seq FROM d WHERE chain <> sha256('delta-v2/' || parent || ':' || digest)
  UNION ALL SELECT car_id, 'unique pack', to_seq FROM d WHERE twice > 1 UNION ALL SELECT car_id, 'declared rows', to_seq FROM d WHERE rows <> declared_rows UNION ALL SELECT car_id, 'pack rows', to_seq FROM d WHERE rows > 38
  UNION ALL SELECT car_id, 'head', to_seq FROM d JOIN heads USING (car_id) WHERE next IS NULL AND (to_seq <> head_seq OR chain <> head_digest)
  UNION ALL SELECT car_id, 'base', NULL FROM heads WHERE car_id NOT IN (SELECT car_id FROM bases) UNION ALL SELECT car_id, 'base digest', NULL FROM heads WHERE base_digest = '{cdc.ZERO}'
  UNION ALL SELECT car_id, CASE WHEN kind = 'n' THEN 'too many packs' ELSE 'too many rows' END, NULL FROM (SELECT car_id, count(*) > 20 AS n, sum(rows) > 760 AS r FROM (SELECT car_id, rows FROM bases UNION ALL SELECT car_id, rows FROM deltas) GROUP BY car_id) UNPIVOT (broken FOR kind IN (n, r)) WHERE broken""")
def lineage_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With limits that some of these lineages break: 20 packs and 38 rows each."""
    return cdc.lineage_check(*_lineage(spark, sf_dir), most=20, pack_rows=38)


@query(LINEAGE + """, packs AS (SELECT car_id, kind, from_seq, to_seq, parent, rows, rows * 10 AS bytes FROM bases UNION ALL SELECT car_id, kind, from_seq, to_seq, parent, rows, rows * 10 FROM deltas),
  t AS (SELECT *, sum(rows) OVER w AS r, sum(bytes) OVER w AS b, row_number() OVER w AS k FROM packs WHERE kind = 'delta' WINDOW w AS (PARTITION BY car_id ORDER BY to_seq DESC)),
  f AS (SELECT * FROM t WHERE r <= 90 AND b <= 850 AND k >= 2 QUALIFY row_number() OVER (PARTITION BY car_id ORDER BY k DESC) = 1),
  c AS (SELECT car_id, count(*) AS n, max(to_seq) AS head_seq FROM packs GROUP BY car_id), a AS (SELECT c.*, CASE WHEN n + 1 <= 12 THEN 'none' WHEN k IS NOT NULL THEN 'compact' WHEN n + 1 <= 20 THEN 'defer' ELSE 'exhausted' END AS action, f.* EXCLUDE (car_id) FROM c LEFT JOIN f ON f.car_id = c.car_id)
  SELECT car_id, action, CASE WHEN action = 'compact' THEN from_seq END AS anchor_seq, CASE WHEN action = 'compact' THEN parent END AS anchor_digest, CASE WHEN action = 'compact' THEN head_seq END AS head_seq, CAST(CASE WHEN action = 'compact' THEN k END AS INTEGER) AS replaced, CAST(CASE WHEN action = 'compact' THEN r END AS BIGINT) AS rows, CAST(CASE WHEN action = 'compact' THEN b END AS BIGINT) AS bytes FROM a""")
def compaction_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With limits of 20 packs, 90 rows and 850 bytes."""
    packs = _lineage(spark, sf_dir)[0]
    return cdc.compaction_plan(packs.withColumn("bytes", F.col("rows") * 10), most=20, max_rows=90, max_bytes=850)


@query(VERSIONS + ", u AS (SELECT entity, id, car_id, payload FROM prior UNION ALL SELECT entity, id, car_id, payload FROM now) SELECT entity, id, count(*) AS n, count(DISTINCT payload) > 1 AS conflict FROM u GROUP BY entity, id")
def dedupe_or_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    prior, now = _versions(spark, sf_dir)
    return reconcile.dedupe_or_conflict(prior.unionByName(now))


def tree_sql(rows: str, by: str, of: str = "rows") -> str:
    """Common tables of the hash trees (nodes) of rows (by, id, digest), with depths by the number of rows in `of`."""
    return f"""one AS (SELECT DISTINCT {by}, id, digest FROM {rows}), sized AS (SELECT {by}, 1 + {" + ".join(f"CAST(count(*) > {64 * 16**k} AS INT)" for k in range(1, 8))} AS depth FROM (SELECT DISTINCT {by}, id, digest FROM {of}) GROUP BY {by}),
  nodes AS (SELECT {by}, depth AS level, left(sha256(CAST(id AS VARCHAR)), depth) AS prefix, count(*) AS n, sha256(string_agg(id || ':' || digest, chr(10) ORDER BY id || ':' || digest)) AS h, true AS leaf FROM one JOIN sized USING ({by}) GROUP BY ALL
    UNION ALL SELECT {by}, level - 1, left(prefix, level - 1), CAST(sum(n) AS BIGINT), sha256(string_agg(prefix || ':' || h, chr(10) ORDER BY prefix || ':' || h)), false FROM nodes WHERE level > 0 GROUP BY {by}, level, left(prefix, level - 1))"""


DIGESTED = VERSIONS.replace("WITH", "WITH RECURSIVE", 1) + """, now_rows AS (SELECT id % 3 AS lot, id, sha256(concat_ws(':', entity, id, car_id, payload)) AS digest FROM now), prior_rows AS (SELECT id % 3 AS lot, id, sha256(concat_ws(':', entity, id, car_id, payload)) AS digest FROM prior), """


def _digested(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    return [v.select((F.col("id") % 3).alias("lot"), "id", F.sha2(F.concat_ws(":", "entity", "id", "car_id", "payload"), 256).alias("digest")) for v in _versions(spark, sf_dir)]


@query(DIGESTED + tree_sql("now_rows", "lot", "now_rows") + " SELECT lot, n, h AS fingerprint FROM nodes WHERE level = 0")
def dataset_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.dataset_fingerprint(_digested(spark, sf_dir)[1], ["lot"])


@query(DIGESTED + tree_sql("now_rows", "lot", "now_rows") + " SELECT lot, level, prefix, n, h AS hash, leaf FROM nodes")
def refreshed_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree of the later version, from the prior one's and the keys that changed between."""
    prior, now = (v.alias(n) for v, n in zip(_digested(spark, sf_dir), "ab", strict=True))
    same = (F.col("a.lot") == F.col("b.lot")) & (F.col("a.id") == F.col("b.id"))
    changed = prior.join(now, same, "full").where(~F.col("a.digest").eqNullSafe(F.col("b.digest"))).select(F.coalesce("a.lot", "b.lot").alias("lot"), F.coalesce("a.id", "b.id").alias("id"))
    return merkle.refreshed(merkle.hash_tree(prior, ["lot"]), now, changed, ["lot"]).select("lot", "level", "prefix", "n", "hash", "leaf")


@query(DIGESTED + tree_sql("now_rows", "lot", "now_rows") + ", " + tree_sql("prior_rows", "lot", "prior_rows").replace("one AS", "one2 AS").replace("FROM one ", "FROM one2 ").replace("sized", "sized2").replace("nodes", "nodes2") + """
  SELECT DISTINCT coalesce(a.lot, b.lot) AS lot, coalesce(a.level, b.level) AS level, coalesce(a.prefix, b.prefix) AS prefix FROM nodes a FULL JOIN nodes2 b ON a.lot = b.lot AND a.level = b.level AND a.prefix = b.prefix WHERE a.h IS DISTINCT FROM b.h AND (coalesce(a.leaf, false) OR coalesce(b.leaf, false))""")
def differing_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.differing(*[merkle.hash_tree(v, ["lot"]) for v in _digested(spark, sf_dir)], ["lot"])


@query(VERSIONS + ", a AS (SELECT car_id, string_agg(id || ':' || payload, ',' ORDER BY id) AS f FROM prior GROUP BY car_id), b AS (SELECT car_id, string_agg(id || ':' || payload, ',' ORDER BY id) AS f FROM now GROUP BY car_id) SELECT b.car_id FROM b LEFT JOIN a ON a.car_id = b.car_id AND a.f = b.f WHERE a.car_id IS NULL")
def skip_unchanged(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (reconcile.dataset_fingerprint(v, ["car_id"]) for v in _versions(spark, sf_dir))
    return cdc.skip_unchanged(a, b).select("car_id")


@query(FEED.replace("WITH", "WITH RECURSIVE", 1) + """, u AS (SELECT car_id, id * 10 + seq AS place, length(payload) + CASE WHEN id % 50 = 0 THEN 1500 ELSE 20 END AS bytes FROM feed WHERE op = 'upsert'),
  n AS (SELECT *, row_number() OVER (PARTITION BY car_id ORDER BY place) AS k FROM u),
  g AS (SELECT car_id, k, bytes, CAST(0 AS BIGINT) AS batch, CAST(1 AS BIGINT) AS taken, CAST(bytes AS BIGINT) AS total FROM n WHERE k = 1
    UNION ALL SELECT n.car_id, n.k, n.bytes, g.batch + CASE WHEN g.taken = 64 OR g.total + n.bytes > 2000 THEN 1 ELSE 0 END, CASE WHEN g.taken = 64 OR g.total + n.bytes > 2000 THEN 1 ELSE g.taken + 1 END, CASE WHEN g.taken = 64 OR g.total + n.bytes > 2000 THEN n.bytes ELSE g.total + n.bytes END FROM g JOIN n ON n.car_id = g.car_id AND n.k = g.k + 1)
  SELECT car_id, batch, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes FROM g GROUP BY ALL""")
def batch_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _feed(spark, sf_dir).where("op = 'upsert'").withColumns({"place": F.col("id") * 10 + F.col("seq"), "bytes": F.length("payload") + F.when(F.col("id") % 50 == 0, 1500).otherwise(20)})
    return cdc.batch_changes(rows, max_rows=64, max_bytes=2000, by="car_id", order="place").groupBy("car_id", "batch").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))


# Quality ----------------------------------------------------------------------------------------


@query(with_frames("positions", "drives", "charges", "samples") + """ SELECT 'drive' AS entity, id, 'positive id' AS rule FROM drives WHERE id <= 0 UNION ALL SELECT 'drive', id, 'completed' FROM drives WHERE end_ms IS NULL
  UNION ALL SELECT 'charge', id, 'positive id' FROM charges WHERE id <= 0 UNION ALL SELECT 'position', id, 'soc' FROM positions WHERE battery_level NOT BETWEEN 0 AND 100
  UNION ALL SELECT 'charge_sample', id, 'power' FROM samples WHERE power < 0
  UNION ALL SELECT 'position', id, 'unique id' FROM positions GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'charge_sample', id, 'unique id' FROM samples GROUP BY id HAVING count(*) > 1""")
def snapshot_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.validate_snapshot(A.drives(spark, sf_dir), A.positions(spark, sf_dir), A.charges(spark, sf_dir), A.samples(spark, sf_dir))


@query(STATED + """, s AS (SELECT car_id * 100000 + row_number() OVER (PARTITION BY car_id ORDER BY start_ms) AS id, car_id, state, start_ms, CASE WHEN start_ms % 50 = 0 THEN NULL ELSE end_ms END AS end_ms FROM intervals)
  SELECT 'state' AS entity, id, 'one open state' AS rule FROM (SELECT *, count(*) OVER (PARTITION BY car_id) AS n FROM s WHERE end_ms IS NULL) WHERE n > 1""")
def state_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.row_number().over(intervals.W.partitionBy("car_id").orderBy("start_ms"))
    rows = state_intervals(spark, sf_dir).withColumns({"id": F.col("car_id") * 100000 + at, "end_ms": F.when(F.col("start_ms") % 50 != 0, F.col("end_ms"))})
    return quality.validate_states(rows)


@query(with_frames("observations") + UPDATES + " SELECT 'update' AS entity, id, 'version' AS rule FROM updates WHERE trim(coalesce(version, '')) = '' UNION ALL SELECT 'update', id, 'positive id' FROM updates WHERE id <= 0")
def update_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.validate_updates(_updates(spark, sf_dir))
