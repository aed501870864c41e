"""State intervals, software updates and forward fills over observations.

Observations have car_id, at_ms, observation_id and what an operator names; order is (at_ms, observation_id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

from wayfleet.functions.scalars import bool_field, firmware_newer, float_field, int_field, nonblank, text_field

DRIVING_SHIFTS = ["D", "R", "N"]


def by_car() -> WindowSpec:
    return W.partitionBy("car_id").orderBy("at_ms", "observation_id")


def before() -> WindowSpec:
    """A car's rows ahead of this one."""
    return by_car().rowsBetween(W.unboundedPreceding, -1)


def so_far() -> WindowSpec:
    return by_car().rowsBetween(W.unboundedPreceding, 0)


def classify_phase(vehicle_state: Column, update_status: Column, charging_state: Column, shift: Column, speed: Column) -> Column:
    """The phase of an observation; what is tested first wins."""
    state = F.lower(vehicle_state)
    return (
        F.when(state == "asleep", "asleep")
        .when(state == "offline", "offline")
        .when(F.lower(update_status) == "installing", "updating")
        .when(F.lower(charging_state).isin("starting", "charging"), "charging")
        .when(F.upper(shift).isin(DRIVING_SHIFTS) | (speed > 0), "driving")
        .when(state == "online", "online")
        .otherwise(state)
    )


def logical_state(phase: Column) -> Column:
    return F.when(phase.isin("online", "driving", "charging", "updating", "parked"), "online").when(phase.isin("asleep", "offline"), phase)


def poll_phase(payload: Column | str) -> Column:
    """What a full snapshot is polled for: updating, charging, driving, else online."""
    installing = text_field(payload, "$.vehicle_state.software_update.status") == "installing"
    charging = F.lower(text_field(payload, "$.charge_state.charging_state")).isin("starting", "charging")
    driving = text_field(payload, "$.drive_state.shift_state").isin(DRIVING_SHIFTS) | (float_field(payload, "$.drive_state.speed") > 0)
    return F.when(installing, "updating").when(charging, "charging").when(driving, "driving").otherwise("online")


def sleep_eligible(payload: Column | str, require_locked: bool = True) -> Column:
    """Nothing in a full snapshot keeps the vehicle awake."""
    yes = lambda path: F.coalesce(bool_field(payload, path), F.lit(False))
    number = lambda path: F.coalesce(float_field(payload, path), F.lit(0.0))
    awake = yes("$.vehicle_state.is_user_present") | yes("$.vehicle_state.sentry_mode") | yes("$.climate_state.is_preconditioning")
    awake = awake | F.coalesce(text_field(payload, "$.climate_state.climate_keeper_mode").isin("dog", "camp", "on"), F.lit(False)) | (number("$.drive_state.power") > 0)
    for opening in ("df", "pf", "dr", "pr", "ft", "rt"):
        awake = awake | (F.coalesce(int_field(payload, f"$.vehicle_state.{opening}"), F.lit(0)) > 0)
    percent = number("$.vehicle_state.software_update.download_perc")
    awake = awake | (F.coalesce(text_field(payload, "$.vehicle_state.software_update.status") == "downloading", F.lit(False)) & (percent < 100))
    if require_locked:
        awake = awake | ~yes("$.vehicle_state.locked")
    return (poll_phase(payload) == "online") & ~awake


def state_intervals(obs: DataFrame, state: str = "state") -> DataFrame:
    """(car_id, state, start_ms, end_ms): equal neighbouring states merge; a change ends at the new row's time; the last stays open; null is ignored."""
    known = obs.where(F.col(state).isNotNull())
    starts = known.withColumn("before", F.lag(state).over(by_car())).where(~F.col("before").eqNullSafe(F.col(state)))
    return starts.select("car_id", F.col(state).alias("state"), F.col("at_ms").alias("start_ms"), F.lead("at_ms").over(by_car()).alias("end_ms"))


def time_in_state(intervals: DataFrame) -> DataFrame:
    """Closed time and number of intervals by car and state."""
    spent = F.coalesce(F.col("end_ms") - F.col("start_ms"), F.lit(0))
    return intervals.groupBy("car_id", "state").agg(F.sum(spent).alias("closed_ms"), F.count("*").alias("n_intervals"), F.count_if(F.col("end_ms").isNull()).alias("n_open"))


def fill_sparse(obs: DataFrame, *cols: str) -> DataFrame:
    """The last value that isn't null is carried forward."""
    return obs.withColumns({c: F.last(c, ignorenulls=True).over(so_far()) for c in cols})


def software_updates(obs: DataFrame, status: str = "status", version: str = "version") -> DataFrame:
    """(car_id, start_ms, end_ms, version): from 'installing' to the first later row with a version of a vehicle that is online; none if the status turns 'available' first. Open ones lack an end."""
    own = obs.select("car_id", "at_ms", "observation_id", F.col(status).alias("status"), F.when(~F.col("phase").isin("asleep", "offline"), nonblank(version)).alias("version"))
    event = F.when(F.col("status") == "installing", "start").when(F.col("status") == "available", "cancel").when(F.col("version").isNotNull(), "done")
    rows = own.withColumn("event", event).where("event is not null")
    rows = rows.withColumn("before", F.lag("event").over(by_car())).where("event <> 'start' or before is null or before <> 'start'")
    rows = rows.withColumns({"next": F.lead("event").over(by_car()), "next_ms": F.lead("at_ms").over(by_car()), "next_version": F.lead("version").over(by_car())})
    return rows.where("event = 'start' and (next is null or next = 'done')").select("car_id", F.col("at_ms").alias("start_ms"), F.col("next_ms").alias("end_ms"), F.col("next_version").alias("version"))


def missed_updates(obs: DataFrame, version: str = "version", installing: Column | None = None) -> DataFrame:
    """(car_id, at_ms, version, before): the version rose over the last known one while no update was open."""
    rows = obs.where(nonblank(version).isNotNull()).withColumn("before", F.lag(version).over(by_car()))
    rows = rows.where(F.col("before").isNotNull() & firmware_newer(version, "before"))
    if installing is not None:
        rows = rows.where(~installing)
    return rows.select("car_id", F.col("at_ms"), F.col(version).alias("version"), "before")


def effective_phase(obs: DataFrame) -> DataFrame:
    """obs (phase, charging_state, drive_data, drive_open, charge_open: see sessions.with_open) with effective.

    Charging holds through offline and through an online row without a charging state while a charge is open, driving through
    offline and through an online row without drive data while a drive is open, updating through offline; and each only
    while it held on every row between.
    """
    phase = F.col("phase")
    setter = ~F.coalesce(phase.isin("online", "offline"), F.lit(False))
    rows = obs.withColumn("_run", F.sum(setter.cast("bigint")).over(so_far()))
    own = W.partitionBy("car_id", "_run").orderBy("at_ms", "observation_id")
    rows = rows.withColumn("_held", F.first(phase).over(own))
    online, offline = phase == "online", phase == "offline"
    bare = lambda c: F.coalesce(~F.col(c), F.lit(True))
    holds = (
        F.when(F.col("_held") == "charging", F.col("charge_open") & (offline | (online & F.col("charging_state").isNull())))
        .when(F.col("_held") == "driving", F.col("drive_open") & (offline | (online & bare("drive_data"))))
        .otherwise((F.col("_held") == "updating") & offline)
    )
    broken = F.sum((~setter & ~F.coalesce(holds, F.lit(False))).cast("bigint")).over(own.rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("_broken", broken).withColumn("effective", F.when(F.col("_broken") == 0, F.col("_held")).otherwise(phase)).drop("_run", "_held", "_broken")


def merge_metadata(obs: DataFrame, *cols: str) -> DataFrame:
    """One row per car: each field's latest value that isn't null."""
    order = F.struct("at_ms", "observation_id")
    return obs.groupBy("car_id").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in cols])


def observation_watermark(obs: DataFrame) -> DataFrame:
    """(car_id, observation_id, at_ms) of each car's latest observation."""
    return obs.groupBy("car_id").agg(F.max("observation_id").alias("observation_id"), F.max_by("at_ms", "observation_id").alias("at_ms"))


def newer_than(marks: DataFrame, given: DataFrame) -> DataFrame:
    """marks with newer: whether the car's latest observation id is over the given one; a car without one is newer."""
    return marks.join(given.select("car_id", F.col("observation_id").alias("given")), "car_id", "left").withColumn("newer", F.coalesce(F.col("observation_id") > F.col("given"), F.lit(True))).drop("given")
