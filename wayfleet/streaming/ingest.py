"""From the observation log to facts and dead letters, in one streaming plan with two sinks.

Log rows are parsed by their record type. A full snapshot or a stream update must carry an object with its fields, a
discovery record has none: it moves the car's state and closes sessions, without data of its own. Stream updates that
aren't newer than all before them are left out, groups that an import covered are emptied, and the lifecycle folds the rest.

A row that is no record drops what is open and becomes a dead letter, with its payload and the reason. It passes through
the lifecycle as every row does, so a replay gives no second letter. Each micro-batch is written once, split
by where its rows go, and shown by one rename to its number: readers see a batch's facts and letters together or not at
all, and a batch that is tried again finds its number taken and changes nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfleet.operators import intervals
from wayfleet.sources import commits
from wayfleet.sources import observations as live
from wayfleet.streaming import lifecycle

LETTER = {"reason": "string", "payload": "string"}
ROUTED = lifecycle.OUT + "".join(f", {c} {kind}" for c, kind in LETTER.items())
FIELDS = [c for c in live.FIELDS if c not in ("elevation", "charger_power", "charger_voltage", "charger_phases", "fast_present")]
MARKS = "car_id long, drive_ms long, charge_ms long, vehicle_ms long"


def defect(body: Column, record: str) -> Column:
    """Why a payload is no record of the log, given what it reads as (observations.RECORD) and its record_type; null for a record."""
    kind = F.col("record_type")
    return (
        F.when(body.isNull(), "no payload")
        .when(F.col(record).isNull() & F.try_parse_json(body).isNull(), "no JSON")
        .when(F.col(record).isNull(), "no object")
        .when(kind.isNull() | ~kind.isin(live.FULL, live.DISCOVERY, live.UPDATE), "unknown record type")
        .when((kind == live.FULL) & F.col(f"{record}.vehicle_data").isNull(), "no vehicle data")
        .when((kind == live.UPDATE) & F.col(f"{record}.fields").isNull(), "no fields")
    )


def records(log: DataFrame) -> DataFrame:
    """The log (observations.LOG) as the lifecycle reads it, with each group's time, the record type, and reason and payload of what is no record.

    Fields come from the object that the record type names; a discovery record's are null, whatever else its payload holds.
    """
    body = F.col("payload")
    rows = live.with_fields(live.with_record(log, "_record"), "_record", *FIELDS).withColumn("reason", defect(body, "_record"))
    carries = F.col("reason").isNull() & (F.col("record_type") != live.DISCOVERY)
    has = lambda group: carries & (F.col(f"_record.vehicle_data.{group}").isNotNull() | F.col(f"_record.fields.{group}").isNotNull())
    rows = rows.withColumns({c: F.when(carries, F.col(c)) for c in FIELDS} | {"drive_data": has("drive_state")})
    state = F.lower("vehicle_state")
    phase = F.when(F.col("reason").isNull(), intervals.classify_phase(state, F.col("update_status"), F.col("charging_state"), F.col("shift_state"), F.col("speed"))).otherwise(state)
    moving = F.col("drive_data") & (F.coalesce(F.upper("shift_state").isin(intervals.DRIVING_SHIFTS), F.lit(False)) | F.coalesce(F.col("speed") > 0, F.lit(False)))
    out = {"at_ms": F.col("observed_at_ms"), "phase": phase, "broken": F.col("reason").isNotNull(), "status": F.col("update_status"), "moving": moving, "payload": F.when(F.col("reason").isNotNull(), body)}
    names = [c.split()[0] for c in lifecycle.IN.split(", ")]
    kinds = dict(c.split() for c in lifecycle.IN.split(", "))
    rows = rows.withColumns(out)
    return rows.select(*[F.col(c).cast(kinds[c]).alias(c) for c in names], "drive_ts", "charge_ts", "vehicle_ts", "record_type", *LETTER)


def facts(log: DataFrame, marks: DataFrame | None = None, seeds: DataFrame | None = None, **how: int) -> DataFrame:
    """A stream of the log -> ROUTED. marks (MARKS): what an import covered; seeds: (car_id, lifecycle.STATE)."""
    rows = records(log)
    frame = (F.col("record_type") == live.UPDATE) & ~F.col("broken")
    rows = rows.withColumn("ts_ms", F.when(frame, F.coalesce("drive_ts", "at_ms")))
    fresh = lifecycle.fresh_frames(rows, received="at_ms", order="observation_id", others=True)
    if marks is not None:
        gated = lifecycle.gate(fresh.withColumn("_told", F.col("phase")), marks)
        fresh = gated.withColumns({"phase": F.when(F.col("broken"), F.col("_told")).otherwise(F.col("phase")), "moving": F.col("moving") & F.col("drive_data")}).drop("_told")
    return lifecycle.lifecycle_stream(fresh, seeds, letters=LETTER, **how)


def write(routed: DataFrame, path: str, checkpoint: str):
    """Facts and dead letters of a stream (ROUTED), each micro-batch shown whole and once."""
    commits.made(routed.sparkSession, f"{path}/batches")

    def one(batch: DataFrame, number: int) -> None:
        draft = f"{path}/draft/{uuid.uuid4().hex}"
        to = F.when(F.col("entity") == "quarantine", "letters").otherwise("facts")
        batch.withColumn("to", to).write.partitionBy("to").parquet(draft)
        commits.renamed(batch.sparkSession, draft, f"{path}/batches/batch={number}")

    return routed.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _read(spark: SparkSession, path: str, to: str) -> DataFrame:
    return spark.read.schema(f"{ROUTED}, batch long, to string").parquet(f"{path}/batches").where(F.col("to") == to)


def read_facts(spark: SparkSession, path: str) -> DataFrame:
    """lifecycle.OUT of all shown batches."""
    return _read(spark, path, "facts").drop("batch", "to", *LETTER)


def read_letters(spark: SparkSession, path: str) -> DataFrame:
    """(car_id, observation_id, at_ms, reason, payload, batch) of all shown batches."""
    return _read(spark, path, "letters").select("car_id", "observation_id", F.col("start_ms").alias("at_ms"), *LETTER, "batch")
