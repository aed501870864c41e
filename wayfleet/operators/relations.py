"""Joins and projections of the relational import.

Source frames: cars, car_settings, drives, positions, charges (processes), samples, addresses,
geofences, states, updates, with the columns of `wayfleet.sources.schema`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayfleet.functions.scalars import clean_text, first_nonblank, marketing_name, nonblank, normalize_efficiency, normalize_model, normalize_trim

# The closed domain of states, and the model of a car that names none.
STATES = ["online", "offline", "asleep"]
UNKNOWN_MODEL = "Unknown Tesla"


def with_settings(cars: DataFrame, settings: DataFrame) -> DataFrame:
    """Cars with their settings; a car without settings is left out (see quality.relationship_checks)."""
    own = settings.select(F.col("id").alias("settings_id"), *[F.col(c).alias(f"setting_{c}") for c in settings.columns if c != "id"])
    return cars.join(own, "settings_id")


def of_car(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Children whose parent is in parents (id)."""
    return children.join(parents.select(F.col("id").alias(key)), key, "left_semi")


def referenced(dims: DataFrame, *users: tuple[DataFrame, str]) -> DataFrame:
    """Rows of dims (id) that any of the foreign keys names: one semi join against the union of keys."""
    keys = None
    for frame, col in users:
        own = frame.select(F.col(col).alias("id")).where("id is not null")
        keys = own if keys is None else keys.unionByName(own)
    return dims.join(keys.distinct(), "id", "left_semi")


def read_related(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return rows.join(ids.select(key).distinct(), key, "left_semi")


def drive_endpoints(drives: DataFrame, positions: DataFrame, addresses: DataFrame, geofences: DataFrame) -> DataFrame:
    """drives with the six optional lookups of their ends, and n_dangling: keys that name nothing or another car's position."""
    out, dangling = drives, F.lit(0)
    for side in ("start", "end"):
        spots = positions.select(F.col("id").alias(f"{side}_position_id"), F.col("car_id").alias(f"_{side}_car"), *[F.col(c).alias(f"{side}_{n}") for c, n in (("latitude", "latitude"), ("longitude", "longitude"), ("battery_level", "soc"))])
        out = out.join(spots, f"{side}_position_id", "left")
        out = out.join(addresses.select(F.col("id").alias(f"{side}_address_id"), F.col("display_name").alias(f"{side}_address")), f"{side}_address_id", "left")
        out = out.join(geofences.select(F.col("id").alias(f"{side}_geofence_id"), F.col("name").alias(f"{side}_geofence")), f"{side}_geofence_id", "left")
        for key, got in ((f"{side}_position_id", F.col(f"_{side}_car") == F.col("car_id")), (f"{side}_address_id", F.col(f"{side}_address").isNotNull()), (f"{side}_geofence_id", F.col(f"{side}_geofence").isNotNull())):
            dangling = dangling + F.when(F.col(key).isNotNull() & ~F.coalesce(got, F.lit(False)), 1).otherwise(0)
    return out.withColumn("n_dangling", dangling).drop("_start_car", "_end_car")


def require_lookups(drives: DataFrame) -> DataFrame:
    """The rows of drive_endpoints, each held to keys that name something when it is read."""
    return drives.where(F.assert_true(F.col("n_dangling") == 0, "a drive names what isn't there, or another car's position").isNull())


def charge_lookups(charges: DataFrame, positions: DataFrame | None, addresses: DataFrame, geofences: DataFrame) -> DataFrame:
    """charges with the coordinates of their position, the address's display name and name, the geofence's tariff, and n_dangling as in drive_endpoints."""
    out, found = charges, {}
    if positions is not None:
        out = out.join(positions.select(F.col("id").alias("position_id"), F.col("car_id").alias("_spot_car"), F.col("latitude").alias("start_latitude"), F.col("longitude").alias("start_longitude")), "position_id", "left")
        found["position_id"] = F.col("_spot_car") == F.col("car_id")
    name = F.col("name") if "name" in addresses.columns else F.lit(None).cast("string")
    out = out.join(addresses.select(F.col("id").alias("address_id"), F.col("display_name").alias("address"), name.alias("location_name"), F.lit(True).alias("_met")), "address_id", "left")
    fence = geofences.select(F.col("id").alias("geofence_id"), F.col("name").alias("geofence"), "billing_type", "cost_per_unit", "session_fee", F.lit(True).alias("_fenced"))
    out = out.join(fence, "geofence_id", "left")
    dangling = F.lit(0)
    for key, got in (found | {"address_id": F.col("_met"), "geofence_id": F.col("_fenced")}).items():
        dangling = dangling + F.when(F.col(key).isNotNull() & ~F.coalesce(got, F.lit(False)), 1).otherwise(0)
    return out.withColumn("n_dangling", dangling).drop("_spot_car", "_met", "_fenced")


def with_completed(positions: DataFrame, drives: DataFrame) -> DataFrame:
    """Positions with _attached: they have no drive, or one with an end."""
    done = drives.where("end_ms is not null").select(F.col("id").alias("_done"))
    return positions.join(done, F.col("drive_id") == F.col("_done"), "left").withColumn("_attached", F.col("drive_id").isNull() | F.col("_done").isNotNull()).drop("_done")


def in_completed_drive(positions: DataFrame, drives: DataFrame) -> DataFrame:
    """Positions without a drive, or of a drive with an end."""
    return with_completed(positions, drives).where("_attached").drop("_attached")


def position_in_drive(positions: DataFrame, drives: DataFrame) -> DataFrame:
    """Positions outside their drive's time."""
    own = drives.select(F.col("id").alias("drive_id"), "start_ms", "end_ms")
    return positions.join(own, "drive_id").where((F.col("date_ms") < F.col("start_ms")) | (F.col("date_ms") > F.col("end_ms")))


def union_newest(first: DataFrame, second: DataFrame, key: str = "id") -> DataFrame:
    """Rows of two reads by id; the second read's row wins."""
    both = first.withColumn("_read", F.lit(1)).unionByName(second.withColumn("_read", F.lit(2)))
    return both.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(F.desc("_read")))).where("_n = 1").drop("_n", "_read")


def reconcile_open(first: tuple[DataFrame, DataFrame], second: tuple[DataFrame, DataFrame], parent: str) -> tuple[DataFrame, DataFrame]:
    """Two reads of (open parents, their children): the second wins; first-read children join only where the car's parent is the same in both."""
    same = first[0].join(second[0].select("car_id", "id"), ["car_id", "id"], "left_semi").select(F.col("id").alias(parent))
    return second[0], union_newest(first[1].join(same, parent, "left_semi"), second[1])


# Projections ------------------------------------------------------------------------------------


def require_car(rows: DataFrame, car_id: int) -> DataFrame:
    """The rows, each held to a positive id and this car when it is read."""
    return rows.where(F.assert_true((F.col("id") > 0) & (F.col("car_id") == car_id), "a row has another car or no positive id").isNull())


def project_car(cars: DataFrame, firmware: DataFrame | None = None) -> DataFrame:
    """Names, model, trim and efficiency in canonical form, a marketing name (its own or a derived one), and the latest firmware of (car_id, version)."""
    model, trim = normalize_model("model"), normalize_trim("trim")
    own = nonblank("marketing_name") if "marketing_name" in cars.columns else F.lit(None).cast("string")
    out = cars.select(
        "id", F.coalesce(nonblank("name"), F.concat(F.lit("Car "), F.col("id").cast("string"))).alias("name"), F.coalesce(F.when(model != "", model), F.lit(UNKNOWN_MODEL)).alias("model"),
        trim.alias("trim"), normalize_efficiency("efficiency").alias("efficiency_wh_per_km"), F.coalesce(own, marketing_name("model", "trim", nonblank("model"))).alias("marketing_name"),
    )
    if firmware is not None:
        out = out.join(firmware.select(F.col("car_id").alias("id"), F.col("version").alias("firmware_version")), "id", "left")
    return out


def with_lookups(drives: DataFrame, positions: DataFrame, addresses: DataFrame, geofences: DataFrame) -> DataFrame:
    """drive_endpoints with efficiency and optimized_at_ms, which are null."""
    return drive_endpoints(drives, positions, addresses, geofences).withColumns({"efficiency": F.lit(None).cast("double"), "optimized_at_ms": F.lit(None).cast("bigint")})


def project_drive(drives: DataFrame, positions: DataFrame, addresses: DataFrame, geofences: DataFrame) -> DataFrame:
    """Completed drives with their lookups."""
    return with_lookups(drives.where("end_ms is not null"), positions, addresses, geofences)


def project_position(positions: DataFrame, drives: DataFrame) -> DataFrame:
    return in_completed_drive(positions, drives)


def project_charge(charges: DataFrame, facts: DataFrame, addresses: DataFrame, geofences: DataFrame, positions: DataFrame | None = None) -> DataFrame:
    """Processes with their lookups, facts of their samples, and the interval widened to hold these."""
    out = charge_lookups(charges, positions, addresses, geofences).join(facts.withColumnRenamed("charge_id", "id"), "id", "left")
    end = F.when(F.col("end_ms").isNotNull(), F.greatest("end_ms", "last_ms"))
    return out.withColumns({"start_ms": F.least("start_ms", "first_ms"), "end_ms": end, "is_dc": F.coalesce("is_dc", F.lit(False))}).drop("first_ms", "last_ms")


def project_charge_sample(samples: DataFrame) -> DataFrame:
    return samples.withColumnsRenamed({"charge_id": "charge_process_id", "date_ms": "timestamp_ms"})


def project_state(states: DataFrame) -> DataFrame:
    """States of the closed domain; another one stops the job."""
    return states.where(F.assert_true(F.col("state").isin(STATES), "a state is outside its domain").isNull())


def sound_update(updates: DataFrame) -> DataFrame:
    """Updates with sound: they are completed, with a version and an interval in order."""
    rows = updates.withColumn("version", nonblank("version"))
    return rows.withColumn("sound", F.expr("coalesce(end_ms is not null and version is not null and start_ms > 0 and end_ms >= start_ms, false)"))


def project_update(updates: DataFrame) -> DataFrame:
    """Completed updates with a version and a sound interval."""
    return sound_update(updates).where("sound").drop("sound")


def open_rows(rows: DataFrame, end: str = "end_ms") -> DataFrame:
    """Each car's open row, where it has exactly one."""
    return rows.where(F.col(end).isNull()).withColumn("_n", F.count("*").over(W.partitionBy("car_id"))).where("_n = 1").drop("_n")


def select_open_positions(positions: DataFrame, drives: DataFrame) -> DataFrame:
    """Positions without a drive and those of the open drives."""
    active = open_rows(drives).select(F.col("id").alias("drive_id"))
    return positions.where("drive_id is null").unionByName(positions.join(active, "drive_id", "left_semi"), allowMissingColumns=True)


def car_from_snapshot(snapshots: DataFrame, name: str = "Vehicle") -> DataFrame:
    """One row per car from its latest snapshot (car_id, at_ms, observation_id, display_name, vin, car_version, car_type, trim)."""
    latest = snapshots.groupBy("car_id").agg(F.max_by(F.struct(*[c for c in snapshots.columns if c != "car_id"]), F.struct("at_ms", "observation_id")).alias("s"))
    return latest.select("car_id", F.coalesce(clean_text("s.display_name"), F.lit(name)).alias("name"), clean_text("s.vin").alias("vin"), clean_text("s.car_version").alias("firmware_version"), normalize_model("s.car_type").alias("model"), normalize_trim("s.trim").alias("trim"), marketing_name("s.car_type", "s.trim", "s.car_type").alias("marketing_name"))


def physical_projection(rows: DataFrame, decimals: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """Every source column as it is; decimals exactly as DecimalType(p, s)."""
    return rows.select(*[F.col(c).cast(f"decimal({decimals[c][0]},{decimals[c][1]})").alias(c) if decimals and c in decimals else F.col(c) for c in rows.columns])


def first_text(rows: DataFrame, out: str, *cols: str) -> DataFrame:
    return rows.withColumn(out, first_nonblank(*cols))
