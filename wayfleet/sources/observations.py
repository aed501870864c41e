"""Live input: observation logs, stream frames, geocoder answers, COPY text and elevation tiles."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfleet.functions.scalars import as_bool, as_float, as_int, as_text, as_timestamp, miles_to_km, mph_to_kmh, nonblank

LOG = "observation_id long, car_id long, observed_at_ms long, vehicle_state string, payload string"
# Record types of the log, and the fields of a stream frame in order.
FULL, DISCOVERY, UPDATE = "owner_api_vehicle_data_v1", "owner_api_discovery_v1", "tesla_stream_update_v1"
FRAME = ["speed", "odometer", "soc", "elevation", "est_heading", "est_lat", "est_lng", "power", "shift_state", "range", "est_range", "heading"]


def read_observations(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """The append-only log of JSON lines, as batch or stream."""
    return (spark.readStream if stream else spark.read).schema(LOG).json(path)


# The log's fields by name, with how and where they are read.
FIELDS = {
    "drive_ts": (as_timestamp, "drive_state.timestamp"), "shift_state": (as_text, "drive_state.shift_state"), "speed": (as_float, "drive_state.speed"), "latitude": (as_float, "drive_state.latitude"),
    "longitude": (as_float, "drive_state.longitude"), "power": (as_float, "drive_state.power"), "elevation": (as_int, "drive_state.native_location_elevation"),
    "charge_ts": (as_timestamp, "charge_state.timestamp"), "charging_state": (as_text, "charge_state.charging_state"), "battery_level": (as_int, "charge_state.battery_level"), "ideal_km": (as_float, "charge_state.ideal_battery_range"),
    "rated_km": (as_float, "charge_state.battery_range"), "energy": (as_float, "charge_state.charge_energy_added"), "charger_power": (as_int, "charge_state.charger_power"), "charger_voltage": (as_int, "charge_state.charger_voltage"),
    "charger_phases": (as_int, "charge_state.charger_phases"), "fast_present": (as_bool, "charge_state.fast_charger_present"), "inside_temp": (as_float, "climate_state.inside_temp"), "outside_temp": (as_float, "climate_state.outside_temp"),
    "vehicle_ts": (as_timestamp, "vehicle_state.timestamp"), "odometer": (as_float, "vehicle_state.odometer"), "version": (as_text, "vehicle_state.car_version"), "update_status": (as_text, "vehicle_state.software_update.status"),
}
UNITS = {"speed": mph_to_kmh, "ideal_km": miles_to_km, "rated_km": miles_to_km, "odometer": lambda x: miles_to_km(x, 6)}


def _read_as(paths: list[str]) -> str:
    """The type that holds a variant at each path."""
    first = dict.fromkeys(p.partition(".")[0] for p in paths)
    inner = {f: [p.partition(".")[2] for p in paths if p.partition(".")[0] == f] for f in first}
    return "struct<" + ", ".join(f"{f}: {_read_as(ps) if all(ps) else 'variant'}" for f, ps in inner.items()) + ">"


_DATA = _read_as([path for _, path in FIELDS.values()])
RECORD = f"struct<record_type: variant, vehicle_data: {_DATA}, fields: {_DATA}>"


def with_record(log: DataFrame, out: str = "record") -> DataFrame:
    """The log with its payload read once, as RECORD: null where it is no object, as is each part that the payload holds as something else."""
    return log.withColumn(out, F.try_variant_get(F.try_parse_json("payload"), "$", RECORD))


def parsed(log: DataFrame) -> DataFrame:
    """The log with its payload's fields in canonical units; `broken` marks a payload that doesn't parse. Groups a record lacks are null."""
    rows = with_record(log, "_record").withColumn("broken", F.try_parse_json("payload").isNull() & F.col("payload").isNotNull())
    return with_fields(rows, "_record").drop("_record")


def with_fields(rows: DataFrame, record: str, *names: str) -> DataFrame:
    """rows with record_type and FIELDS (all without names) of a RECORD in canonical units.

    Fields that are read alike are read as one array, so that a reader's expression stands in the plan once, not once a field.
    """
    wanted = list(names or FIELDS)
    alike = {how: [n for n in wanted if FIELDS[n][0] is how] for how in dict.fromkeys(FIELDS[n][0] for n in wanted)}
    spots = {how: F.array(*[F.col(f"{record}.{part}.{FIELDS[n][1]}") for part in ("vehicle_data", "fields") for n in own]) for how, own in alike.items()}
    read = rows.withColumns({f"_{how.__name__}": F.transform(all_of, how) for how, all_of in spots.items()})

    def field(name: str) -> Column:
        how = FIELDS[name][0]
        place, cells = alike[how].index(name), F.col(f"_{how.__name__}")
        got = F.coalesce(cells[place], cells[place + len(alike[how])])
        return UNITS[name](got) if name in UNITS else got

    out = read.withColumns({"record_type": as_text(F.col(f"{record}.record_type"))} | {n: field(n) for n in wanted})
    return out.drop(*[f"_{how.__name__}" for how in alike])


def parse_stream_frames(df: DataFrame, col: str = "value") -> DataFrame:
    """JSON envelopes of comma-separated frames -> tag, ts_ms and the frame's fields; `reject` tells why a row is no frame.

    Twelve values need the envelope's timestamp, thirteen begin with their own and forbid it. Empty values are
    null; malformed or non-finite numbers reject the frame, as does a tag outside [A-Za-z0-9_-]{1,128}.
    """
    out = df.withColumns({"_tag": F.get_json_object(col, "$.tag"), "_ts": F.get_json_object(col, "$.timestamp"), "_v": F.get_json_object(col, "$.value")})
    out = out.withColumn("_p", F.split("_v", ",", -1)).withColumn("_n", F.size("_p"))
    out = out.withColumn("_own", F.col("_n") == 13)
    field = lambda i: nonblank(F.get("_p", F.lit(i) + F.when(F.col("_own"), 1).otherwise(0)))
    values = {name: field(i) for i, name in enumerate(FRAME)}
    numbers = {n: v.try_cast("double") for n, v in values.items() if n != "shift_state"}
    ts = F.when(F.col("_own"), F.get("_p", F.lit(0))).otherwise(F.col("_ts")).try_cast("bigint")
    bad = F.lit(False)
    for n, v in numbers.items():
        bad = bad | (values[n].isNotNull() & (v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))))
    reject = (
        F.when(F.col("_v").isNull(), "no value").when(~F.col("_n").isin(12, 13), "wrong number of values").when(F.col("_own") & F.col("_ts").isNotNull(), "two timestamps")
        .when(ts.isNull() | (ts <= 0), "no timestamp").when(~F.coalesce(F.col("_tag").rlike("^[A-Za-z0-9_-]{1,128}$"), F.lit(False)), "bad tag").when(bad, "bad number")
    )
    good = reject.isNull()
    kept = {"tag": F.when(good, F.col("_tag")), "ts_ms": F.when(good, ts)} | {n: F.when(good, numbers.get(n, values[n])) for n in FRAME}
    return out.withColumns(kept | {"reject": reject}).drop("_tag", "_ts", "_v", "_p", "_n", "_own")


def frame_payload(frames: DataFrame) -> DataFrame:
    """Parsed frames (car_id, ts_ms, FRAME) in the log's shape; missing values stay missing. Altitude goes under elevation, which the log's reader doesn't take."""
    drive = F.struct(F.col("ts_ms").alias("timestamp"), "speed", F.col("est_lat").alias("latitude"), F.col("est_lng").alias("longitude"), "power", "shift_state", "elevation")
    charge = F.struct(F.col("ts_ms").alias("timestamp"), F.col("soc").alias("battery_level"), F.col("range").alias("battery_range"), F.col("est_range").alias("est_battery_range"))
    vehicle = F.struct(F.col("ts_ms").alias("timestamp"), "odometer")
    fields = F.struct(drive.alias("drive_state"), charge.alias("charge_state"), vehicle.alias("vehicle_state"))
    return frames.select("car_id", F.col("ts_ms").alias("observed_at_ms"), F.lit("online").alias("vehicle_state"), F.to_json(F.struct(F.lit(UPDATE).alias("record_type"), fields.alias("fields"))).alias("payload"))


def require_power_for_parked(frames: DataFrame, state: str = "vehicle_state") -> DataFrame:
    """Frames of a sleeping or offline vehicle count only with a power reading."""
    return frames.where(~F.col(state).isin("asleep", "offline") | F.col("power").isNotNull())


def read_copy_csv(df: DataFrame, col: str, names: list[str]) -> DataFrame:
    """Lines of COPY text in CSV form: an unquoted \\N is null, doubled quotes and backslash escapes inside quotes are text, "" is the empty text."""
    cell = r'(?:^|,)("(?:[^"\\]|""|\\.)*"|[^,]*)'
    cells = F.regexp_extract_all(col, F.lit(cell), 1)

    def value(c: Column) -> Column:
        text = F.regexp_replace(F.replace(F.substr(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"')), r"\\(.)", "$1")
        return F.when(c == "\\N", None).when(c.startswith('"'), text).otherwise(c)

    return df.withColumn("_c", cells).select(*df.columns, *[value(F.get("_c", F.lit(i))).alias(n) for i, n in enumerate(names)], (F.size("_c") != len(names)).alias("malformed"))


# The address parts of a geocoder's answer.
ADDRESS = ["house_number", "road", "neighbourhood", "city", "county", "postcode", "state", "state_district", "country", "country_code"]


def parse_geocode_json(df: DataFrame, col: str = "body") -> DataFrame:
    """Reverse-geocoder answers -> osm_type, osm_id, display_name, name, latitude, longitude and address parts; valid is false where there is no result."""
    get = lambda path: F.get_json_object(col, path)
    osm_id = get("$.osm_id").try_cast("bigint")
    lat, lon = get("$.lat").try_cast("double"), get("$.lon").try_cast("double")
    ok = get("$.error").isNull() & get("$.osm_type").isin("node", "way", "relation") & (osm_id > 0) & nonblank(get("$.display_name")).isNotNull() & lat.between(-90, 90) & lon.between(-180, 180)
    ok = F.coalesce(ok, F.lit(False))
    cols = {"osm_type": get("$.osm_type"), "osm_id": osm_id, "display_name": nonblank(get("$.display_name")), "name": nonblank(get("$.name")), "latitude": lat, "longitude": lon} | {p: nonblank(get(f"$.address.{p}")) for p in ADDRESS}
    return df.withColumns({c: F.when(ok, v) for c, v in cols.items()} | {"valid": ok})


TILE_BYTES = {2 * 1201 * 1201: 1201, 2 * 3601 * 3601: 3601}


def read_elevation_tiles(spark: SparkSession, path: str) -> DataFrame:
    """(tile, side, row, cells), one row of a grid each, of big-endian 16-bit grids named like N47E008; a file of another length stops the job when it is read."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for place, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                data, name = content.as_buffer(), re.search(r"([NS]\d{2}[EW]\d{3})[^/]*$", place)
                if data.size not in TILE_BYTES or not name:
                    raise ValueError(f"not an elevation tile: {place}")
                side, cells = TILE_BYTES[data.size], pa.array(np.frombuffer(data, dtype=">i2").astype(np.int16))
                lines = pa.ListArray.from_arrays(pa.array(np.arange(side + 1) * side, pa.int32()), cells)
                yield pa.RecordBatch.from_arrays([pa.array([name[1]] * side), pa.array([side] * side, pa.int32()), pa.array(range(side), pa.int32()), lines], names=["tile", "side", "row", "cells"])

    return files.mapInArrow(decoded, "tile string, side int, row int, cells array<short>")
