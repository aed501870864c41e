"""Source tables' columns, as Spark schema text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMAS = {
    "cars": "id short, eid long, vid long, vin string, name string, model string, efficiency double, trim_badging string, marketing_name string, exterior_color string, wheel_type string, spoiler_type string, display_priority short, inserted_at timestamp_ntz, updated_at timestamp_ntz, settings_id long",
    "car_settings": "id long, suspend_min int, suspend_after_idle_min int, req_not_unlocked boolean, free_supercharging boolean, use_streaming_api boolean, enabled boolean, lfp_battery boolean",
    "drives": "id int, car_id short, start_date timestamp_ntz, end_date timestamp_ntz, start_position_id int, end_position_id int, start_address_id int, end_address_id int, start_geofence_id int, end_geofence_id int, outside_temp_avg decimal(4,1), inside_temp_avg decimal(4,1), speed_max short, power_max short, power_min short, start_ideal_range_km decimal(6,2), end_ideal_range_km decimal(6,2), start_rated_range_km decimal(6,2), end_rated_range_km decimal(6,2), start_km double, end_km double, distance double, duration_min short, ascent short, descent short",
    "positions": "id int, car_id short, drive_id int, date timestamp_ntz, latitude decimal(8,6), longitude decimal(9,6), elevation short, speed short, power short, odometer double, ideal_battery_range_km decimal(6,2), est_battery_range_km decimal(6,2), rated_battery_range_km decimal(6,2), battery_level short, usable_battery_level short, battery_heater boolean, battery_heater_on boolean, battery_heater_no_power boolean, outside_temp decimal(4,1), inside_temp decimal(4,1), fan_status int, driver_temp_setting decimal(4,1), passenger_temp_setting decimal(4,1), is_climate_on boolean, is_rear_defroster_on boolean, is_front_defroster_on boolean, tpms_pressure_fl decimal(4,1), tpms_pressure_fr decimal(4,1), tpms_pressure_rl decimal(4,1), tpms_pressure_rr decimal(4,1)",
    "charging_processes": "id int, car_id short, position_id int, address_id int, geofence_id int, start_date timestamp_ntz, end_date timestamp_ntz, charge_energy_added decimal(8,2), charge_energy_used decimal(8,2), start_ideal_range_km decimal(6,2), end_ideal_range_km decimal(6,2), start_rated_range_km decimal(6,2), end_rated_range_km decimal(6,2), start_battery_level short, end_battery_level short, duration_min short, outside_temp_avg decimal(4,1), cost decimal(6,2)",
    "charges": "id int, charging_process_id int, date timestamp_ntz, battery_heater boolean, battery_heater_on boolean, battery_heater_no_power boolean, battery_level short, usable_battery_level short, charge_energy_added decimal(8,2), charger_actual_current short, charger_phases short, charger_pilot_current short, charger_power short, charger_voltage short, conn_charge_cable string, fast_charger_present boolean, fast_charger_brand string, fast_charger_type string, ideal_battery_range_km decimal(6,2), rated_battery_range_km decimal(6,2), not_enough_power_to_heat boolean, outside_temp decimal(4,1)",
    "states": "id int, car_id short, state string, start_date timestamp_ntz, end_date timestamp_ntz",
    "updates": "id int, car_id short, start_date timestamp_ntz, end_date timestamp_ntz, version string",
    "addresses": "id int, display_name string, latitude decimal(8,6), longitude decimal(9,6), name string, house_number string, road string, neighbourhood string, city string, county string, postcode string, state string, state_district string, country string, raw string, inserted_at timestamp_ntz, updated_at timestamp_ntz, osm_id long, osm_type string",
    "geofences": "id int, name string, latitude decimal(8,6), longitude decimal(9,6), radius short, billing_type string, cost_per_unit decimal(6,4), session_fee decimal(6,2), inserted_at timestamp_ntz, updated_at timestamp_ntz",
}


def schema(name: str) -> T.StructType:
    return T._parse_datatype_string(SCHEMAS[name])


def differences(df: DataFrame, name: str) -> list[str]:
    """What a frame's schema lacks or has otherwise than the pinned one."""
    have = {f.name: f.dataType for f in df.schema.fields}
    want = {f.name: f.dataType for f in schema(name).fields}
    return [f"{c}: {have.get(c, 'missing')} instead of {t}" for c, t in want.items() if have.get(c) != t] + [f"{c}: not in the contract" for c in have if c not in want]


def read_table(spark: SparkSession, path: str, name: str, car_id: int | None = None) -> DataFrame:
    """A table's pinned columns from Parquet, of one car if given; the filter reaches the scan."""
    df = spark.read.parquet(f"{path}/{name}.parquet")
    wrong = differences(df, name)
    if wrong:
        raise ValueError(f"{name}: " + "; ".join(wrong))
    return df.where(F.col("car_id") == car_id) if car_id is not None and "car_id" in df.columns else df


def read_jdbc(spark: SparkSession, url: str, name: str, top: int, shards: int, **options: str) -> DataFrame:
    """A table over JDBC in contiguous ranges of id."""
    return spark.read.format("jdbc").options(url=url, dbtable=name, partitionColumn="id", lowerBound="0", upperBound=str(top), numPartitions=str(shards), **options).load()


def id_range_shards(df: DataFrame, shards: int, key: str = "id") -> DataFrame:
    """df with shard: (0, max] in contiguous ranges, bounds by whole division; ids outside take the nearest."""
    top = df.agg(F.greatest(F.max(key), F.lit(1)).alias("_top"))
    at = F.expr(f"({key} - 1) * {shards} div _top")
    return df.crossJoin(F.broadcast(top)).withColumn("shard", F.greatest(F.lit(0).cast("bigint"), F.least(at, F.lit(shards - 1).cast("bigint")))).drop("_top")
