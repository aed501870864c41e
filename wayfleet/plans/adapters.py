"""Telemetry frames from the star-schema test tables, by fixed arithmetic; SQL holds the same for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfleet.functions.scalars import epoch_ms


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observed(table(spark, sf_dir, "events"))


def observed(events: DataFrame) -> DataFrame:
    """Events, batch or stream, as observations."""
    phase = F.expr("CASE event_type WHEN 'view' THEN 'online' WHEN 'click' THEN 'driving' WHEN 'purchase' THEN 'charging' WHEN 'signup' THEN 'asleep' WHEN 'error' THEN 'offline' END")
    soc = F.get_json_object("props", "$.k").try_cast("bigint")
    version = F.concat(F.lit("2024."), F.floor(F.col("event_id") / 500).cast("string"))
    return events.select(F.col("event_id").alias("observation_id"), F.col("user_id").alias("car_id"), epoch_ms("ts").alias("at_ms"), phase.alias("phase"), F.when(F.col("event_type") != "error", F.col("value")).alias("power"), soc.alias("soc"), F.when(F.col("event_id") % 5 == 0, version).alias("version"), "props")


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return table(spark, sf_dir, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(*_position_columns())


def _key() -> str:
    return "((l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey) * 1000 + l_suppkey % 1000"


def _position_columns() -> list:
    return [
        F.expr(_key()).alias("id"), F.col("l_orderkey").alias("drive_id"), F.col("o_custkey").alias("car_id"),
        (epoch_ms("l_shipdate") + F.col("l_linenumber") * 60000).cast("bigint").alias("date_ms"),
        F.expr("CAST(l_suppkey * 37 % 170 - 85 AS DOUBLE) + 0.5").alias("latitude"), F.expr("CAST(l_suppkey * 53 % 350 - 175 AS DOUBLE) + CAST(l_partkey % 8 AS DOUBLE) / 128").alias("longitude"),
        F.expr("CASE WHEN l_linenumber % 3 <> 0 THEN CAST(l_quantity AS BIGINT) * 7 + l_partkey % 100 END").alias("elevation"),
        F.expr("CAST(l_quantity AS BIGINT)").alias("speed"), F.expr("CAST(round(l_discount * 100) AS BIGINT) * 5 - 20").alias("power"),
        F.expr("CASE WHEN l_partkey % 10 <> 0 THEN l_linenumber * 10 + l_quantity / 4 END").alias("odometer"),
        F.expr("l_suppkey % 101").alias("battery_level"), F.expr("CAST(round(l_tax * 100) AS DOUBLE) * 2.5").alias("outside_temp"),
        F.expr("CASE WHEN l_returnflag <> 'N' THEN 20.0D + l_linenumber END").alias("inside_temp"), F.expr("300 - l_quantity * 2").alias("ideal_km"), F.expr("280 - l_quantity * 2").alias("rated_km"),
    ]


def drives(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = epoch_ms("o_orderdate")
    end = F.when(F.col("o_orderstatus") != "O", start + (F.col("o_orderkey") % 240 + 1) * 60000)
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("car_id"), start.alias("start_ms"), end.alias("end_ms"), F.expr("CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 25 END").alias("start_address_id"), F.expr("o_orderkey % 25").alias("end_address_id"), F.expr("CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 10 END").alias("start_geofence_id"), F.expr("CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey % 10 END").alias("end_geofence_id"), "o_totalprice")


def charges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Charging processes."""
    return drives(spark, sf_dir).select("id", "car_id", "start_ms", "end_ms", F.col("start_address_id").alias("address_id"), F.col("start_geofence_id").alias("geofence_id"))


def with_positions(rows: DataFrame, spots: DataFrame, **keys: str) -> DataFrame:
    """rows (id of a drive or its charge) with key=min or key=max: the drive's first or last position by id."""
    found = spots.groupBy("drive_id").agg(*[(F.min if which == "min" else F.max)("id").alias(key) for key, which in keys.items()])
    return rows.join(found.withColumnRenamed("drive_id", "id"), "id", "left")


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of cars, one row an observation of one."""
    seen = observations(spark, sf_dir).where("phase IN ('online', 'offline', 'asleep')")
    return seen.select(F.col("observation_id").alias("id"), "car_id", F.col("phase").alias("state"), F.col("at_ms").alias("start_ms"), F.lit(None).cast("bigint").alias("end_ms"))


def updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Software updates: some are open, some lack a version, some end before they start."""
    n, at = F.col("observation_id"), F.col("at_ms")
    end = F.when(n % 3 != 0, at + F.when(n % 11 == 0, -60_000).otherwise(1_800_000))
    return observations(spark, sf_dir).where("version IS NOT NULL").select(n.alias("id"), "car_id", at.alias("start_ms"), end.cast("bigint").alias("end_ms"), F.when(n % 7 == 0, " ").otherwise(F.col("version")).alias("version"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Charge samples."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return table(spark, sf_dir, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.expr(_key()).alias("id"), F.col("l_orderkey").alias("charge_id"), F.col("o_custkey").alias("car_id"), (epoch_ms("l_shipdate") + F.col("l_linenumber") * 60000).cast("bigint").alias("date_ms"),
        F.expr("CASE WHEN l_partkey % 11 <> 0 THEN l_quantity END").alias("energy"), F.expr("CASE WHEN l_partkey % 5 <> 0 THEN CAST(round(l_discount * 100) AS BIGINT) - CASE WHEN l_partkey % 13 = 0 THEN 8 ELSE 0 END END").alias("power"),
        F.expr("CASE WHEN l_linenumber % 3 <> 0 THEN CAST(l_linenumber % 3 AS BIGINT) END").alias("phases"), F.expr("l_suppkey % 32").alias("current"), F.expr("CAST(220 + l_linenumber AS BIGINT)").alias("voltage"),
        F.expr("l_suppkey % 101").alias("battery_level"), F.expr("300 - l_quantity * 2").alias("ideal_km"), F.expr("280 - l_quantity * 2").alias("rated_km"), F.expr("l_returnflag = 'R'").alias("fast_present"), F.expr("CASE WHEN l_returnflag = 'R' THEN l_linestatus END").alias("fast_type"),
    )


def geofences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.expr("CAST(s_suppkey * 37 % 170 - 85 AS DOUBLE) + 0.5").alias("latitude"), F.expr("CAST(s_suppkey * 53 % 350 - 175 AS DOUBLE)").alias("longitude"), F.expr("CAST(500 + abs(CAST(s_acctbal AS BIGINT)) % 4400 AS DOUBLE)").alias("radius"), F.expr("CASE WHEN s_suppkey % 2 = 0 THEN 'per_kwh' ELSE 'per_minute' END").alias("billing_type"), F.expr("CASE WHEN s_suppkey % 9 <> 0 THEN CAST(s_suppkey % 8 AS DOUBLE) / 16 END").alias("cost_per_unit"), F.expr("CASE WHEN s_suppkey % 3 = 0 THEN 2.0D END").alias("session_fee"))


def addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_name").alias("display_name"), F.expr("CASE WHEN n_nationkey % 3 <> 0 THEN lower(n_name) END").alias("name"))


def cars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.expr("CASE WHEN c_custkey % 5 <> 0 THEN concat('  ', c_name) END").alias("name"), F.expr("CASE c_nationkey % 4 WHEN 0 THEN 'models2' WHEN 1 THEN ' Model 3 ' WHEN 2 THEN 'tamarind' END").alias("model"), F.expr("abs(c_acctbal) / 65536").alias("efficiency"), F.expr("CASE c_custkey % 4 WHEN 0 THEN ' 74d' WHEN 1 THEN '100d' WHEN 2 THEN lower(c_mktsegment) END").alias("trim"), F.col("c_custkey").alias("settings_id"))


#: DuckDB's side of the frames: a query puts the ones it names before its own text.
SQL = {
    "observations": """SELECT event_id AS observation_id, user_id AS car_id, epoch_us(ts) // 1000 AS at_ms,
      CASE event_type WHEN 'view' THEN 'online' WHEN 'click' THEN 'driving' WHEN 'purchase' THEN 'charging' WHEN 'signup' THEN 'asleep' WHEN 'error' THEN 'offline' END AS phase,
      CASE WHEN event_type <> 'error' THEN value END AS power, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS soc,
      CASE WHEN event_id % 5 = 0 THEN '2024.' || (event_id // 500) END AS version, props FROM events""",
    "positions": """SELECT ((l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey) * 1000 + l_suppkey % 1000 AS id, l_orderkey AS drive_id, o_custkey AS car_id,
      CAST(epoch_ms(l_shipdate) + l_linenumber * 60000 AS BIGINT) AS date_ms, CAST(l_suppkey * 37 % 170 - 85 AS DOUBLE) + 0.5 AS latitude,
      CAST(l_suppkey * 53 % 350 - 175 AS DOUBLE) + CAST(l_partkey % 8 AS DOUBLE) / 128 AS longitude,
      CASE WHEN l_linenumber % 3 <> 0 THEN CAST(l_quantity AS BIGINT) * 7 + l_partkey % 100 END AS elevation, CAST(l_quantity AS BIGINT) AS speed,
      CAST(round(l_discount * 100) AS BIGINT) * 5 - 20 AS power, CASE WHEN l_partkey % 10 <> 0 THEN l_linenumber * 10 + l_quantity / 4 END AS odometer,
      l_suppkey % 101 AS battery_level, CAST(round(l_tax * 100) AS DOUBLE) * 2.5 AS outside_temp, CASE WHEN l_returnflag <> 'N' THEN CAST(20 + l_linenumber AS DOUBLE) END AS inside_temp,
      300 - l_quantity * 2 AS ideal_km, 280 - l_quantity * 2 AS rated_km FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "drives": """SELECT o_orderkey AS id, o_custkey AS car_id, epoch_ms(o_orderdate) AS start_ms, CASE WHEN o_orderstatus <> 'O' THEN epoch_ms(o_orderdate) + (o_orderkey % 240 + 1) * 60000 END AS end_ms,
      CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 25 END AS start_address_id, o_orderkey % 25 AS end_address_id, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 10 END AS start_geofence_id,
      CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey % 10 END AS end_geofence_id, o_totalprice FROM orders""",
    "charges": """SELECT o_orderkey AS id, o_custkey AS car_id, epoch_ms(o_orderdate) AS start_ms, CASE WHEN o_orderstatus <> 'O' THEN epoch_ms(o_orderdate) + (o_orderkey % 240 + 1) * 60000 END AS end_ms,
      CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 25 END AS address_id, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 10 END AS geofence_id FROM orders""",
    "samples": """SELECT ((l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey) * 1000 + l_suppkey % 1000 AS id, l_orderkey AS charge_id, o_custkey AS car_id, CAST(epoch_ms(l_shipdate) + l_linenumber * 60000 AS BIGINT) AS date_ms,
      CASE WHEN l_partkey % 11 <> 0 THEN l_quantity END AS energy, CASE WHEN l_partkey % 5 <> 0 THEN CAST(round(l_discount * 100) AS BIGINT) - CASE WHEN l_partkey % 13 = 0 THEN 8 ELSE 0 END END AS power,
      CASE WHEN l_linenumber % 3 <> 0 THEN CAST(l_linenumber % 3 AS BIGINT) END AS phases, l_suppkey % 32 AS current, CAST(220 + l_linenumber AS BIGINT) AS voltage, l_suppkey % 101 AS battery_level,
      300 - l_quantity * 2 AS ideal_km, 280 - l_quantity * 2 AS rated_km, l_returnflag = 'R' AS fast_present, CASE WHEN l_returnflag = 'R' THEN l_linestatus END AS fast_type
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "geofences": """SELECT s_suppkey AS id, s_name AS name, CAST(s_suppkey * 37 % 170 - 85 AS DOUBLE) + 0.5 AS latitude, CAST(s_suppkey * 53 % 350 - 175 AS DOUBLE) AS longitude,
      CAST(500 + abs(CAST(trunc(s_acctbal) AS BIGINT)) % 4400 AS DOUBLE) AS radius, CASE WHEN s_suppkey % 2 = 0 THEN 'per_kwh' ELSE 'per_minute' END AS billing_type,
      CASE WHEN s_suppkey % 9 <> 0 THEN CAST(s_suppkey % 8 AS DOUBLE) / 16 END AS cost_per_unit, CASE WHEN s_suppkey % 3 = 0 THEN CAST(2.0 AS DOUBLE) END AS session_fee FROM supplier""",
    "addresses": "SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS display_name, CASE WHEN n_nationkey % 3 <> 0 THEN lower(n_name) END AS name FROM nation",
    "cars": """SELECT c_custkey AS id, CASE WHEN c_custkey % 5 <> 0 THEN '  ' || c_name END AS name, CASE c_nationkey % 4 WHEN 0 THEN 'models2' WHEN 1 THEN ' Model 3 ' WHEN 2 THEN 'tamarind' END AS model,
      abs(c_acctbal) / 65536 AS efficiency, CASE c_custkey % 4 WHEN 0 THEN ' 74d' WHEN 1 THEN '100d' WHEN 2 THEN lower(c_mktsegment) END AS trim, c_custkey AS settings_id FROM customer""",
}


def with_frames(*names: str) -> str:
    """The opening of a WITH clause that defines the named frames."""
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in names)
