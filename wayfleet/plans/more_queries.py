"""Further registered queries: inventories, receipts, lookups and scalar functions, each beside its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfleet.functions import scalars as S
from wayfleet.operators import cdc, folds, geo, intervals, quality, reconcile, relations
from wayfleet.plans import adapters as A
from wayfleet.plans.adapters import with_frames

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _inventories(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d, c = A.drives(spark, sf_dir), A.charges(spark, sf_dir)
    return reconcile.inventory(drive=d, charge=c), reconcile.inventory(drive=d.where("id % 4 <> 0"), charge=c)


@query(with_frames("drives") + " SELECT 'drive' AS entity, id, car_id FROM drives WHERE id % 4 = 0")
def removed_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.removed_keys(*_inventories(spark, sf_dir))


@query(with_frames("drives") + " SELECT count(*) AS only_first, CAST(0 AS BIGINT) AS only_second FROM drives WHERE id % 4 = 0")
def same_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.same_inventory(*_inventories(spark, sf_dir))


@query(with_frames("drives", "positions") + ", c AS (SELECT 'drives' AS counter, count(*) AS n FROM drives WHERE end_ms IS NOT NULL UNION ALL SELECT 'positions', count(*) FROM positions) SELECT * FROM c UNION ALL SELECT 'logical_rows', CAST(sum(n) AS BIGINT) FROM c")
def projection_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.projection_report(drives=A.drives(spark, sf_dir).where("end_ms is not null"), positions=A.positions(spark, sf_dir))


@query(with_frames("drives", "positions") + " SELECT (SELECT count(*) FROM drives) AS drive, (SELECT count(*) FROM positions) AS position")
def source_witness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.source_witness(drive=A.drives(spark, sf_dir), position=A.positions(spark, sf_dir))


@query(with_frames("cars") + " SELECT id, settings_id, settings_id % 2 = 0 AS setting_enabled FROM cars WHERE settings_id % 4 <> 0")
def cars_with_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    cars = A.cars(spark, sf_dir)
    settings = cars.where("settings_id % 4 <> 0").select(F.col("settings_id").alias("id"), (F.col("settings_id") % 2 == 0).alias("enabled"))
    return relations.with_settings(cars, settings).select("id", "settings_id", "setting_enabled")


@query(with_frames("samples", "charges") + " SELECT s.id, s.charge_id FROM samples s WHERE s.charge_id IN (SELECT id FROM charges WHERE end_ms IS NOT NULL)")
def samples_of_closed_charges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.of_car(A.samples(spark, sf_dir), A.charges(spark, sf_dir).where("end_ms is not null"), "charge_id").select("id", "charge_id")


@query(with_frames("positions", "geofences") + ", cache AS (SELECT round(latitude * 100) AS a, round(longitude * 100) AS b, min(id) AS osm_id FROM geofences WHERE id % 2 = 0 GROUP BY ALL) SELECT p.id, c.osm_id FROM positions p LEFT JOIN cache c ON c.a = round(p.latitude * 100) AND c.b = round(p.longitude * 100)")
def cached_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache = A.geofences(spark, sf_dir).where("id % 2 = 0").select("latitude", "longitude", F.lit("way").alias("osm_type"), F.col("id").alias("osm_id"), F.col("name").alias("display_name"))
    return geo.cached_addresses(A.positions(spark, sf_dir).select("id", "latitude", "longitude"), cache, digits=2).select("id", "osm_id")


EVIDENCE = ("drive odometer", "state text")


def _evidence(kind: str, frame: str, value: str) -> str:
    """Common tables of the root of a kind's tree, named after its frame."""
    steps = " + ".join(f"CAST(count(*) > {64 * 16**k} AS INT)" for k in range(1, 8))
    return f"""{frame}_rows AS (SELECT {value[0]} AS id, sha256(concat_ws(chr(31), '{kind}', {value[0]}, coalesce(CAST({value[1]} AS VARCHAR), 'null'))) AS digest FROM {frame}), {frame}_depth AS (SELECT 1 + {steps} AS depth FROM {frame}_rows),
  {frame}_tree AS (SELECT depth AS level, left(sha256(CAST(id AS VARCHAR)), depth) AS prefix, count(*) AS n, sha256(string_agg(id || ':' || digest, chr(10) ORDER BY id || ':' || digest)) AS h FROM {frame}_rows, {frame}_depth GROUP BY ALL
    UNION ALL SELECT level - 1, left(prefix, level - 1), CAST(sum(n) AS BIGINT), sha256(string_agg(prefix || ':' || h, chr(10) ORDER BY prefix || ':' || h)) FROM {frame}_tree WHERE level > 0 GROUP BY level, left(prefix, level - 1))"""


@query(with_frames("positions", "observations").replace("WITH", "WITH RECURSIVE", 1) + ", " + _evidence(EVIDENCE[0], "positions", ("id", "CAST(odometer * 1000 AS BIGINT)")) + ", " + _evidence(EVIDENCE[1], "observations", ("observation_id", "phase")) + """
  SELECT CAST(sum(n) AS BIGINT) AS n, (SELECT count(*) = count(DISTINCT id) FROM positions_rows) AND (SELECT count(*) = count(DISTINCT id) FROM observations_rows) AS increasing, sha256(string_agg(kind || ':' || n || ':' || h, chr(10) ORDER BY kind)) AS fingerprint FROM (SELECT 'drive odometer' AS kind, * FROM positions_tree WHERE level = 0 UNION ALL SELECT 'state text', * FROM observations_tree WHERE level = 0)""")
def evidence_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, o = A.positions(spark, sf_dir), A.observations(spark, sf_dir)
    odometer, text = p.select("id", (F.col("odometer") * 1000).cast("bigint").alias("value")), o.select(F.col("observation_id").alias("id"), F.col("phase").alias("value"))
    return reconcile.evidence_fingerprint(dict(zip(EVIDENCE, (odometer, text), strict=True)))


@query("WITH r AS (SELECT l_orderkey AS id, l_linenumber AS n, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS place FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) SELECT id, CAST(n AS BIGINT) AS ordinal FROM r WHERE place <> n - 1")
def ordinal_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").cast("bigint").alias("ordinal"), (F.col("l_linenumber") - 1).cast("bigint").alias("at")).distinct()
    return reconcile.ordinals(rows, "id", "ordinal", "at").select("id", "ordinal")


@query(with_frames("positions", "drives") + " SELECT DISTINCT p.date_ms // 86400000 AS fragment, d.id, d.start_ms FROM positions p JOIN drives d ON d.id = p.drive_id")
def fragments_with_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    children = A.positions(spark, sf_dir).select(F.floor(F.col("date_ms") / 86_400_000).alias("fragment"), "drive_id")
    children = folds.spread(children, A.table(spark, sf_dir, "lineitem").count(), "drive_id", per=250_000)
    return cdc.fragment_with_parents(children, A.drives(spark, sf_dir), "drive_id").select("fragment", "id", "start_ms")


@query(with_frames("drives", "positions") + " SELECT 'child' AS entity, p.id, r.rule FROM positions p LEFT JOIN (SELECT id FROM drives WHERE end_ms IS NULL) d ON d.id = p.drive_id, (VALUES ('parent is open'), ('same car')) r(rule) WHERE d.id IS NULL")
def open_session_breaches(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = A.positions(spark, sf_dir)
    return quality.open_session_consistency(A.drives(spark, sf_dir).where("end_ms is null"), p, p.limit(0).withColumn("drive_id", F.lit(None).cast("bigint")), "drive_id")


@query(with_frames("cars", "geofences") + " SELECT 'billing_type domain' AS rule, count(*) FILTER (id % 10 = 0) AS n FROM geofences UNION ALL SELECT 'one settings row', abs(count(*) - 1) FROM cars WHERE id < 2 UNION ALL SELECT 'car has settings', count(*) FROM cars WHERE settings_id % 4 = 0")
def relationship_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    cars, fences = A.cars(spark, sf_dir), A.geofences(spark, sf_dir)
    labels = {"billing_type": fences.select(F.when(F.col("id") % 10 == 0, "other").otherwise(F.col("billing_type")).alias("b"))}
    return quality.relationship_checks(cars, cars.where("id < 2"), cars.where("settings_id % 4 <> 0").select(F.col("settings_id").alias("id")), labels)


@query(with_frames("drives") + " SELECT 'drive' AS entity, count(*) AS source_rows, count(*) FILTER (id % 4 <> 0) AS published_rows, false AS agree FROM drives UNION ALL SELECT 'charge', count(*), count(*), true FROM drives")
def cross_layer_receipt(spark: SparkSession, sf_dir: str) -> DataFrame:
    digested = [i.withColumn("digest", F.sha2(F.concat_ws(":", "entity", "id", "car_id"), 256)) for i in _inventories(spark, sf_dir)]
    return quality.cross_layer_receipt(*[reconcile.dataset_fingerprint(d, ["entity"]) for d in digested])


@query(with_frames("positions", "geofences") + """ SELECT 'geofence' AS entity, id, 'name width' AS rule FROM geofences WHERE length(name) > 17 UNION ALL SELECT 'geofence', id, 'cost_per_unit bound' FROM geofences WHERE cost_per_unit > 0.3""")
def physical_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.validate_physical("geofence", A.geofences(spark, sf_dir), {"name": 17}, {"cost_per_unit": 0.3}, [])


@query(with_frames("positions") + """ SELECT id, round(odometer * 1.609344 * 100) / 100 AS km, CAST(round(speed / 0.62137119223733) AS BIGINT) AS kmh, CASE WHEN date_ms - 946684800000 < 0 THEN date_ms WHEN date_ms % 2 = 0 THEN date_ms - 1000 ELSE date_ms END AS ts,
  latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180 AS valid FROM positions""")
def position_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = F.col("date_ms")
    candidate = F.when(ms % 2 == 0, ms - 1000).otherwise(ms + 3_600_000)
    return A.positions(spark, sf_dir).select("id", S.miles_to_km("odometer").alias("km"), S.mph_to_kmh("speed").alias("kmh"), S.plausible_timestamp(ms, candidate).alias("ts"), S.valid_coordinates(F.col("latitude"), F.col("longitude")).alias("valid"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 9 = 0 THEN 9223372036854775807 ELSE epoch_us(o_orderdate) - 946684800000000 + 500000 END AS us, CAST(round(o_totalprice * 100) AS BIGINT) * 100 AS scaled,
  CASE WHEN o_orderkey % 2 = 0 AND o_orderkey > 0 THEN 'eid:' || o_orderkey ELSE 'vin:' || o_orderpriority END AS vehicle_key, o_orderpriority AS cleaned, o_orderkey % 12 > 5 AS newer FROM orders""")
def text_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, key = A.table(spark, sf_dir, "orders"), F.col("o_orderkey")
    text = F.when(key % 9 == 0, "infinity").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss'.5'"))
    exact = F.round("o_totalprice", 2).cast("decimal(20,2)").cast("string")
    return rows.select(key.alias("id"), S.pg_us(text).alias("us"), S.fixed_numeric(exact, 4)[0].alias("scaled"), S.vehicle_key(F.when(key % 2 == 0, key), F.concat(F.lit(" "), "o_orderpriority")).alias("vehicle_key"), S.clean_text(F.concat(F.lit("  "), "o_orderpriority")).alias("cleaned"), S.firmware_newer(F.concat(F.lit("2024."), (key % 12).cast("string"), F.lit(" x")), F.lit("2024.5")).alias("newer"))


@query("SELECT event_id, CASE event_type WHEN 'signup' THEN 'asleep' WHEN 'error' THEN 'offline' ELSE CASE WHEN event_id % 11 = 0 THEN 'updating' WHEN event_type = 'purchase' THEN 'charging' WHEN event_id % 7 = 0 OR event_type = 'click' THEN 'driving' ELSE 'online' END END AS phase FROM events")
def classify_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, n = F.col("event_type"), F.col("event_id")
    state = F.when(kind == "signup", "Asleep").when(kind == "error", "offline").otherwise("online")
    phase = intervals.classify_phase(state, F.when(n % 11 == 0, "installing"), F.when(kind == "purchase", "Starting"), F.when(n % 7 == 0, "R"), F.when(kind == "click", 5))
    return A.table(spark, sf_dir, "events").select("event_id", phase.alias("phase"))
