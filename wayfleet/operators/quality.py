"""Data-quality rules as violations: (entity, id, rule)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayfleet.functions.scalars import INFINITE_FUTURE, INFINITE_PAST, valid_coordinates
from wayfleet.operators.reconcile import union

# Closed label domains, in order.
DOMAINS = {
    "billing_type": ["per_kwh", "per_minute"],
    "preferred_range": ["ideal", "rated"],
    "state": ["online", "offline", "asleep"],
    "unit_of_length": ["km", "mi"],
    "unit_of_pressure": ["bar", "psi"],
    "unit_of_temperature": ["C", "F"],
}


def positive(col: str = "id") -> Column:
    return F.coalesce(F.col(col) > 0, F.lit(False))


def interval(start: str = "start_ms", end: str = "end_ms") -> Column:
    return F.col(end).isNull() | (F.col(end) >= F.col(start))


def finite(col: str) -> Column:
    return F.col(col).isNull() | ~(F.isnan(col) | (F.abs(F.col(col)) == float("inf")))


def non_negative(col: str) -> Column:
    return F.col(col).isNull() | (F.col(col) >= 0)


def soc(col: str) -> Column:
    return F.col(col).isNull() | F.col(col).between(0, 100)


def coordinates(lat: str = "latitude", lon: str = "longitude") -> Column:
    both_null = F.col(lat).isNull() & F.col(lon).isNull()
    return both_null | valid_coordinates(F.col(lat), F.col(lon), no_origin=True)


def width(col: str, most: int) -> Column:
    return F.col(col).isNull() | (F.length(col) <= most)


def domain(col: str, name: str) -> Column:
    return F.col(col).isNull() | F.col(col).isin(DOMAINS[name])


def second_aligned(col: str) -> Column:
    """Microseconds on a whole second, or an infinity."""
    return F.col(col).isNull() | F.col(col).isin(INFINITE_PAST, INFINITE_FUTURE) | (F.pmod(F.col(col), F.lit(1_000_000)) == 0)


# Columns of an entity that may not be negative, and those that must be finite.
NON_NEGATIVE = {
    "car": ["efficiency_wh_per_km"],
    "drive": ["distance_km", "efficiency", "start_rated_km", "end_rated_km"],
    "position": ["ideal_km", "rated_km"],
    "charge": ["energy_added", "energy_used", "max_power", "start_rated_km", "end_rated_km"],
    "charge_sample": ["power", "voltage", "current", "ideal_km", "rated_km"],
}
FINITE = {"drive": ["outside_temp"], "position": ["inside_temp"], "charge": ["cost", "cost_per_unit", "session_fee", "outside_temp"], "charge_sample": ["outside_temp"]}
LEVELS = {"drive": ["start_soc", "end_soc"], "position": ["usable_battery_level"], "charge": ["start_battery_level", "end_battery_level"], "charge_sample": ["usable_battery_level"]}


def field_rules(entity: str, rows: DataFrame) -> dict[str, Column]:
    """The rules above for the columns that rows have; a pair of coordinates for each end that has one."""
    rules = [(non_negative, NON_NEGATIVE), (finite, FINITE), (soc, LEVELS)]
    found = {c: rule(c) for rule, named in rules for c in named.get(entity, []) if c in rows.columns}
    ends = [e for e in ("start", "end") if f"{e}_latitude" in rows.columns and entity in ("drive", "charge")]
    return found | {f"{e} coordinates": coordinates(f"{e}_latitude", f"{e}_longitude") for e in ends}


def text(col: str) -> Column:
    return F.trim(F.coalesce(F.col(col), F.lit(""))) != ""


def violations(entity: str, rows: DataFrame, rules: dict[str, Column], parents: tuple[DataFrame, str, str] | None = None) -> DataFrame:
    """A row per broken rule and row, in one pass over the rows. parents: (frame, key, rule) of the parent that a row's key must find, met by ids and broken rules alone."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    if parents:
        frame, key, rule = parents
        rows = rows.select("id", key, broken.alias("_broken")).join(frame.select(F.col("id").alias("_parent")).distinct(), F.col(key) == F.col("_parent"), "left")
        broken = F.concat("_broken", F.when(F.col(key).isNotNull() & F.col("_parent").isNull(), F.array(F.lit(rule))).otherwise(F.array().cast("array<string>")))
    return rows.select(F.lit(entity).alias("entity"), F.col("id").cast("bigint").alias("id"), F.explode(broken).alias("rule"))


def repeated(entity: str, rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.col("id").cast("bigint").alias("id")).agg(F.count("*").alias("n")).where("n > 1").select(F.lit(entity).alias("entity"), "id", F.lit("unique id").alias("rule"))


def orphans(entity: str, rows: DataFrame, parents: DataFrame, key: str, name: str) -> DataFrame:
    lost = rows.where(F.col(key).isNotNull()).join(parents.select(F.col("id").alias(key)), key, "left_anti")
    return lost.select(F.lit(entity).alias("entity"), F.col("id").cast("bigint").alias("id"), F.lit(name).alias("rule"))


def validate_snapshot(drives: DataFrame, positions: DataFrame, charges: DataFrame, samples: DataFrame, cars: DataFrame | None = None, states: DataFrame | None = None, updates: DataFrame | None = None) -> DataFrame:
    """All field rules of the entities, unique ids, and children whose parent is missing; with cars, states and updates where they are given."""
    frames = {"drive": drives, "position": positions, "charge": charges, "charge_sample": samples}
    rules = {
        "drive": {"interval": interval(), "completed": F.col("end_ms").isNotNull(), "positive start": positive("start_ms")},
        "position": {"positive time": positive("date_ms"), "coordinates": coordinates(), "soc": soc("battery_level"), "odometer": non_negative("odometer"), "finite temperature": finite("outside_temp"), "speed": non_negative("speed")},
        "charge": {"interval": interval(), "positive start": positive("start_ms")},
        "charge_sample": {"positive time": positive("date_ms"), "soc": soc("battery_level"), "energy": non_negative("energy")},
        "car": {},
    }
    parents = {"position": (drives, "drive_id", "drive exists"), "charge_sample": (charges, "charge_id", "charge exists")}
    out = []
    if cars is not None:
        frames["car"] = cars
        rules["car"] = {"name": text("name"), "model": text("model")}
        out += [orphans(n, f, cars, "car_id", "car exists") for n, f in list(frames.items()) if n != "car"]
    for name, rows in frames.items():
        out += [violations(name, rows, {"positive id": positive()} | rules[name] | field_rules(name, rows), parents.get(name)), repeated(name, rows)]
    for name, rows, check in (("state", states, validate_states), ("update", updates, validate_updates)):
        if rows is not None:
            out += [check(rows), repeated(name, rows)]
    return union(out)


def validate_states(states: DataFrame) -> DataFrame:
    """Domain, interval, and one open state per car at most."""
    many = states.where("end_ms is null").withColumn("_n", F.count("*").over(W.partitionBy("car_id"))).where("_n > 1")
    rules = violations("state", states, {"positive id": positive(), "state domain": F.col("state").isNotNull() & domain("state", "state"), "interval": interval()})
    return rules.unionByName(many.select(F.lit("state").alias("entity"), F.col("id").cast("bigint").alias("id"), F.lit("one open state").alias("rule")))


def validate_updates(updates: DataFrame) -> DataFrame:
    return violations("update", updates, {"positive id": positive(), "interval": interval(), "version": F.trim(F.coalesce("version", F.lit(""))) != ""})


def open_session_consistency(parent: DataFrame, children: DataFrame, standalone: DataFrame, key: str) -> DataFrame:
    """Open parents lack an end, their children name them and have their car, standalone rows name no parent."""
    own = children.join(parent.select(F.col("id").alias(key), F.col("car_id").alias("_car")), key, "left")
    return union([
        violations("parent", parent, {"open": F.col("end_ms").isNull()}),
        violations("child", own, {"parent is open": F.col("_car").isNotNull(), "same car": F.col("_car") == F.col("car_id")}),
        violations("standalone", standalone, {"no parent": F.col(key).isNull()}),
    ])


def relationship_checks(cars: DataFrame, settings: DataFrame, car_settings: DataFrame, labels: dict[str, DataFrame]) -> DataFrame:
    """(rule, n): labels outside their domains (a frame of one column for each), other than one settings row, cars without settings."""
    out = [f.where(~F.col(f.columns[0]).isin(DOMAINS[name])).agg(F.count("*").alias("n")).select(F.lit(f"{name} domain").alias("rule"), "n") for name, f in labels.items()]
    out.append(settings.agg(F.abs(F.count("*") - 1).alias("n")).select(F.lit("one settings row").alias("rule"), "n"))
    out.append(cars.join(car_settings.select(F.col("id").alias("settings_id")), "settings_id", "left_anti").agg(F.count("*").alias("n")).select(F.lit("car has settings").alias("rule"), "n"))
    return union(out)


def cross_layer_receipt(source: DataFrame, published: DataFrame) -> DataFrame:
    """(entity, source_rows, published_rows, agree) of two (entity, n, fingerprint) frames."""
    a, b = source.toDF("entity", "source_rows", "_a"), published.toDF("entity", "published_rows", "_b")
    agree = F.col("source_rows").eqNullSafe(F.col("published_rows")) & F.col("_a").eqNullSafe(F.col("_b"))
    return a.join(b, "entity", "full").select("entity", F.coalesce("source_rows", F.lit(0)).alias("source_rows"), F.coalesce("published_rows", F.lit(0)).alias("published_rows"), agree.alias("agree"))


def no_unexplained_rows(reconciled: DataFrame) -> DataFrame:
    return reconciled.where("unexplained <> 0")


def validate_physical(entity: str, rows: DataFrame, widths: dict[str, int], decimals: dict[str, float], seconds: list[str]) -> DataFrame:
    """Text widths, decimal bounds, whole-second timestamps, unique (signed) ids."""
    rules = {f"{c} width": width(c, n) for c, n in widths.items()} | {f"{c} bound": F.col(c).isNull() | (F.abs(F.col(c)) <= n) for c, n in decimals.items()} | {f"{c} second": second_aligned(c) for c in seconds}
    return violations(entity, rows, rules).unionByName(repeated(entity, rows))
