"""Scalar functions of the telemetry domain, all built from Spark column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KM_PER_MILE, MILES_PER_KM = 1.609344, 0.62137119223733
# The two Earth radii in use, in metres.
RADIUS_MEAN, RADIUS_EQUATOR = 6_371_000.0, 6_378_168.0
TERMINAL = ["complete", "disconnected", "stopped", "nopower", "unplugged"]
MAX_INTEGER = float(1 << 62)


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def scaled_round(x: Column, digits: int) -> Column:
    """Round half away from zero as scale, round, unscale."""
    return F.round(x * F.lit(10.0**digits)) / F.lit(10.0**digits)


# JSON fields ------------------------------------------------------------------------------------


def json_field(payload: Column | str, path: str) -> Column:
    """The field as a variant; null where the payload doesn't parse or lacks it."""
    return F.try_variant_get(F.try_parse_json(_c(payload)), path, "variant")


def _kind(v: Column) -> Column:
    return F.when(v.isNotNull(), F.schema_of_variant(v))


def as_float(v: Column) -> Column:
    """A JSON number as double; strings and booleans are null."""
    return F.when(_kind(v).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(v, "$", "double"))


def as_int(v: Column) -> Column:
    """A variant's number rounded half away from zero; strings are null."""
    x = as_float(v)
    return F.when(_kind(v) == "BIGINT", F.try_variant_get(v, "$", "bigint")).when(F.abs(x) < MAX_INTEGER, F.round(x).cast("bigint"))


def as_bool(v: Column) -> Column:
    return F.when(_kind(v) == "BOOLEAN", F.try_variant_get(v, "$", "boolean"))


def as_text(v: Column) -> Column:
    return nonblank(F.when(_kind(v) == "STRING", F.try_variant_get(v, "$", "string")))


def as_timestamp(v: Column) -> Column:
    """Milliseconds from an integer, a string that reads as one, or a whole float; positive ones only."""
    x = as_float(v)
    whole = F.when((x == F.floor(x)) & (F.abs(x) < MAX_INTEGER), x.cast("bigint"))
    text = F.trim(F.when(_kind(v) == "STRING", F.try_variant_get(v, "$", "string")))
    got = F.coalesce(F.when(_kind(v) == "BIGINT", F.try_variant_get(v, "$", "bigint")), whole, F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("bigint")))
    return F.when(got > 0, got)


def float_field(payload: Column | str, path: str) -> Column:
    return as_float(json_field(payload, path))


def int_field(payload: Column | str, path: str) -> Column:
    return as_int(json_field(payload, path))


def bool_field(payload: Column | str, path: str) -> Column:
    return as_bool(json_field(payload, path))


def text_field(payload: Column | str, path: str) -> Column:
    return as_text(json_field(payload, path))


def timestamp_field(payload: Column | str, path: str) -> Column:
    return as_timestamp(json_field(payload, path))


# Text -------------------------------------------------------------------------------------------


def nonblank(x: Column | str) -> Column:
    """Trimmed; null if nothing is left."""
    t = F.trim(_c(x))
    return F.when(t != "", t)


def first_nonblank(*xs: Column | str) -> Column:
    return F.coalesce(*[nonblank(x) for x in xs])


def clean_text(x: Column | str, most: int = 512) -> Column:
    """Trimmed text without control characters, of `most` characters at most, else null."""
    t = nonblank(x)
    return F.when((F.length(t) <= most) & ~t.rlike(r"\p{Cntrl}"), t)


def firmware_key(version: Column | str) -> Column:
    """A version as a list of numbers that compares as firmware does."""
    first = F.split(F.trim(_c(version)), r"\s+")[0]
    return F.transform(F.split(first, r"\."), lambda p: F.coalesce(p.try_cast("bigint"), F.lit(0).cast("bigint")))


def firmware_newer(a: Column | str, b: Column | str) -> Column:
    return firmware_key(a) > firmware_key(b)


def normalize_model(model: Column | str) -> Column:
    """S, 3, X or Y from names that start with the model and from two code names; others trimmed."""
    t = F.trim(_c(model))
    compact = F.replace(F.lower(t), F.lit(" "), F.lit(""))
    out = F.when(compact.startswith("models") | (compact == "lychee"), "S").when(compact.startswith("model3"), "3")
    return out.when(compact.startswith("modelx") | (compact == "tamarind"), "X").when(compact.startswith("modely"), "Y").otherwise(t)


def normalize_trim(x: Column | str) -> Column:
    return F.upper(F.trim(_c(x)))


# Marketing names by model, trim and, where there is one, the raw model code.
MARKETING = [
    ("S", "100D", "lychee", "LR"),
    ("S", "P100D", "lychee", "Plaid"),
    ("S", "100D", "models2", "LR+"),
    ("3", "P74D", None, "LR AWD Performance"),
    ("3", "74D", None, "LR AWD"),
    ("3", "74", None, "LR"),
    ("3", "62", None, "MR"),
    ("3", "50", None, "SR+"),
    ("X", "100D", "tamarind", "LR"),
    ("X", "P100D", "tamarind", "Plaid"),
    ("Y", "P74D", None, "LR AWD Performance"),
    ("Y", "74D", None, "LR AWD"),
    ("Y", "74", None, "LR"),
    ("Y", "50", None, "SR"),
]


def marketing_name(model: Column | str, trim: Column | str, raw: Column | str) -> Column:
    """The marketing name of a model (in any form), trim and raw model code; null if there is none."""
    key = F.concat_ws("|", normalize_model(model), normalize_trim(trim))
    any_code = F.create_map(*[F.lit(x) for m, t, code, name in MARKETING if code is None for x in (f"{m}|{t}", name)])
    by_code = F.create_map(*[F.lit(x) for m, t, code, name in MARKETING if code for x in (f"{m}|{t}|{code}", name)])
    return F.coalesce(by_code[F.concat_ws("|", key, F.lower(_c(raw)))], any_code[key])


def normalize_efficiency(x: Column | str) -> Column:
    """Wh/km: values under 1 are kWh/km; a negative or non-finite one stops the job."""
    v = _c(x)
    bad = F.isnan(v) | (v < 0) | (F.abs(v) == float("inf"))
    return F.when(bad, F.raise_error(F.lit("an efficiency is negative or not finite"))).when((v > 0) & (v < 1), v * 1000).otherwise(v)


def vehicle_key(eid: Column | str, vin: Column | str) -> Column:
    """eid:n for a positive number, else vin:x; a vehicle with neither stops the job."""
    by_vin = F.when(nonblank(vin).isNotNull(), F.concat(F.lit("vin:"), nonblank(vin)))
    return F.when(_c(eid) > 0, F.concat(F.lit("eid:"), _c(eid).cast("string"))).when(by_vin.isNotNull(), by_vin).otherwise(F.raise_error(F.lit("a vehicle has neither a number nor a VIN")))


# Units, time, numbers ---------------------------------------------------------------------------


def miles_to_km(x: Column | str, digits: int = 2) -> Column:
    return scaled_round(_c(x) * F.lit(KM_PER_MILE), digits)


def mph_to_kmh(x: Column | str) -> Column:
    return F.round(_c(x) / F.lit(MILES_PER_KM)).cast("bigint")


def epoch_ms(ts: Column | str) -> Column:
    """UTC milliseconds of a timestamp without zone, truncated towards 1970."""
    return F.timestamp_diff("MILLISECOND", F.lit("1970-01-01").cast("timestamp_ntz"), _c(ts))


INFINITE_PAST, INFINITE_FUTURE = -(1 << 63), (1 << 63) - 1


def pg_us(text: Column | str) -> Column:
    """Microseconds since 2000-01-01 of a text timestamp (1 to 6 digits of a second); infinities are the long limits; other text is null."""
    t = _c(text)
    shape = r"^\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01]) ([01]\d|2[0-3]):[0-5]\d:[0-5]\d(\.\d{1,6})?$"
    ts = F.when(t.rlike(shape), t).try_cast("timestamp_ntz")
    us = F.timestamp_diff("MICROSECOND", F.lit("2000-01-01").cast("timestamp_ntz"), ts)
    return F.when(t == "infinity", F.lit(INFINITE_FUTURE)).when(t == "-infinity", F.lit(INFINITE_PAST)).otherwise(us)


def fixed_numeric(x: Column | str, scale: int, digits: int = 18) -> tuple[Column, Column]:
    """(scaled long, is NaN) of a decimal text; null where it isn't a number within the digits."""
    t = F.trim(_c(x).cast("string"))
    nan = F.lower(t) == "nan"
    scaled = F.when(~nan, (t.try_cast(f"decimal({digits},{scale})") * F.lit(10**scale)).cast(f"decimal({digits + 2},0)").cast("bigint"))
    return scaled, nan


def plausible_timestamp(received: Column, *candidates: Column) -> Column:
    """The first candidate from 2000 on and at most five minutes after receipt, else the receipt (ms)."""
    fits = [F.when((c >= 946_684_800_000) & (c <= received + 300_000), c) for c in candidates]
    return F.coalesce(*fits, received)


# Geography --------------------------------------------------------------------------------------


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = RADIUS_MEAN, form: str = "asin") -> Column:
    """Great-circle metres; form 'asin', or 'atan2' with its argument held in [0, 1]."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    if form == "asin":
        return F.asin(F.sqrt(a)) * (2 * radius)
    a = F.greatest(F.lit(0.0), F.least(F.lit(1.0), a))
    return F.atan2(F.sqrt(a), F.sqrt(1 - a)) * (2 * radius)


def valid_coordinates(lat: Column, lon: Column, no_origin: bool = False) -> Column:
    ok = lat.isNotNull() & lon.isNotNull() & lat.between(-90, 90) & lon.between(-180, 180)
    return F.coalesce(ok & ~((lat == 0) & (lon == 0)) if no_origin else ok, F.lit(False))


def tile_name(lat: Column, lon: Column) -> Column:
    """The one-degree tile of a point, like N47E008."""
    y, x = F.floor(lat).cast("int"), F.floor(lon).cast("int")
    ns, ew = F.when(y < 0, "S").otherwise("N"), F.when(x < 0, "W").otherwise("E")
    return F.concat(ns, F.lpad(F.abs(y).cast("string"), 2, "0"), ew, F.lpad(F.abs(x).cast("string"), 3, "0"))


def tile_cell(lat: Column, lon: Column, side: Column) -> Column:
    """The index of a point's cell in its tile's rows, from the north-west corner."""
    row = ((F.floor(lat) + 1 - lat) * (side - 1)).cast("int")
    col = ((lon - F.floor(lon)) * (side - 1)).cast("int")
    return row * side + col


# Digests and charging ---------------------------------------------------------------------------


def row_digest(entity: Column, key: Column, car: Column, *fields: str) -> Column:
    """SHA-256 of a row: its entity, id, car, and the length and text of its fields as JSON in order of name, nulls kept."""
    body = F.to_json(F.struct(*[F.col(f) for f in sorted(fields)]), {"ignoreNullFields": "false"})
    return F.sha2(F.concat_ws("\x1f", F.lit("row-v1"), entity, key.cast("string"), car.cast("string"), F.length(body).cast("string"), body), 256)


def chain_digest(parent: Column, pack: Column) -> Column:
    return F.sha2(F.concat(F.lit("delta-v2/"), parent, F.lit(":"), pack), 256)


def free_session(free_network: Column, fast_type: Column) -> Column:
    """A car that charges free on the maker's network, at one of its chargers."""
    return F.coalesce(free_network & fast_type.startswith("Tesla"), F.lit(False))


def _finite(x: Column) -> Column:
    """The value, or null where it isn't finite."""
    return F.when(~(F.isnan(x) | (F.abs(x) == float("inf"))), x)


def charge_cost(billing: Column, cost_per_unit: Column, session_fee: Column, added: Column, used: Column, minutes: Column, free: Column) -> Column:
    """0 for a free session; per kWh of the larger energy (a fee alone counts), or per whole minute; null if it can't be told."""
    rate, fee = _finite(cost_per_unit), F.coalesce(_finite(session_fee), F.lit(0.0))
    energy = F.greatest(*[F.when(e >= 0, e) for e in (_finite(added), _finite(used))])
    variable = F.coalesce(rate * energy, F.lit(0.0))
    by_kwh = F.when(energy.isNotNull() & (cost_per_unit.isNotNull() | session_fee.isNotNull()), _finite(variable) + fee)
    by_minute = _finite(F.when(minutes >= 0, minutes * rate + fee))
    return F.when(free, F.lit(0.0)).when(billing == "per_kwh", by_kwh).when(billing == "per_minute", by_minute)


def is_terminal_charge(state: Column | str) -> Column:
    return F.coalesce(F.lower(_c(state)).isin(TERMINAL), F.lit(False))
