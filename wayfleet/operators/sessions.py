"""Drive and charge sessions of observations, thinning and monotonic clocks.

A session is a run of rows between boundaries that windows find. The two true folds (thinning and clocks) walk sorted
rows, in stretches that start where a window shows that the result can't depend on what came before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayfleet.functions.scalars import is_terminal_charge, valid_coordinates
from wayfleet.operators.folds import walked
from wayfleet.operators.intervals import before, by_car, so_far

OFFLINE_MS, THIN_MS = 15 * 60_000, 5 * 60_000


def _numbered(rows: DataFrame, kind: str) -> DataFrame:
    """Session numbers of rows whose kind is 'in', with a 'close' row right behind a session as its endpoint."""
    rows = rows.where(F.col(kind).isNotNull()).withColumn("_before", F.lag(kind).over(by_car()))
    start = (F.col(kind) == "in") & ~F.col("_before").eqNullSafe(F.lit("in"))
    rows = rows.withColumn("session", F.sum(start.cast("bigint")).over(so_far()))
    return rows.where((F.col(kind) == "in") | (F.col("_before") == "in")).drop("_before")


def _drive_kind(obs: DataFrame, offline_ms: int) -> tuple[Column, Column]:
    """'in' and 'close' rows of drives; and whether a row is parked."""
    charges = F.coalesce(_charges(), F.lit(False)) if "charging_state" in obs.columns else F.lit(False)
    moving = F.coalesce(F.col("moving"), F.col("phase") == "driving") if "moving" in obs.columns else F.col("phase") == "driving"
    time = F.coalesce("drive_ts", "at_ms") if "drive_ts" in obs.columns else F.col("at_ms")
    parked = F.col("phase").isin("online", "charging") & _drive_data(obs) & ~moving
    inside = moving & ~charges & ~F.col("phase").isin("asleep", "updating", "offline")
    last = F.last(F.when(inside, time), ignorenulls=True).over(before())
    return F.when(inside, "in").when(F.col("phase").isin("asleep", "updating") | parked, "close").when((F.col("phase") == "offline") & (time - last >= offline_ms), "close"), parked


def drive_sessions(obs: DataFrame, offline_ms: int = OFFLINE_MS) -> DataFrame:
    """obs (phase; odometer, charging_state, moving, drive_data and drive_ts if there are such) -> rows of drives with session and endpoint.

    A drive opens on a moving row (moving: a driving shift or a speed over 0; driving rows without the column) unless it
    charges. It closes on asleep or updating, on a row whose drive time (drive_ts, else at_ms) is offline_ms or more behind the
    last moving row while offline, and on a parked (online or charging, not moving) row that carries drive data (drive_data; all
    do without the column); one with an odometer is kept as endpoint. Earlier offline rows, rows without drive data and
    unknown phases are passed over.
    """
    kind, parked = _drive_kind(obs, offline_ms)
    rows = _numbered(obs.withColumn("_kind", kind), "_kind").withColumn("endpoint", F.col("_kind") == "close")
    if "odometer" in obs.columns:
        parked = parked & F.col("odometer").isNotNull()
    return rows.where(~F.col("endpoint") | parked).drop("_kind")


def _drive_data(obs: DataFrame) -> Column:
    return F.coalesce(F.col("drive_data"), F.lit(False)) if "drive_data" in obs.columns else F.lit(True)


def _charges() -> Column:
    return F.lower(F.col("charging_state")).isin("starting", "charging")


def _charge_kind() -> Column:
    state = F.lower(F.col("charging_state"))
    return (
        F.when(F.col("phase").isin("asleep", "updating"), "close")
        .when(_charges(), "in")
        .when(is_terminal_charge("charging_state"), "close")
        .when(state.isNotNull() & (F.col("phase") == "online"), "close")
    )


def charge_sessions(obs: DataFrame) -> DataFrame:
    """obs (phase, charging_state) -> rows of charges with session, endpoint and sample.

    A charge opens on starting or charging. It closes on a terminal state, on asleep or updating, and on
    another explicit state while online; a missing state never closes it, nor does offline. The row that closes it gives
    its end (endpoint); it is a sample only if its state is terminal.
    """
    rows = _numbered(obs.withColumn("_kind", _charge_kind()), "_kind").withColumn("endpoint", F.col("_kind") == "close")
    return rows.withColumn("sample", ~F.col("endpoint") | F.coalesce(is_terminal_charge("charging_state"), F.lit(False))).drop("_kind")


def with_open(obs: DataFrame, offline_ms: int = OFFLINE_MS) -> DataFrame:
    """obs with drive_open and charge_open: whether a session is open behind the row."""
    rows = obs.withColumns({"_drive": _drive_kind(obs, offline_ms)[0], "_charge": _charge_kind()})
    is_open = lambda c: F.coalesce(F.last(c, ignorenulls=True).over(so_far()) == "in", F.lit(False))
    return rows.withColumns({"drive_open": is_open("_drive"), "charge_open": is_open("_charge")}).drop("_drive", "_charge")


def stationary_positions(obs: DataFrame, thin_ms: int = THIN_MS) -> DataFrame:
    """(car_id, observation_id, phase, at_ms): parked rows that enter a phase, and others thin_ms or more after the last kept one.

    Parked are online and charging rows with valid coordinates (all, without such columns) that are newer than the
    car's last row with drive data. The phase before is `effective` where there is such a column.
    """
    prior = F.last(F.when(_drive_data(obs), F.col("at_ms")), ignorenulls=True).over(before())
    entered = ~F.lag("effective" if "effective" in obs.columns else "phase").over(by_car()).eqNullSafe(F.col("phase"))
    rows = obs.withColumns({"_prior": prior, "_enters": entered})
    fits = F.col("phase").isin("online", "charging") & (F.col("_prior").isNull() | (F.col("at_ms") > F.col("_prior")))
    if {"latitude", "longitude"} <= set(obs.columns):
        fits = fits & valid_coordinates(F.col("latitude"), F.col("longitude"))
    rows = rows.where(fits).select("car_id", "observation_id", "phase", "at_ms", (F.col("_enters") | F.col("_prior").isNull()).alias("_enters"))
    gap = F.col("at_ms") - F.lag("at_ms").over(by_car())
    rows = rows.withColumn("_stretch", F.sum((F.col("_enters") | gap.isNull() | (gap >= thin_ms)).cast("bigint")).over(so_far()))

    def step(last: tuple | None, row: tuple) -> tuple[tuple, bool]:
        keep = last is None or row[0] - last[0] >= thin_ms
        return ((row[0],) if keep else last), keep

    kept = walked(rows, ["car_id", "_stretch"], ["at_ms", "observation_id"], step, ["at_ms"], "_kept", "boolean")
    return kept.where("_kept").select("car_id", "observation_id", "phase", "at_ms")


def monotonic_ts(obs: DataFrame, candidate: str, fallback: str) -> DataFrame:
    """(car_id, observation_id, clock): a clock that never goes back.

    A candidate behind the clock gives way to the fallback, and that, if it is behind too, to the clock; the
    clock moves on only with a candidate (null: none came; one that isn't positive counts as the fallback). The clock
    can't be beyond the largest candidate or fallback so far, so a candidate from there on starts a stretch of its own.
    """
    c = F.when(F.col(candidate) <= 0, F.col(fallback)).otherwise(F.col(candidate)).cast("bigint")
    rows = obs.select("car_id", "observation_id", "at_ms", c.alias("_c"), F.col(fallback).cast("bigint").alias("_f"))
    top = F.max(F.when(F.col("_c").isNotNull(), F.greatest("_c", "_f"))).over(before())
    rows = rows.withColumn("_certain", F.col("_c").isNotNull() & (F.col("_c") >= F.coalesce(top, F.col("_c"))))
    rows = rows.withColumn("_stretch", F.sum(F.col("_certain").cast("bigint")).over(so_far()))

    def step(clock: tuple | None, row: tuple) -> tuple[tuple | None, int | None]:
        own, other = row
        shown = own if own is not None else other
        if clock is not None and (own is None or own < clock[0]):
            shown = other if other is not None and other >= clock[0] else clock[0]
        return ((shown,) if own is not None else clock), shown

    return walked(rows, ["car_id", "_stretch"], ["at_ms", "observation_id"], step, ["_c", "_f"], "clock", "long").select("car_id", "observation_id", "clock")


def assign_ids(rows: DataFrame, bases: DataFrame, *order: str) -> DataFrame:
    """rows with id: consecutive per car in this order, from the car's base on (1 without one)."""
    at = F.row_number().over(W.partitionBy("car_id").orderBy(*order))
    return rows.withColumn("_at", at).join(bases.select("car_id", F.col("next_id")), "car_id", "left").withColumn("id", F.coalesce("next_id", F.lit(1)) + F.col("_at") - 1).drop("_at", "next_id")
