"""The lifecycle of vehicles as a stream: observations in; closed intervals, drives, charges, updates and their rows out.

One state row per car holds what is open, as aggregates only; children go to the sink as they come. Rows of a car are
taken in order of observation_id, as the log has them; an id at or below the last one taken is a replay and does
nothing, within a micro-batch and over its borders alike, so a late lower id is left out wherever borders fall. A
clock behind the car's clock is held at it. A broken payload drops what is open, takes the phase of the vehicle's
state, and is reported. 'service' closes everything: a drive at its last position, a charge at that time, and driving or
charging become online. A row without a phase (a gated one) keeps the car's.

A drive is given if it has two positions, odometers at both ends and `LEAST_KM` between them. A charge ends at the row
that closes it, whose energy, charge level and ranges count even where it is no sample; a terminal state is one.

Rows of a car come in no order. If a micro-batch brings more of them than one Arrow batch, they are put aside in a map state by
blocks of observation_id, and folded block by block, so that a worker holds `BLOCK` ids at most; what is put aside goes
before the micro-batch ends. The state store must be RocksDB's; `configure` sets it on a session.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain, groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from wayfleet.operators import cdc
from wayfleet.operators.drives import LEAST_KM
from wayfleet.operators.folds import settled
from wayfleet.sources import commits

OFFLINE_MS, THIN_MS = 15 * 60_000, 5 * 60_000
#: Neighbouring ids that are folded at once where rows had to be put aside.
BLOCK = 1 << 14
#: Measures of a row, and what open sessions keep of them: how, by column.
MEASURES = ("speed", "power", "battery_level", "ideal_km", "rated_km", "outside_temp", "inside_temp")
KEPT = {
    "drive": {"odometer": ("first", "last"), "speed": ("max",), "power": ("max", "min"), "battery_level": ("first", "last"), "ideal_km": ("first", "last"), "rated_km": ("first", "last"), "outside_temp": ("sum", "n"), "inside_temp": ("sum", "n")},
    "charge": {"energy": ("first", "last", "max"), "power": ("max",), "battery_level": ("first", "last"), "ideal_km": ("first", "last"), "rated_km": ("first", "last"), "outside_temp": ("sum", "n")},
}
#: Columns whose closing row counts for a charge even if it is no sample.
AT_CLOSE = ("energy", "battery_level", "ideal_km", "rated_km")
IN = "car_id long, observation_id long, at_ms long, phase string, charging_state string, odometer double, energy double, broken boolean, status string, version string, latitude double, longitude double, drive_data boolean, moving boolean, " + ", ".join(f"{c} double" for c in MEASURES)
FACTS = ("distance_km", "energy_added", "duration_min", "speed_max", "power_max", "power_min", "start_soc", "end_soc", "start_ideal_km", "end_ideal_km", "start_rated_km", "end_rated_km", "outside_temp_avg", "inside_temp_avg")
OUT = "car_id long, entity string, session long, observation_id long, label string, start_ms long, end_ms long, n long, first double, last double, " + ", ".join(f"{c} {'long' if c == 'duration_min' else 'double'}" for c in FACTS)
STATE = "last_id long, clock long, phase string, state string, since long, drive_no long, drive_start long, drive_last long, drive_n long, charge_no long, charge_start long, charge_last long, charge_n long, drive_at long, parked_at long, update_start long, version string, "
STATE += ", ".join(f"{kind}_{c}_{how} double" for kind, columns in KEPT.items() for c, ways in columns.items() for how in ways)
STATE_NAMES = [c.split()[0] for c in STATE.split(", ")]
OUT_NAMES = [c.split()[0] for c in OUT.split(", ")]
#: Columns of OUT by what pandas holds them as; the others are texts.
WHOLE = {"car_id", "session", "observation_id", "start_ms", "end_ms", "n", "duration_min"}
REAL = {"first", "last", *FACTS} - WHOLE
LOGICAL = {"online": "online", "driving": "online", "charging": "online", "updating": "online", "parked": "online", "asleep": "asleep", "offline": "offline"}
TERMINAL = {"complete", "disconnected", "stopped", "nopower", "unplugged"}
NONE = (None,) * len(FACTS)


def configure(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Car:
    """One car's open sessions; step() gives what a row closes."""

    def __init__(self, values: tuple | None, offline_ms: int, thin_ms: int = THIN_MS):
        self.thin_ms = thin_ms
        self.s = dict(zip(STATE_NAMES, values or [None] * len(STATE_NAMES), strict=True))
        self.offline_ms = offline_ms

    def values(self) -> tuple:
        return tuple(self.s[n] for n in STATE_NAMES)

    def kept(self, kind: str, column: str, how: str) -> float | None:
        return self.s[f"{kind}_{column}_{how}"]

    def mean(self, kind: str, column: str) -> float | None:
        n = self.kept(kind, column, "n")
        return self.kept(kind, column, "sum") / n if n else None

    def facts(self, kind: str, **own: float | None) -> tuple:
        got = lambda column, how: self.kept(kind, column, how)
        own |= {"power_max": got("power", "max"), "start_soc": got("battery_level", "first"), "end_soc": got("battery_level", "last"), "outside_temp_avg": self.mean(kind, "outside_temp")}
        own |= {f"{end}_{c}": got(c, how) for c in ("ideal_km", "rated_km") for end, how in (("start", "first"), ("end", "last"))}
        return tuple(own.get(c) for c in FACTS)

    def close_drive(self) -> Iterator[tuple]:
        s = self.s
        first, last = self.kept("drive", "odometer", "first"), self.kept("drive", "odometer", "last")
        if s["drive_start"] is not None and s["drive_n"] >= 2 and first is not None:
            km = round((last - first) * 1e6) / 1e6
            if km >= LEAST_KM:
                minutes = int((s["drive_last"] - s["drive_start"]) / 60_000 + 0.5)
                facts = self.facts("drive", distance_km=km, duration_min=minutes, speed_max=self.kept("drive", "speed", "max"), power_min=self.kept("drive", "power", "min"), inside_temp_avg=self.mean("drive", "inside_temp"))
                yield "drive", s["drive_no"], None, None, s["drive_start"], s["drive_last"], s["drive_n"], first, last, *facts
        s["drive_start"] = None

    def close_charge(self, at: int) -> Iterator[tuple]:
        s = self.s
        if s["charge_start"] is not None:
            first, last, most = (self.kept("charge", "energy", how) for how in ("first", "last", "max"))
            added = None if first is None else (last if last > 0 else most) - first
            facts = self.facts("charge", energy_added=added if added is not None and added >= 0 else None, duration_min=(at - s["charge_start"]) // 60_000)
            yield "charge", s["charge_no"], None, None, s["charge_start"], at, s["charge_n"], first, last, *facts
        s["charge_start"] = None

    def observe(self, kind: str, values: dict, columns: Iterable[str]) -> None:
        s = self.s
        for c in columns:
            v = values.get(c)
            if v is None or (kind == "drive" and c == "ideal_km" and values.get("odometer") is None):
                continue
            for how in KEPT[kind][c]:
                name = f"{kind}_{c}_{how}"
                old = s[name]
                s[name] = (old or 0) + (v if how == "sum" else 1) if how in ("sum", "n") else v if old is None or how == "last" else old if how == "first" else max(old, v) if how == "max" else min(old, v)

    def extend(self, kind: str, at: int, values: dict, child: str, id: int | None) -> Iterator[tuple]:
        s = self.s
        if s[f"{kind}_start"] is None:
            s[f"{kind}_start"], s[f"{kind}_n"] = at, 0
            s |= {f"{kind}_{c}_{how}": None for c, ways in KEPT[kind].items() for how in ways}
            s[f"{kind}_no"] = (s[f"{kind}_no"] or 0) + 1
        s[f"{kind}_last"], s[f"{kind}_n"] = at, s[f"{kind}_n"] + 1
        self.observe(kind, values, KEPT[kind])
        yield child, s[f"{kind}_no"], id, None, at, None, None, values.get("odometer" if kind == "drive" else "energy"), None, *NONE

    def step(self, at: int, phase: str | None, charging: str | None, odometer: float | None, energy: float | None, broken: bool, status: str | None = None, version: str | None = None, latitude: float | None = None, longitude: float | None = None, drive_data: bool | None = True, id: int | None = None, moving: bool | None = None, **measures: float | None) -> Iterator[tuple]:
        """What a row closes and adds: OUT after car_id."""
        s = self.s
        at = at if s["clock"] is None else max(at, s["clock"])
        s["clock"] = at
        if broken:
            s["drive_start"] = s["charge_start"] = None
            s["phase"] = phase
            yield "quarantine", None, id, None, at, at, 1, None, None, *NONE
            return
        if phase == "service":
            yield from self.close_drive()
            yield from self.close_charge(at)
            s["phase"] = "online" if s["phase"] in ("driving", "charging") else s["phase"]
            return
        phase = phase or s["phase"]
        values = {"odometer": odometer, "energy": energy, **measures}
        told = charging.lower() if charging else None
        moving = phase == "driving" if moving is None else moving
        parked = phase in ("online", "charging") and bool(drive_data) and not moving
        if s["drive_start"] is not None and (parked or phase in ("asleep", "updating") or (phase == "offline" and at - s["drive_last"] >= self.offline_ms)):
            if parked and odometer is not None:
                yield from self.extend("drive", at, values, "drive_position", id)
            yield from self.close_drive()
        if s["charge_start"] is not None:
            if told in TERMINAL:
                yield from self.extend("charge", at, values, "charge_sample", id)
                yield from self.close_charge(at)
            elif phase in ("asleep", "updating") or (told not in (None, "starting", "charging") and phase == "online"):
                self.observe("charge", values, AT_CLOSE)
                yield from self.close_charge(at)
        charges = told in ("starting", "charging")
        if moving and not charges and phase not in ("asleep", "updating", "offline"):
            yield from self.extend("drive", at, values, "drive_position", id)
        if charges and phase not in ("asleep", "updating"):
            yield from self.extend("charge", at, values, "charge_sample", id)
        yield from self.park(at, phase, latitude, longitude, id)
        seen = phase
        if phase == "offline" and ((s["phase"] == "charging" and s["charge_start"] is not None) or (s["phase"] == "driving" and s["drive_start"] is not None) or s["phase"] == "updating"):
            phase = s["phase"]
        elif phase == "online" and ((s["phase"] == "charging" and told is None and s["charge_start"] is not None) or (s["phase"] == "driving" and not drive_data and s["drive_start"] is not None)):
            phase = s["phase"]
        s["phase"] = phase
        state = LOGICAL.get(phase or "")
        if state is not None and state != s["state"]:
            if s["state"] is not None:
                yield "state", None, None, s["state"], s["since"], at, None, None, None, *NONE
            s["state"], s["since"] = state, at
        yield from self.update(at, seen, status, version)
        if drive_data:
            s["drive_at"] = at

    def park(self, at: int, phase: str | None, latitude: float | None, longitude: float | None, id: int | None) -> Iterator[tuple]:
        s = self.s
        fits = phase in ("online", "charging") and (s["drive_at"] is None or at > s["drive_at"]) and latitude is not None and longitude is not None and abs(latitude) <= 90 and abs(longitude) <= 180
        if fits and (s["phase"] != phase or s["drive_at"] is None or s["parked_at"] is None or at - s["parked_at"] >= self.thin_ms):
            s["parked_at"] = at
            yield "position", None, id, phase, at, None, None, latitude, longitude, *NONE

    def update(self, at: int, phase: str | None, status: str | None, version: str | None) -> Iterator[tuple]:
        s = self.s
        told, before = (status or "").lower(), s["version"]
        s["version"] = version or before
        if told == "available":
            s["update_start"] = None
        elif told == "installing":
            s["update_start"] = at if s["update_start"] is None else s["update_start"]
        elif version and phase not in ("asleep", "offline"):
            if s["update_start"] is not None:
                yield "update", None, None, version, s["update_start"], at, None, None, None, *NONE
                s["update_start"] = None
            elif before and firmware(version) > firmware(before):
                yield "missed_update", None, None, version, at, at, None, None, None, *NONE


def firmware(version: str) -> list[int]:
    """A version as numbers that compare as firmware does; see functions.scalars.firmware_key."""
    return [int(p) if p.isdecimal() else 0 for p in version.split()[0].split(".")]


class Ordered(StatefulProcessor):
    """Gives a key's rows of a micro-batch in order of a whole number, a bounded piece at a time."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.aside = handle.getMapState("aside", "block long, part long", "rows binary")

    def pieces(self, rows: Iterable[pd.DataFrame], order: str) -> Iterator[pd.DataFrame]:
        frames = iter(rows)
        first, second = next(frames), next(frames, None)
        if second is None:
            yield first if first[order].is_monotonic_increasing else first.sort_values(order, kind="stable")
            return
        for part, frame in enumerate(chain([first, second], frames)):
            for block, own in frame.groupby(frame[order] // BLOCK):
                sink = pa.BufferOutputStream()
                batch = pa.RecordBatch.from_pandas(own, preserve_index=False)
                with pa.ipc.new_stream(sink, batch.schema) as out:
                    out.write_batch(batch)
                self.aside.updateValue((int(block), part), (sink.getvalue().to_pybytes(),))
        keys = sorted(tuple(k) for k in self.aside.keys())
        for _, own in groupby(keys, key=lambda k: k[0]):
            own = list(own)
            yield pd.concat([pa.ipc.open_stream(self.aside.getValue(k)[0]).read_pandas() for k in own]).sort_values(order, kind="stable")
            for k in own:
                self.aside.removeKey(k)

    def close(self) -> None:
        pass


def listed(column: pd.Series) -> list:
    """A column's values, None where there is none."""
    return [None if lost else v for v, lost in zip(column.tolist(), column.isna().tolist(), strict=True)]


class Lifecycle(Ordered):
    def __init__(self, offline_ms: int = OFFLINE_MS, thin_ms: int = THIN_MS, letters: tuple[str, ...] = ()):
        self.offline_ms, self.thin_ms, self.letters = offline_ms, thin_ms, letters

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.state = handle.getValueState("open", STATE)

    def handleInputRows(self, key, rows: Iterable[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        car = Car(self.state.get() if self.state.exists() else None, self.offline_ms, self.thin_ms)
        for piece in self.pieces(rows, "observation_id"):
            yield self.folded(key[0], car, piece)
        self.state.update(car.values())

    def folded(self, car_id: int, car: Car, rows: pd.DataFrame) -> pd.DataFrame:
        """What a car's rows, in order, close and add. Columns are read and built whole, as a car has few rows in a micro-batch."""
        out, nothing = [], [None] * len(self.letters)
        taken = [c for c in ("phase", "odometer", "energy", "status", "version", "latitude", "longitude", "drive_data", "moving", *MEASURES) if c in rows]
        values = zip(*map(listed, (rows[c] for c in taken)), strict=True)
        told = zip(*map(listed, (rows[c] for c in self.letters)), strict=True) if self.letters else [()] * len(rows)
        given = zip(rows["observation_id"].tolist(), rows["at_ms"].tolist(), listed(rows["charging_state"]), listed(rows["broken"]), values, told, strict=True)
        for id, at, charging, broken, row, letter in given:
            if car.s["last_id"] is not None and id <= car.s["last_id"]:
                continue
            car.s["last_id"] = id = int(id)
            for done in car.step(int(at), charging=charging, broken=bool(broken), id=id, **dict(zip(taken, row, strict=True))):
                out.append((car_id, *done, *(letter if done[0] == "quarantine" else nothing)))
        names = [*OUT_NAMES, *self.letters]
        columns = zip(*out, strict=True) if out else [()] * len(names)
        return pd.DataFrame({c: pd.array(v, "Int64") if c in WHOLE else np.array(v, "float64") if c in REAL else np.array(v, object) for c, v in zip(names, columns, strict=True)}, copy=False)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        """Open sessions of imported history: rows of STATE after car_id."""
        first = initialState.iloc[0]
        self.state.update(tuple(None if pd.isna(first[c.split()[0]]) else first[c.split()[0]] for c in STATE.split(", ")))


def lifecycle_stream(obs: DataFrame, seeds: DataFrame | None = None, offline_ms: int = OFFLINE_MS, thin_ms: int = THIN_MS, letters: dict[str, str] | None = None) -> DataFrame:
    """obs (IN) as stream -> closed rows and children (OUT). seeds: (car_id, STATE) of sessions open at the import's end; letters: columns of obs and their types that a quarantined row keeps, behind OUT."""
    letters = letters or {}
    keyed = obs.groupBy("car_id")
    start = seeds.groupBy("car_id") if seeds is not None else None
    return keyed.transformWithStateInPandas(statefulProcessor=Lifecycle(offline_ms, thin_ms, tuple(letters)), outputStructType=OUT + "".join(f", {c} {kind}" for c, kind in letters.items()), outputMode="Append", timeMode="None", initialState=start)


def gate(obs: DataFrame, marks: DataFrame) -> DataFrame:
    """obs without what an import covered: each group's columns go where the group's own time (drive_ts, charge_ts, vehicle_ts; at_ms without such a column) is at or before the car's import mark (car_id, drive_ms, charge_ms, vehicle_ms).

    An old drive group takes drive data, coordinates and odometer with it, an old charge group the charging state and
    energy, an old vehicle group status and version. A row whose three groups are all old loses its phase and keeps the car's.
    """
    met = obs.join(marks, "car_id", "left")
    time = lambda group: F.coalesce(F.col(f"{group}_ts"), F.col("at_ms")) if f"{group}_ts" in obs.columns else F.col("at_ms")
    old = {g: F.coalesce(time(g) <= F.col(f"{g}_ms"), F.lit(False)) for g in ("drive", "charge", "vehicle")}
    groups = {"drive": ["odometer", "latitude", "longitude"], "charge": ["charging_state", "energy"], "vehicle": ["status", "version"]}
    out = {c: F.when(~old[g], F.col(c)) for g, cols in groups.items() for c in cols if c in obs.columns}
    out["phase"] = F.when(~(old["drive"] & old["charge"] & old["vehicle"]), F.col("phase"))
    if "drive_data" in obs.columns:
        out["drive_data"] = F.col("drive_data") & ~old["drive"]
    return met.withColumns(out).drop(*[c for c in marks.columns if c != "car_id"])


# A frame's earliest time, and how far it may be ahead of its receipt.
FIRST_MS, AHEAD_MS = 946_684_800_000, 300_000


class Fresh(Ordered):
    """Lets a frame through if its timestamp is plausible and later than every one before it, and every row without a timestamp if others."""

    def __init__(self, order: str = "received_id", received: str = "received_ms", others: bool = False):
        self.order, self.received, self.others = order, received, others

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.state = handle.getValueState("last", "ts_ms long")

    def handleInputRows(self, key, rows: Iterable[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.state.get()[0] if self.state.exists() else None
        for piece in self.pieces(rows, self.order):
            at = piece["ts_ms"]
            piece = piece[((at >= FIRST_MS) & (at <= piece[self.received] + AHEAD_MS)) | (at.isna() & self.others)]
            top = piece["ts_ms"].cummax().ffill().shift()
            if last is not None:
                top = top.fillna(last).clip(lower=last)
            kept = piece[top.isna() | (piece["ts_ms"] > top) | piece["ts_ms"].isna()]
            if kept["ts_ms"].notna().any():
                last = int(kept["ts_ms"].max())
            yield kept
        if last is not None:
            self.state.update((last,))


def fresh_frames(frames: DataFrame, received: str = "received_ms", order: str = "received_id", others: bool = False) -> DataFrame:
    """A stream of frames (car_id, received_id, ts_ms, received_ms, ...) without implausible times and, per car in order of received_id, without frames that aren't newer than all before. others: rows without ts_ms are no frames and stay."""
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frames.schema.fields)
    return frames.groupBy("car_id").transformWithStateInPandas(statefulProcessor=Fresh(order, received, others), outputStructType=kind, outputMode="Append", timeMode="None")


def deduplicated(frames: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """A stream of frames (car_id, ts_ms) without repeats inside the watermark."""
    timed = frames.withColumn("ts", F.timestamp_millis("ts_ms")).withWatermark("ts", delay)
    return timed.dropDuplicatesWithinWatermark(["car_id", "ts_ms"])


MOST_MUTATIONS = 10_000


def publish(changes: DataFrame, path: str, checkpoint: str, most: int = MOST_MUTATIONS):
    """Micro-batches of a mutation stream (entity, id, car_id, op, payload) as commits of at most so many rows in order of their id, on the head each.

    A commit is named after its batch and place, so a batch that is tried again goes on behind what it has committed; one that
    finds the head moved takes the new head.
    """

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        sized = settled(batch.withColumns({"_all": F.lit(0), "_size": F.lit(0).cast("bigint")}))
        parts = settled(cdc.batch_changes(sized, max_rows=most, by="_all", order="id", size="_size"))
        for place in range((parts.agg(F.max("batch")).first()[0] or 0) + 1 if not parts.isEmpty() else 0):
            tag = f"{number}/{place}"
            while not any(m.get("tag") == tag for m in commits.manifests(spark, path)):
                top = commits.head(spark, path)
                try:
                    commits.commit_delta(parts.where(F.col("batch") == place), path, top["to_seq"] + 1, top["chain"], tag)
                except commits.Stale:
                    continue

    return changes.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


RETRY_MS = 6 * 3_600_000


def enrichment_pass(candidates: DataFrame, tried: DataFrame, now_ms: int, page: int = 1000) -> DataFrame:
    """The next page of candidates (id) that weren't resolved, and whose last failure (id, failed_ms, resolved) is six hours old."""
    held = tried.where(F.col("resolved") | (F.col("failed_ms") > now_ms - RETRY_MS)).select("id")
    return candidates.join(held, "id", "left_anti").orderBy("id").limit(page)
