"""Finished drives and charges from their rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayfleet.functions.scalars import scaled_round

LEAST_KM = 0.01


def first_last(col: str, *order: str, also: str | None = None) -> tuple[Column, Column]:
    """First and last value that isn't null (and whose row has `also`), in a total order."""
    there = F.col(col).isNotNull() if also is None else F.col(col).isNotNull() & F.col(also).isNotNull()
    key = F.when(there, F.struct(*order))
    return F.min_by(col, key), F.max_by(col, key)


def elevation_gain_loss(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """(key, ascent, descent) over neighbouring elevations that aren't null; a total of 32768 or more counts as 0."""
    step = F.col("elevation") - F.lag("elevation").over(W.partitionBy(key).orderBy(*order))
    rows = rows.where("elevation is not null").withColumn("_step", step)
    fits = lambda total: F.when(total >= 32768, 0).otherwise(total).cast("bigint")
    up, down = F.sum(F.greatest("_step", F.lit(0))), F.sum(F.greatest(-F.col("_step"), F.lit(0)))
    return rows.groupBy(key).agg(fits(F.coalesce(up, F.lit(0))).alias("ascent"), fits(F.coalesce(down, F.lit(0))).alias("descent"))


def finalize_drives(rows: DataFrame, key: str = "drive_id", time: str = "date_ms") -> DataFrame:
    """One row per drive with two positions or more, both odometers and LEAST_KM; minutes are rounded."""
    order = (time, "id")
    odo = first_last("odometer", *order)
    ideal, rated, soc = first_last("ideal_km", *order, also="odometer"), first_last("rated_km", *order), first_last("battery_level", *order)
    lat, lon = first_last("latitude", *order), first_last("longitude", *order)
    out = rows.groupBy(key).agg(
        F.min("car_id").alias("car_id"), F.count("*").alias("n_positions"), F.min(time).alias("start_ms"), F.max(time).alias("end_ms"),
        scaled_round(odo[1] - odo[0], 6).alias("distance_km"), F.max("speed").alias("speed_max"), F.max("power").alias("power_max"), F.min("power").alias("power_min"),
        scaled_round(F.avg("outside_temp"), 1).alias("outside_temp_avg"), scaled_round(F.avg("inside_temp"), 1).alias("inside_temp_avg"),
        ideal[0].alias("start_ideal_km"), ideal[1].alias("end_ideal_km"), rated[0].alias("start_rated_km"), rated[1].alias("end_rated_km"),
        soc[0].alias("start_soc"), soc[1].alias("end_soc"), lat[0].alias("start_latitude"), lon[0].alias("start_longitude"), lat[1].alias("end_latitude"), lon[1].alias("end_longitude"),
    )
    return out.where((F.col("n_positions") >= 2) & (F.col("distance_km") >= LEAST_KM)).withColumn("duration_min", F.round((F.col("end_ms") - F.col("start_ms")) / 60000).cast("bigint"))


def finalize_charges(rows: DataFrame, key: str = "charge_id", time: str = "date_ms") -> DataFrame:
    """One row per charge: energy added is the last (if over 0, else the largest) less the first, null if negative; minutes are cut off.

    Rows that are no samples (sample, if there is such a column) give the end, energy, charge level and ranges, but aren't counted.
    """
    sample = F.col("sample") if "sample" in rows.columns else F.lit(True)
    order = (time, "id")
    energy, soc, rated = first_last("energy", *order), first_last("battery_level", *order), first_last("rated_km", *order)
    out = rows.groupBy(key).agg(
        F.min("car_id").alias("car_id"), F.count_if(sample).alias("n_samples"), F.min(time).alias("start_ms"), F.max(time).alias("end_ms"), energy[0].alias("_first"), energy[1].alias("_last"), F.max("energy").alias("_most"),
        soc[0].alias("start_battery_level"), soc[1].alias("end_battery_level"), rated[0].alias("start_rated_km"), rated[1].alias("end_rated_km"), F.max(F.when(sample, F.col("power"))).alias("max_power"), F.coalesce(F.bool_or(F.when(sample, F.col("fast_present"))), F.lit(False)).alias("is_dc"),
    )
    added = F.when(F.col("_last") > 0, F.col("_last")).otherwise(F.col("_most")) - F.col("_first")
    minutes = F.floor((F.col("end_ms") - F.col("start_ms")) / 60000).cast("bigint")
    return out.withColumns({"energy_added": F.when(added >= 0, added), "duration_min": minutes}).drop("_first", "_last", "_most")


def charge_facts(rows: DataFrame, key: str = "charge_id", time: str = "date_ms") -> DataFrame:
    """Facts of a charge from its samples, whatever their order."""
    order = (time, "id")
    energy, soc, ideal = first_last("energy", *order), first_last("battery_level", *order), first_last("ideal_km", *order)
    out = rows.groupBy(key).agg(
        F.coalesce(F.bool_or("fast_present"), F.lit(False)).alias("is_dc"), F.max("power").alias("max_power"), (energy[1] - energy[0]).alias("_energy"), soc[0].alias("start_battery_level"), soc[1].alias("end_battery_level"),
        ideal[0].alias("start_ideal_km"), ideal[1].alias("end_ideal_km"), F.max_by("fast_type", F.when((F.col("power") > 0) & F.col("fast_type").isNotNull(), F.struct(*order))).alias("fast_type"), F.min(time).alias("first_ms"), F.max(time).alias("last_ms"), F.count("*").alias("n_samples"),
    )
    return out.withColumn("energy_added", F.when(F.col("_energy") >= 0, F.col("_energy"))).drop("_energy")


def usable(power: Column) -> Column:
    """A power that is finite and not negative, else null."""
    return F.when((power >= 0) & (power.cast("double") < float("inf")), power)


def energy_used(rows: DataFrame, key: str = "charge_id", time: str = "date_ms") -> DataFrame:
    """(key, energy_used, n_intervals): the last usable power before each row with a usable one, times the time since the row before."""
    w = W.partitionBy(key).orderBy(time, "id")
    rows = rows.withColumn("_power", usable(F.col("power")))
    before = F.last("_power", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    part = F.when(F.col("_power").isNotNull() & (F.col("_dt") > 0), before * F.col("_dt"))
    out = rows.withColumn("_dt", F.col(time) - F.lag(time).over(w)).withColumn("_part", part)
    return out.groupBy(key).agg(scaled_round(F.sum("_part") / 3.6e6, 4).alias("energy_used"), F.count("_part").alias("n_intervals"))


def determine_phases(rows: DataFrame, key: str = "charge_id") -> DataFrame:
    """(key, n, phases_used): from over 15 samples, the mean of positive P / (I V) held against the rounded mean of reported phases.

    Equal when rounded: that number; three reported and a mean within a tenth of the root of 3: the root; else the mean
    rounded if it lies within 0.3 of that; else null.
    """
    ratio = F.try_divide(F.col("power") * F.lit(1000.0), F.col("current") * F.col("voltage"))
    ratio = F.when(ratio > 0, ratio)
    out = rows.groupBy(key).agg(F.count("*").alias("n"), F.avg(ratio).alias("_p"), F.round(F.avg("phases")).alias("_r"))
    p, r, root = F.col("_p"), F.col("_r"), F.sqrt(F.lit(3.0))
    phases = F.when((F.col("n") <= 15) | p.isNull(), None).when(r == F.round(p), r).when((r == 3) & (F.abs(p / root - 1) <= 0.1), root).when(F.abs(F.round(p) - p) <= 0.3, F.round(p))
    return out.select(key, "n", phases.cast("double").alias("phases_used"))


def energy_used_phase_aware(rows: DataFrame, key: str = "charge_id", time: str = "date_ms") -> DataFrame:
    """(key, energy_used): the fallback where no interval was integrated. A row's power holds until the next row: as it is where phases are null, else I V times the determined phases / 1000; a row whose phases can't be determined is passed over."""
    w = W.partitionBy(key).orderBy(time, "id")
    rows = rows.join(determine_phases(rows, key).select(key, "phases_used"), key)
    dt = F.lead(time).over(w) - F.col(time)
    power = F.when(F.col("phases").isNull(), F.col("power").cast("double")).otherwise(F.col("current") * F.col("voltage") * F.col("phases_used") / 1000)
    out = rows.withColumn("_part", F.when(dt > 0, usable(power) * dt))
    return out.groupBy(key).agg(scaled_round(F.sum("_part") / 3.6e6, 4).alias("energy_used"))


def charge_energy_used(rows: DataFrame, key: str = "charge_id", time: str = "date_ms") -> DataFrame:
    """(key, energy_used): integrated, or by phases where no interval was."""
    first = energy_used(rows, key, time).select(key, F.col("energy_used").alias("_first"))
    return first.join(energy_used_phase_aware(rows, key, time), key).select(key, F.coalesce("_first", "energy_used").alias("energy_used"))


def backfill_interval(parents: DataFrame, facts: DataFrame, key: str = "charge_id") -> DataFrame:
    """parents (id, start_ms, end_ms) with the interval widened to hold all samples; an open end stays open."""
    out = parents.join(facts.select(F.col(key).alias("id"), "first_ms", "last_ms"), "id", "left")
    end = F.when(F.col("end_ms").isNotNull(), F.greatest("end_ms", "last_ms"))
    return out.withColumns({"start_ms": F.least("start_ms", "first_ms"), "end_ms": end}).drop("first_ms", "last_ms")
