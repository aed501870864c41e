"""Geofences, tariffs, elevation tiles and cached addresses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayfleet.functions.scalars import RADIUS_EQUATOR, haversine_m, tile_cell, tile_name
from wayfleet.operators.folds import held

CELL = 0.05  # degrees of latitude: over 5 km, the largest radius
MOST_RADIUS = 5000.0
VOID, LOWEST, HIGHEST = -32768, -1000, 10000


def _fence_cells(fences: DataFrame) -> DataFrame:
    """A row per grid cell that a fence's circle may touch; longitude cells widen with latitude and wrap at 180 degrees."""
    lat, lon, r = F.col("fence_latitude"), F.col("fence_longitude"), F.col("fence_radius")
    dlat = F.degrees(r / F.lit(6_356_000.0))
    cos = F.cos(F.radians(F.least(F.lit(90.0), F.abs(lat) + dlat)))
    dlon = F.when(cos < 1e-3, F.lit(180.0)).otherwise(F.least(F.lit(180.0), dlat / cos))
    turn = int(round(360 / CELL))
    rows = F.sequence(F.floor((lat - dlat) / CELL), F.floor((lat + dlat) / CELL))
    cols = F.sequence(F.floor((lon - dlon) / CELL), F.floor((lon + dlon) / CELL))
    return fences.withColumn("_row", F.explode(rows)).withColumn("_col", F.explode(cols)).withColumn("_col", F.pmod("_col", F.lit(turn))).distinct()


def _unrivalled(fences: DataFrame) -> DataFrame:
    """Fences without those that one of the same centre, a lower id and at least their radius precedes at every point: these are never the nearest."""
    before = W.partitionBy("fence_latitude", "fence_longitude").orderBy("geofence_id", F.desc("fence_radius")).rowsBetween(W.unboundedPreceding, -1)
    return fences.withColumn("_most", F.max("fence_radius").over(before)).where("_most is null or fence_radius > _most").drop("_most")


def nearest_geofence(points: DataFrame, fences: DataFrame, boundary: str = "strict", radius: float = RADIUS_EQUATOR) -> DataFrame:
    """points (id, latitude, longitude) -> (id, geofence_id, distance_m): the nearest fence whose circle holds the point, ties to the lowest id.

    An equi-join on grid cells, so work grows with points near fences; fences that share a centre count as their steps of
    radius alone. The cells are held first, so that Spark knows whether they can be broadcast. boundary: 'strict' leaves the circle's
    line out and takes radii in (0, 5000) only, 'inclusive' counts it in.
    """
    own = fences.select(F.col("id").alias("geofence_id"), F.col("latitude").alias("fence_latitude"), F.col("longitude").alias("fence_longitude"), F.col("radius").cast("double").alias("fence_radius"))
    own = own.where((F.col("fence_radius") > 0) & (F.col("fence_radius") < MOST_RADIUS))
    turn = int(round(360 / CELL))
    spots = points.where("latitude is not null and longitude is not null").select("id", "latitude", "longitude")
    spots = spots.withColumns({"_row": F.floor(F.col("latitude") / CELL), "_col": F.pmod(F.floor(F.col("longitude") / CELL), F.lit(turn))})
    distance = haversine_m(F.col("latitude"), F.col("longitude"), F.col("fence_latitude"), F.col("fence_longitude"), radius, "atan2")
    met = spots.join(held(_fence_cells(_unrivalled(own))), ["_row", "_col"]).withColumn("distance_m", distance)
    inside = F.col("distance_m") < F.col("fence_radius") if boundary == "strict" else F.col("distance_m") <= F.col("fence_radius")
    best = met.where(inside).groupBy("id").agg(F.min(F.struct("distance_m", "geofence_id")).alias("best"))
    return best.select("id", "best.geofence_id", "best.distance_m")


def fill_labels(drives: DataFrame, fences: DataFrame, **how) -> DataFrame:
    """drives (id, start_/end_ latitude and longitude, start_/end_geofence) with missing labels filled by the fences that hold the ends."""
    out = drives
    for side in ("start", "end"):
        spots = drives.select("id", F.col(f"{side}_latitude").alias("latitude"), F.col(f"{side}_longitude").alias("longitude"))
        names = nearest_geofence(spots, fences, **how).join(fences.select(F.col("id").alias("geofence_id"), F.col("name").alias("_name")), "geofence_id").select("id", "_name")
        out = out.join(names, "id", "left").withColumn(f"{side}_geofence", F.coalesce(f"{side}_geofence", "_name")).drop("_name")
    return out


def tariffs(charges: DataFrame, fences: DataFrame, **how) -> DataFrame:
    """charges (id, start_latitude, start_longitude) with the tariff of the fence at their start."""
    spots = charges.select("id", F.col("start_latitude").alias("latitude"), F.col("start_longitude").alias("longitude"))
    found = nearest_geofence(spots, fences, **how).join(fences.select(F.col("id").alias("geofence_id"), "billing_type", "cost_per_unit", "session_fee"), "geofence_id").drop("distance_m")
    return charges.join(found, "id", "left")


def elevations(positions: DataFrame, grid: DataFrame) -> DataFrame:
    """positions with a null elevation filled from grid rows (tile, side, row, cells); void or impossible cells give null.

    A position meets its own row of the grid alone. The sizes of tiles are broadcast: one for each degree square of
    the earth at most. Where a tile comes in two sizes, the finer one counts.
    """
    sides = F.broadcast(grid.groupBy("tile").agg(F.max("side").alias("side")))
    lost = positions.where("elevation is null").withColumn("tile", tile_name(F.col("latitude"), F.col("longitude"))).join(sides, "tile", "left")
    at = tile_cell(F.col("latitude"), F.col("longitude"), F.col("side"))
    lost = lost.withColumn("_at", at).withColumns({"row": F.expr("cast(_at div side as int)"), "_col": F.expr("cast(_at % side as int)")})
    met = lost.join(grid, ["tile", "side", "row"], "left")
    cell = F.get("cells", F.col("_col")).cast("bigint")
    found = met.withColumn("elevation", F.when((cell != VOID) & cell.between(LOWEST, HIGHEST), cell))
    return positions.where("elevation is not null").unionByName(found.select(*positions.columns))


def cached_addresses(points: DataFrame, cache: DataFrame, digits: int = 4) -> DataFrame:
    """points (id, latitude, longitude) with osm_type, osm_id and display_name of the cache entry at the rounded coordinate; null where there is none."""
    scale = 10**digits
    key = lambda c: F.round(F.col(c) * scale).cast("bigint")
    known = cache.groupBy(key("latitude").alias("_lat"), key("longitude").alias("_lon")).agg(F.min(F.struct("osm_type", "osm_id", "display_name")).alias("found"))
    return points.withColumns({"_lat": key("latitude"), "_lon": key("longitude")}).join(known, ["_lat", "_lon"], "left").select(*points.columns, "found.osm_type", "found.osm_id", "found.display_name")


def address_misses(points: DataFrame, cache: DataFrame, digits: int = 4) -> DataFrame:
    return cached_addresses(points, cache, digits).where("osm_id is null").select(*points.columns)
