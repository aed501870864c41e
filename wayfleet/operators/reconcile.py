"""Counts, watermarks, fingerprints and inventories of imports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayfleet.operators import merkle

ENTITY_RANK = ["charge_sample", "position", "charge", "drive", "state", "update"]  # children first
STAGE = {"car": 0, "drive": 1, "charge": 1, "position": 2, "charge_sample": 2, "state": 2, "update": 2, "tombstone": 3}


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def source_counts(**tables: DataFrame) -> DataFrame:
    """(table, n) of each frame."""
    return union([t.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n") for name, t in tables.items()])


def source_witness(**tables: DataFrame) -> DataFrame:
    """One row with every table's count."""
    return source_counts(**tables).groupBy().pivot("table", sorted(tables)).agg(F.first("n"))


def count_reconciliation(source: DataFrame, projected: DataFrame, skipped: DataFrame) -> DataFrame:
    """(table, source, projected, skipped, unexplained) from three (table, n) frames."""
    frames = [f.groupBy("table").agg(F.sum("n").alias(c)) for f, c in ((source, "source"), (projected, "projected"), (skipped, "skipped"))]
    out = frames[0].join(frames[1], "table", "full").join(frames[2], "table", "full")
    out = out.select("table", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("source", "projected", "skipped")])
    return out.withColumn("unexplained", F.col("source") - F.col("projected") - F.col("skipped"))


def source_watermarks(**tables: tuple[DataFrame, list[str]]) -> DataFrame:
    """(table, max_id, max_ms): the largest id, and the largest of these time columns."""
    def one(name: str, rows: DataFrame, cols: list[str]) -> DataFrame:
        top = [F.max(c) for c in cols]
        return rows.agg(F.max("id").alias("max_id"), (F.greatest(*top) if len(top) > 1 else top[0]).alias("max_ms")).select(F.lit(name).alias("table"), "max_id", "max_ms")

    return union([one(n, *t) for n, t in tables.items()])


def next_ids(*sets: dict[str, DataFrame]) -> DataFrame:
    """(entity, next_id) over all sets of entities' frames."""
    rows = union([f.select(F.lit(name).alias("entity"), F.col("id").cast("bigint").alias("id")) for s in sets for name, f in s.items()])
    return rows.groupBy("entity").agg(F.greatest(F.max("id") + 1, F.lit(1)).alias("next_id"))


def latest_firmware(updates: DataFrame) -> DataFrame:
    """(car_id, version) at the largest (end_ms, start_ms, id) of completed updates."""
    return updates.where("end_ms is not null").groupBy("car_id").agg(F.max_by("version", F.struct("end_ms", "start_ms", "id")).alias("version"))


def projection_report(**counts: DataFrame) -> DataFrame:
    """(counter, n), and their total as 'logical_rows'."""
    rows = source_counts(**counts).withColumnRenamed("table", "counter")
    return rows.unionByName(rows.agg(F.sum("n").alias("n")).select(F.lit("logical_rows").alias("counter"), "n"))


def update_summary(updates: DataFrame) -> DataFrame:
    return updates.agg(
        F.count("*").alias("rows"), F.count_if(F.col("end_ms").isNotNull()).alias("completed"), F.count_if(F.col("end_ms").isNull()).alias("open"), F.count_if(F.col("version").isNull()).alias("null_version"), F.count_if(F.col("version") == "").alias("empty_version"),
        F.min("start_ms").alias("min_start_ms"), F.max("start_ms").alias("max_start_ms"), F.min("end_ms").alias("min_end_ms"), F.max("end_ms").alias("max_end_ms"),
    )


def dataset_fingerprint(rows: DataFrame, by: list[str], key: str = "id", digest: str = "digest") -> DataFrame:
    """(by, n, fingerprint) of rows' digests, whatever their layout and repeats: the roots of their hash trees."""
    return merkle.roots(merkle.hash_tree(rows, by, key, digest), by)


def evidence_fingerprint(kinds: dict[str, DataFrame]) -> DataFrame:
    """(n, increasing, fingerprint) over frames (id, value, and place if the source has an order) in fixed order of kind.

    increasing: within each kind ids rise strictly in order of place; without places, that none is null or comes twice.
    """
    out, rising = [], True
    for kind, rows in sorted(kinds.items()):
        rising = rising and merkle.increasing(rows, "id", "place" if "place" in rows.columns else "id")
        digest = F.sha2(F.concat_ws("\x1f", F.lit(kind), F.col("id").cast("string"), F.coalesce(F.col("value").cast("string"), F.lit("null"))), 256)
        out.append(dataset_fingerprint(rows.select(F.lit(kind).alias("kind"), "id", digest.alias("digest")), ["kind"]))
    told = F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "kind", F.col("n").cast("string"), "fingerprint"))), "\n"), 256)
    return union(out).groupBy().agg(F.sum("n").alias("n"), F.lit(rising).alias("increasing"), told.alias("fingerprint"))


def materialisation_report(children: DataFrame, parent: str) -> DataFrame:
    """(parent, n): distinct children of each closed session."""
    return children.where(F.col(parent).isNotNull()).groupBy(parent).agg(F.count_distinct("id").alias("n"))


def duplicate_ids(**tables: DataFrame) -> DataFrame:
    """(entity, id, n): ids that come twice or aren't positive."""
    rows = union([t.select(F.lit(name).alias("entity"), F.col("id").cast("bigint").alias("id")) for name, t in tables.items()])
    return rows.groupBy("entity", "id").agg(F.count("*").alias("n")).where("n > 1 or id <= 0 or id is null")


def inventory(**tables: DataFrame) -> DataFrame:
    """(entity, id, car_id) of all rows."""
    return union([t.select(F.lit(name).alias("entity"), F.col("id").cast("bigint").alias("id"), F.col("car_id").cast("bigint").alias("car_id")) for name, t in tables.items()])


def same_inventory(a: DataFrame, b: DataFrame) -> DataFrame:
    """(only_first, only_second): both 0 if the inventories are equal."""
    return a.exceptAll(b).agg(F.count("*").alias("only_first")).crossJoin(b.exceptAll(a).agg(F.count("*").alias("only_second")))


def removed_keys(before: DataFrame, now: DataFrame) -> DataFrame:
    return before.join(now, ["entity", "id", "car_id"], "left_anti")


def dedupe_or_conflict(rows: DataFrame) -> DataFrame:
    """(entity, id, n, conflict): equal repeats are one row; another digest or car under a key is a conflict."""
    return rows.groupBy("entity", "id").agg(F.count("*").alias("n"), (F.count_distinct("digest", "car_id") > 1).alias("conflict"))


def rank_of(entity: Column | str, order: list[str]) -> Column:
    e = F.col(entity) if isinstance(entity, str) else entity
    out = F
    for i, name in enumerate(order):
        out = out.when(e == name, i)
    return out.otherwise(len(order))


def tombstone_order(rows: DataFrame) -> DataFrame:
    """rows with rank, children first."""
    return rows.withColumn("rank", rank_of("entity", ENTITY_RANK))


def stage_of(entity: Column | str) -> Column:
    e = F.col(entity) if isinstance(entity, str) else entity
    return F.create_map(*[F.lit(x) for kv in STAGE.items() for x in kv])[e]


def ordinals(rows: DataFrame, by: str, order: str, ordinal: str) -> DataFrame:
    """Rows whose ordinal isn't their place from 0 on."""
    at = F.row_number().over(W.partitionBy(by).orderBy(order)) - 1
    return rows.withColumn("_at", at.cast("bigint")).where(F.col("_at") != F.col(ordinal)).drop("_at")
