"""The relational import as one operation: all projections checked, counted and written in canonical order, shown by one rename.

Each entity is one job. Its rows meet their lookups, are cut into ranges of id and sorted there, which puts repeated ids side by
side without another shuffle, and are written as Parquet; states and updates are then ordered by start and id. Counts and checks are
observed in the job that writes, so nothing is read again for them. A repeated, missing or not positive id of any source row, a key
of a projected row that names nothing (or another car's position), and a state outside its domain refuse the import: nothing is shown then.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from wayfleet.operators import drives, reconcile, relations
from wayfleet.sources import commits

# The report's counters in order, as (entity, whether its rows are the projected ones); those left out have no counter where none is named.
COUNTERS = {
    "completed_drives": ("drive", True), "skipped_open_drives": ("drive", False), "skipped_unattached_positions": ("position", False), "projected_positions": ("position", True), "projected_charges": ("charge", True),
    "projected_charge_samples": ("charge_sample", True), "projected_states": ("state", True), "projected_updates": ("update", True), "skipped_incomplete_updates": ("update", False),
}
REPORT = "counter string, n long"
FLAGS = ["_kept", "_dangling"]


class Refused(ValueError):
    """An import whose source breaks a rule; findings: (entity, what, rows)."""

    def __init__(self, findings: list[tuple[str, str, int]]):
        super().__init__("; ".join(f"{entity}: {n} {what}" for entity, what, n in findings))
        self.findings = findings


def projections(tables: dict[str, DataFrame], car_id: int | None = None) -> dict[str, DataFrame]:
    """Every entity's source rows, projected, with _kept (it belongs to the import) and _dangling (keys that name nothing; for a state, 1 outside the domain).

    tables: cars, drives, positions, charges, samples, states, updates, addresses, geofences; rows of one car if car_id is given.
    Samples follow their process and carry no car.
    """
    own = {name: t.where(F.col("id" if name == "cars" else "car_id") == car_id) if car_id is not None and name in ("cars", "drives", "positions", "charges", "states", "updates") else t for name, t in tables.items()}
    places = [own["positions"], own["addresses"], own["geofences"]]
    flagged = lambda rows, kept, dangling=F.lit(0): rows.withColumns(dict(zip(FLAGS, (F.coalesce(kept, F.lit(False)), dangling), strict=True)))
    done = relations.sound_update(own["updates"])
    firmware = reconcile.latest_firmware(relations.project_update(own["updates"]))
    processes = own["charges"].select(F.col("id").alias("charge_id"), F.lit(True).alias("_own"))
    samples = own["samples"].join(processes, "charge_id", "left")
    facts = drives.charge_facts(samples.where("_own").drop("_own"))
    charges = relations.project_charge(own["charges"], facts, own["addresses"], own["geofences"], own["positions"])
    drive = relations.with_lookups(own["drives"], *places)
    return {
        "car": flagged(relations.project_car(own["cars"], firmware), F.lit(True)),
        "drive": flagged(drive, F.col("end_ms").isNotNull(), F.col("n_dangling")).drop("n_dangling"),
        "position": flagged(relations.with_completed(own["positions"], own["drives"]), F.col("_attached")).drop("_attached"),
        "charge": flagged(charges, F.lit(True), F.col("n_dangling")).drop("n_dangling"),
        "charge_sample": flagged(relations.project_charge_sample(samples), F.col("_own")).drop("_own"),
        "state": flagged(own["states"], F.lit(True), F.when(F.col("state").isin(relations.STATES), 0).otherwise(1)),
        "update": flagged(done, F.col("sound")).drop("sound"),
    }


def _checks() -> list[Column]:
    """What a writing job tells of the rows that pass through it."""
    kept = F.col("_kept")
    return [
        F.count_if(kept).alias("kept"), F.count_if(~kept).alias("left"), F.count_if(F.col("_copy") > 1).alias("repeated"),
        F.count_if(F.coalesce(F.col("id") <= 0, F.lit(True))).alias("unnamed"), F.coalesce(F.sum(F.when(kept, F.col("_dangling"))), F.lit(0)).alias("dangling"),
    ]


def ordered(rows: DataFrame, entity: str) -> DataFrame:
    """Rows in canonical order, by id or, for states and updates, by start and id, with _copy: 1 for an id's first row."""
    out = rows.repartitionByRange("id").withColumn("_copy", F.row_number().over(W.partitionBy("id").orderBy("id")))
    return out.repartitionByRange("start_ms", "id").sortWithinPartitions("start_ms", "id") if entity in ("state", "update") else out


def import_history(tables: dict[str, DataFrame], path: str, name: str, car_id: int | None = None) -> DataFrame:
    """Writes all projections under path/name and returns the report (REPORT), its last row logical_rows; raises Refused, and shows nothing, where a check fails.

    A car_id that no car has is refused, as is a name that is taken. See projections for the tables.
    """
    spark = tables["cars"].sparkSession
    draft, told = f"{path}/draft/{uuid.uuid4().hex}", {}
    commits.made(spark, path)
    for entity, rows in projections(tables, car_id).items():
        seen = Observation()
        watched = ordered(rows, entity).observe(seen, *_checks())
        watched.where("_kept").drop("_copy", *FLAGS).write.parquet(f"{draft}/{entity}")
        told[entity] = seen.get
    rules = {"repeated": "rows repeat an id", "unnamed": "rows have no positive id", "dangling": "keys name nothing"}
    findings = [(entity, "states are outside their domain" if (entity, key) == ("state", "dangling") else what, got[key]) for entity, got in told.items() for key, what in rules.items() if got[key]]
    dims = reconcile.duplicate_ids(address=tables["addresses"], geofence=tables["geofences"]).groupBy("entity").count()
    findings += [(r.entity, "ids are repeated or not positive", r["count"]) for r in dims.collect()]
    if car_id is not None and not told["car"]["kept"]:
        findings.append(("car", "rows of the selected car", 0))
    if findings:
        commits.dropped(spark, draft)
        raise Refused(findings)
    counts = {counter: told[entity]["kept" if kept else "left"] for counter, (entity, kept) in COUNTERS.items()}
    total = sum(got["kept"] for got in told.values())
    report = spark.createDataFrame([*counts.items(), ("logical_rows", total)], REPORT)
    report.coalesce(1).write.parquet(f"{draft}/report")
    if not commits.renamed(spark, draft, f"{path}/{name}"):
        raise Refused([("import", f"imports are named {name} already", 1)])
    return report


def read_import(spark: SparkSession, path: str, name: str, entity: str) -> DataFrame:
    """An entity of a shown import, or its report."""
    return spark.read.parquet(f"{path}/{name}/{entity}")
