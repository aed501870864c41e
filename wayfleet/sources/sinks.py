"""Snapshots and deltas as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfleet.operators import cdc
from wayfleet.operators.cdc import MOST_PACKS, PACK_BYTES, PACK_ROWS

FRAGMENT_ROWS, FRAGMENT_BYTES = 50_000, 8 << 20


def write_snapshot(tables: dict[str, DataFrame], path: str, violations: DataFrame | None = None, rows: int = FRAGMENT_ROWS) -> None:
    """Each entity as Parquet by car and sorted by id; nothing is written if there are violations."""
    wrong = violations.limit(5).collect() if violations is not None else []
    if wrong:
        raise ValueError(f"the snapshot breaks its contract: {wrong}")
    for name, df in tables.items():
        by = ["car_id"] if "car_id" in df.columns else []
        # a range of (car, id) per task: a car with many rows spreads over several, each sorted
        spread = df.repartitionByRange(*by, "id").sortWithinPartitions(*by, "id")
        writer = spread.write.option("maxRecordsPerFile", rows)
        (writer.partitionBy(*by) if by else writer).parquet(f"{path}/{name}")


def write_delta(changes: DataFrame, path: str, seq: int, parent: str) -> None:
    """A change feed's rows under its sequence and entity, with a metadata row; an empty or invalid delta is rejected."""
    if changes.isEmpty():
        raise ValueError("a delta has at least one change")
    wrong = cdc.validate_delta(changes, parent).limit(5).collect()
    if wrong:
        raise ValueError(f"the delta breaks its contract: {wrong}")
    changes.sortWithinPartitions("entity", "id").write.partitionBy("entity").parquet(f"{path}/changes/to_seq={seq}")
    changes.agg(F.count("*").alias("rows")).select(F.lit(seq).cast("bigint").alias("to_seq"), F.lit(parent).alias("parent"), "rows").coalesce(1).write.parquet(f"{path}/lineage/to_seq={seq}")


def read_deltas(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/changes").withColumn("seq", F.col("to_seq").cast("bigint")).drop("to_seq")


def assign_fragments(df: DataFrame, by: str, order: str = "id", max_rows: int = FRAGMENT_ROWS, max_bytes: int = FRAGMENT_BYTES, most: int = MOST_PACKS) -> DataFrame:
    """df with fragment: greedy batches of rows and JSON bytes in order, per `by`; a row over the byte cap stops the job.

    Where a `by` has more fragments than `most`, both caps double, up to the protocol's; more even then stop the job. Rows are
    laid out once; each doubling looks at the sums alone.
    """
    sized = df.withColumn("bytes", F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))
    laid = cdc.laid_out(sized, by, order, "bytes")
    largest = laid.agg(F.max("bytes")).first()[0] or 0
    while True:
        if largest > max_bytes:
            raise ValueError("a row is over the byte cap")
        starts = cdc.batch_starts(laid, by, "bytes", max_rows, max_bytes)
        top = starts.agg(F.max("batch")).first()[0]
        if top is None or top < most:
            return cdc.batched(laid, starts, by, max_rows, max_bytes).withColumnRenamed("batch", "fragment").drop("bytes")
        if max_rows >= PACK_ROWS and max_bytes >= PACK_BYTES:
            raise ValueError(f"{top + 1} fragments, over {most}")
        max_rows, max_bytes = min(2 * max_rows, PACK_ROWS), min(2 * max_bytes, PACK_BYTES)
