"""Ordered folds: a state walks each key's sorted rows, a batch of them at a time."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def walked(rows: DataFrame, keys: list[str], order: list[str], step: Callable[[tuple | None, tuple], tuple[tuple, object]], columns: list[str], out: str, kind: str) -> DataFrame:
    """rows with a column `out` (a Spark type) that step gives from a key's state (None at first) and a row's columns.

    Rows of a key are in one task in order, and only its state and an Arrow batch are held; so keys should be short
    stretches where the rule allows to cut.
    """
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for b in batches:
            given = zip(*(b.column(c).to_pylist() for c in keys), strict=True)
            found = []
            for key, row in zip(given, zip(*(b.column(c).to_pylist() for c in columns), strict=True), strict=True):
                if key != at:
                    at, state = key, None
                state, value = step(state, row)
                found.append(value)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.int64() if kind == "long" else pa.bool_())], names=[*names, out])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, f"{fields}, `{out}` {kind}")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir). Where it is unset, a local master gets a folder of its own; a cluster is refused."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    sc = spark.sparkContext
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own_folder(sc.applicationId)


@lru_cache(maxsize=4)
def _own_folder(application: str) -> str:
    return tempfile.mkdtemp(prefix=application)


def held(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, whose size Spark knows when it plans what reads it. (Unions of checkpoints that are joined with what came of them fail in the optimiser's constraints.)"""
    path = f"{shared_folder(df.sparkSession)}/held/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, rows: int, *keys: str, per: int = 25_000) -> DataFrame:
    """df by keys in partitions of about `per` of its rows. They stay apart, however small their shuffle is: adaptive execution joins partitions by their compressed bytes, which say little where keys compress well or rows grow wide afterwards."""
    return df.repartition(max(1, -(-rows // per)), *keys)


def settled(df: DataFrame) -> DataFrame:
    """A reliable checkpoint; partitions and their order stay as they are."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
