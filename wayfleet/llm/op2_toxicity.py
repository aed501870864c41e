"""Toxicity scores of whole texts by a bidirectional gated recurrent network.

The network (see gru.py) is trained in numpy on the driver, on a sample of labelled rows bounded by
`PER_LABEL` rows of label 1, twice as many of label 0, and `MAX_CHARS` characters a row; which rows is
decided by a hash of doc_id. Only rows that `train` holds true for may be in it. Spark then scores all
overlapping windows of every text in Arrow batches; a text's score is its largest window's.

Defined results: texts without words, null ones included, get 0; labels other than 0 and 1, and null
ones, are left out; several labels of one doc_id count as their largest; of several rows of one doc_id
the least text is learnt from; without labelled rows of both kinds every score is 0; a null doc_id is held
out where its empty text's crc says so; other columns are kept, but for score and predicted; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfleet.llm import gru
from wayfleet.llm.common import crc_mod, give_back, only, slices, texts

PER_LABEL, MAX_CHARS, THRESHOLD = 1200, 20_000, 0.7


def fitted(docs: DataFrame, labels: DataFrame, train: Column) -> gru.Network | None:
    """The network of a bounded sample; None where one label has no rows."""
    known = only(labels, doc_id="long", toxic="int").where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(train)
    picked = [known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(PER_LABEL * (2 - y)) for y in (0, 1)]
    picked = picked[0].unionByName(picked[1])  # 3 * PER_LABEL rows of two numbers at most
    rows = only(docs, doc_id="long", text="string").where(F.length("text") <= MAX_CHARS).join(F.broadcast(picked), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))  # a row for each picked doc_id at most
    held = sorted((r["doc_id"], r["text"], r["toxic"]) for r in rows.collect())
    y = np.array([r[2] for r in held], dtype=np.int64)
    if not len(y) or y.min() == y.max():
        return None
    lowered = texts(pa.RecordBatch.from_arrays([pa.array([r[1] for r in held], pa.string())], names=["text"]), lower=True)
    return gru.trained(lowered.to_pylist(), y)


def toxicity(docs: DataFrame, labels: DataFrame, train: Column | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """docs with score and predicted: train is a condition on doc_id for rows to learn from (default: all)."""
    shared = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels, F.lit(True) if train is None else train))
    give_back()  # the training's memory
    kept = [f for f in docs.schema.fields if f.name not in ("score", "predicted")]
    names = [f.name for f in kept] + ["score", "predicted"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for b in slices(batches):
            score = gru.scores(net, texts(b, lower=True)) if net else np.zeros(b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=names)

    schema = T.StructType([*kept, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return docs.select(*[F.col(f"`{f.name}`") for f in kept]).mapInArrow(run, schema)


def learnable() -> Column:
    """The contract's training rows: crc32 of the doc_id as text, modulo 3, isn't 1."""
    return crc_mod("doc_id", 3) != 1
