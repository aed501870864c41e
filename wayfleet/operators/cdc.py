"""Change capture between versions, deltas, replay, compaction, and the lineage of published packs.

A version is (entity, id, car_id, digest[, payload]); a change feed is (entity, id, car_id, op, payload, seq).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import pairwise
from operator import or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayfleet.functions.scalars import chain_digest, valid_coordinates
from wayfleet.operators.folds import settled
from wayfleet.operators.reconcile import ENTITY_RANK, rank_of, stage_of

KEY = ["entity", "id"]
ZERO = "0" * 64
# What the protocol allows a pack and a lineage, and the slots that are kept free.
PACK_ROWS, PACK_BYTES, MOST_PACKS, SPARE_PACKS = 1_000_000, 256 << 20, 512, 8
PACKS = "car_id long, kind string, ordinal long, from_seq long, to_seq long, parent string, chain string, digest string, pack string, rows long, declared_rows long"
HEADS = "car_id long, base_seq long, base_digest string, head_seq long, head_digest string"


def classify_changes(prior: DataFrame | None, current: DataFrame) -> DataFrame:
    """current with status: captured (no prior version at all), unchanged, new or changed. Only digests are joined."""
    if prior is None:
        return current.withColumn("status", F.lit("captured"))
    before = prior.select(*KEY, F.col("digest").alias("_digest"))
    status = F.when(F.col("_digest").isNull(), "new").when(F.col("_digest") == F.col("digest"), "unchanged").otherwise("changed")
    return current.join(before, KEY, "left").withColumn("status", status).drop("_digest")


def tombstones(prior: DataFrame, current: DataFrame) -> DataFrame:
    """(entity, id, car_id) of prior keys that are gone; never of a car."""
    return prior.where("entity <> 'car'").join(current.select(*KEY), KEY, "left_anti").select("entity", "id", "car_id")


def build_delta(prior: DataFrame, current: DataFrame, seq: int) -> DataFrame:
    """The change feed from one version to the next: payloads of new and changed rows, and tombstones."""
    up = classify_changes(prior, current).where("status in ('new', 'changed')").select(*KEY, "car_id", F.lit("upsert").alias("op"), "payload")
    down = tombstones(prior, current).select(*KEY, "car_id", F.lit("delete").alias("op"), F.lit(None).cast("string").alias("payload"))
    return up.unionByName(down).withColumn("seq", F.lit(seq).cast("bigint"))


def validate_delta(delta: DataFrame, parent: str | None = None) -> DataFrame:
    """(rule, entity, id) of each breach: ids not positive, keys twice, more than one car per feed's sequence, deleted cars, upserts without payload, a parent digest of zeros, and payloads (JSON) with an interval, level or coordinates out of bounds."""
    def breach(rows: DataFrame, rule: str) -> DataFrame:
        return rows.select(F.lit(rule).alias("rule"), "entity", F.col("id").cast("bigint").alias("id"))

    keys = delta.groupBy("seq", *KEY).agg(F.count("*").alias("n"), F.count_distinct("op").alias("ops"))
    cars = delta.groupBy("seq").agg(F.count_distinct("car_id").alias("n")).where("n > 1").select(F.lit("one car").alias("rule"), F.lit(None).cast("string").alias("entity"), F.col("seq").alias("id"))
    levels = ["start_soc", "end_soc", "battery_level", "usable_battery_level", "start_battery_level", "end_battery_level"]
    spots = [(f"{e}latitude", f"{e}longitude") for e in ("", "start_", "end_")]
    names = ["start_ms", "end_ms", *levels, *(c for spot in spots for c in spot)]
    field = lambda name: F.col(f"_{name}")
    read = delta.select("*", F.json_tuple("payload", *names).alias(*[f"_{c}" for c in names])).withColumns({f"_{c}": field(c).try_cast("double") for c in names})  # a payload is parsed once
    wrong = lambda lat, lon: (lat.isNotNull() | lon.isNotNull()) & ~valid_coordinates(lat, lon, no_origin=True)
    rules = [
        ("positive id", ~F.coalesce(F.col("id") > 0, F.lit(False))),
        ("deleted car", (F.col("op") == "delete") & (F.col("entity") == "car")),
        ("payload missing", (F.col("op") == "upsert") & F.col("payload").isNull()),
        ("forward sequence", ~F.coalesce(F.col("seq") > 0, F.lit(False))),
        ("parent digest", F.lit(parent == ZERO)),
        ("interval", field("end_ms") < field("start_ms")),
        ("soc", reduce(or_, [F.coalesce(~x.between(0, 100), F.lit(False)) for x in map(field, levels)])),
        ("coordinates", reduce(or_, [wrong(*map(field, x)) for x in spots])),
    ]
    broken = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in rules]))
    out = read.select(F.explode(broken).alias("rule"), "entity", F.col("id").cast("bigint").alias("id"))
    for rows, rule in ((keys.where("ops > 1"), "upsert and delete"), (keys.where("n > 1 and ops = 1"), "key twice")):
        out = out.unionByName(breach(rows, rule))
    return out.unionByName(cars)


def last_changes(feed: DataFrame) -> DataFrame:
    """The last operation of each key."""
    return feed.groupBy(*KEY).agg(F.max_by(F.struct("car_id", "op", "payload", "seq"), "seq").alias("last")).select(*KEY, "last.*")


def apply_deltas(base: DataFrame, deltas: DataFrame, at_seq: int | None = None) -> DataFrame:
    """(entity, id, car_id, payload) of the base after all deltas up to a sequence; a key that no delta names stays."""
    feed = deltas if at_seq is None else deltas.where(F.col("seq") <= at_seq)
    start = base.select(*KEY, "car_id", F.lit("upsert").alias("op"), "payload", F.lit(-1).cast("bigint").alias("seq"))
    return last_changes(start.unionByName(feed.select(*start.columns))).where("op = 'upsert'").select(*KEY, "car_id", "payload")


def compact(deltas: DataFrame, after_seq: int) -> DataFrame:
    """The feed with all deltas behind a sequence as one, under its last sequence."""
    tail = deltas.where(F.col("seq") > after_seq)
    last = tail.agg(F.max("seq").alias("_top"))
    one = last_changes(tail).crossJoin(F.broadcast(last)).withColumn("seq", F.col("_top")).drop("_top")
    return deltas.where(F.col("seq") <= after_seq).unionByName(one.select(*deltas.columns))


def laid_out(changes: DataFrame, by: str, order: str, size: str) -> DataFrame:
    """changes in ranges of (by, order), with _part, _n and _b: range, and rows and bytes of the same `by` ahead of each.

    Partitions are counted first; the rows ahead of a partition go to the tasks only for the `by` that it goes on
    with, one number a partition.
    """
    laid = settled(changes.repartitionByRange(by, order).sortWithinPartitions(by, order).withColumn("_part", F.spark_partition_id()))
    totals = laid.groupBy(by, "_part").agg(F.count("*").alias("n"), F.sum(size).alias("b"))
    w = W.partitionBy(by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    ahead = totals.select(by, "_part", F.sum("n").over(w).alias("n"), F.sum("b").over(w).alias("b")).where("n > 0")
    start = {(r[by], r["_part"]): (r["n"], int(r["b"])) for r in ahead.collect()}  # a row for each partition at most
    names = laid.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, n, b = None, 0, 0
        for batch in batches:
            rows, total = [], []
            for key, part, own in zip(batch.column(by).to_pylist(), batch.column("_part").to_pylist(), batch.column(size).to_pylist(), strict=True):
                if (key,) != at:
                    at, (n, b) = (key,), start.get((key, part), (0, 0))
                rows.append(n)
                total.append(b)
                n, b = n + 1, b + own
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, pa.int64()), pa.array(total, pa.int64())], names=[*names, "_n", "_b"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in laid.schema.fields)
    return laid.mapInArrow(run, f"{fields}, _n long, _b long")


def _groups(batches: Iterator[pa.RecordBatch], by: str) -> Iterator[tuple[int, object, np.ndarray, np.ndarray, np.ndarray, int]]:
    """Rows (to, by, n, b, size, own) in order -> of each (to, by): to, by, n, b, the bytes behind each row, and how many rows are its own."""
    at, held = None, []

    def whole() -> tuple:
        n, b, size, own = (np.concatenate([h[i] for h in held]) for i in range(4))
        return *at, n, b, b + size, int(own.sum())

    for batch in batches:
        keys = list(zip(batch.column("to").to_pylist(), batch.column(by).to_pylist(), strict=True))
        columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("n", "b", "size", "own")]
        cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
        for lo, hi in pairwise(cuts):
            if lo < hi:
                if held and keys[lo] != at:
                    yield whole()
                    held = []
                at = keys[lo]
                held.append([c[lo:hi] for c in columns])
    if held:
        yield whole()


def _follows(n: np.ndarray, b: np.ndarray, e: np.ndarray, max_rows: int, max_bytes: int) -> np.ndarray:
    """For a batch that starts at each row, the row that starts the next one."""
    return np.minimum(np.searchsorted(n, n + max_rows), np.searchsorted(e, b + max_bytes, side="right"))


def batch_starts(laid: DataFrame, by: str, size: str, max_rows: int, max_bytes: int) -> DataFrame:
    """laid_out()'s rows -> (by, batch, n, b, n_to, b_to): of each greedy batch its number, and its first and end by rows and bytes ahead.

    What starts a batch depends on the batch before, so the walk is cut up: each range, given also the rows behind it
    that a batch from it may reach, finds for every row that a batch from before may start at the first start behind
    the range. These steps are squared (two steps, four, ...), and what is reached from each `by`'s first row are the true
    entries, one a range and `by` at most. From these all ranges walk side by side.
    """
    kind = laid.schema[by].dataType.simpleString()
    ends = laid.groupBy(by, "_part").agg(F.max("_n").alias("n"), F.max("_b").alias("b"))
    ends = ends.withColumn("_parts", F.count("*").over(W.partitionBy(by))).where("_parts > 1")
    ranges: dict[object, list[tuple[int, int, int]]] = {}
    for r in ends.collect():  # two rows for each partition at most
        ranges.setdefault(r[by], []).append((r["_part"], r["n"], int(r["b"])))
    shared = laid.sparkSession.sparkContext.broadcast({k: sorted(v, reverse=True) for k, v in ranges.items()})

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, n, b = (batch.column(c).to_numpy() for c in ("_part", "_n", "_b"))
            takes, to = [np.arange(batch.num_rows)], [part]
            for key in set(batch.column(by).to_pylist()) & shared.value.keys():
                at = np.flatnonzero(pc.equal(batch.column(by), key).to_numpy(zero_copy_only=False))
                for p, last_n, last_b in shared.value[key]:
                    more = at[(part[at] > p) & (n[at] <= last_n + max_rows) & (b[at] <= last_b + max_bytes)]
                    takes.append(more)
                    to.append(np.full(len(more), p))
            take, to = np.concatenate(takes), np.concatenate(to)
            own = np.arange(len(take)) < batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(to.astype(np.int32)), batch.column(by).take(pa.array(take)), *(batch.column(c).take(pa.array(take)) for c in ("_n", "_b")), batch.column(size).take(pa.array(take)).cast(pa.int64()), pa.array(own)], names=["to", by, "n", "b", "size", "own"])

    narrow = laid.select(by, "_part", "_n", "_b", size).mapInArrow(spread, f"to int, `{by}` {kind}, n long, b long, size long, own boolean")
    near = settled(narrow.repartition("to").sortWithinPartitions("to", by, "n"))

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, key, n, b, e, own in _groups(batches, by):
            if key in shared.value:
                out = np.append(_follows(n, b, e, max_rows, max_bytes)[:own], np.arange(own, len(n) + 1))
                while (out[:own] < own).any():
                    out = out[out]
                entry = np.flatnonzero((n[:own] - n[0] <= max_rows) & (b[:own] - b[0] <= max_bytes) & (out[:own] < len(n)))
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(entry), laid_type), pa.array(n[entry]), pa.array(n[out[entry]])], names=[by, "a", "b"])

    laid_type = laid.select(by).limit(0).toArrow().schema.field(0).type
    jumps = [settled(near.mapInArrow(steps, f"`{by}` {kind}, a long, b long"))]
    while not jumps[-1].isEmpty():
        jumps.append(settled(jumps[-1].join(jumps[-1].toDF(by, "b", "c"), [by, "b"]).select(by, "a", F.col("c").alias("b"))))
    reached = jumps[0].where("a = 0").select(by, F.col("a").alias("at")).distinct()
    for jump in reversed(jumps[:-1]):
        reached = settled(reached.unionByName(reached.join(jump.withColumnRenamed("a", "at"), [by, "at"]).select(by, F.col("b").alias("at"))).distinct())
    entries: dict[object, set[int]] = {}
    for r in reached.collect():  # one for each partition and `by` that goes on there
        entries.setdefault(r[by], set()).add(r["at"])
    known = laid.sparkSession.sparkContext.broadcast(entries)

    def starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for to, key, n, b, e, own in _groups(batches, by):
            follows = _follows(n, b, e, max_rows, max_bytes)
            if key in shared.value:
                at = next((i for i, x in enumerate(n[: min(own, max_rows + 1)].tolist()) if not x or x in known.value.get(key, ())), own)
            else:
                at = 0
            found = []
            while at < own:
                behind = int(follows[at])
                end = (int(n[behind]), int(b[behind])) if behind < len(n) else (int(n[-1]) + 1, int(e[-1]))
                found.append((key, to, len(found), int(n[at]), int(b[at]), *end))
                at = behind
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), [laid_type, pa.int32(), *[pa.int64()] * 5], strict=True)], names=[by, "to", "k", "n", "b", "n_to", "b_to"])

    rows = settled(near.mapInArrow(starts, f"`{by}` {kind}, to int, k long, n long, b long, n_to long, b_to long"))
    w = W.partitionBy(by).orderBy("to").rowsBetween(W.unboundedPreceding, -1)
    before = rows.groupBy(by, "to").agg(F.count("*").alias("own")).select(by, "to", F.coalesce(F.sum("own").over(w), F.lit(0)).alias("first"))
    return settled(rows.join(before, [by, "to"]).select(by, (F.col("first") + F.col("k")).alias("batch"), "n", "b", "n_to", "b_to"))


def batched(laid: DataFrame, starts: DataFrame, by: str, max_rows: int, max_bytes: int) -> DataFrame:
    """laid_out()'s rows with batch. Rows and batches meet in cells of max_rows rows and max_bytes bytes ahead, of which a batch touches four at most and which touch a few batches."""
    cell = lambda a, b, size: F.explode(F.sequence(F.expr(f"{a} div {size}"), F.expr(f"{b} div {size}")))
    cells = starts.withColumn("_r", cell("n", "(n_to - 1)", max_rows)).withColumn("_c", cell("b", "b_to", max_bytes))
    rows = laid.withColumns({"_r": F.expr(f"_n div {max_rows}"), "_c": F.expr(f"_b div {max_bytes}")})
    return rows.join(cells, [by, "_r", "_c"]).where("_n >= n and _n < n_to").drop("_r", "_c", "n", "b", "n_to", "b_to", "_n", "_b", "_part")


def batch_changes(changes: DataFrame, max_rows: int = 50_000, max_bytes: int = 8 << 20, by: str = "entity", order: str = "id", size: str = "bytes") -> DataFrame:
    """changes with batch: numbers from 0 of bounded batches in key order, per `by`; a row over the byte cap stops the job.

    Batches are greedy: each takes rows as long as both caps hold.
    """
    changes = changes.where(F.assert_true(F.col(size) <= max_bytes, "a row is over the byte cap").isNull())
    laid = laid_out(changes, by, order, size)
    return batched(laid, batch_starts(laid, by, size, max_rows, max_bytes), by, max_rows, max_bytes)


def fragment_with_parents(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """(fragment, parent's columns): each fragment's parents once. children: (fragment, key)."""
    need = children.where(F.col(key).isNotNull()).select("fragment", F.col(key).alias("id")).distinct()
    return need.join(parents, "id")


def tables_in_delta(delta: DataFrame) -> DataFrame:
    """(entity, n, rank) of the entities with rows, tombstones under 'tombstone', in order of dependency."""
    name = F.when(F.col("op") == "delete", "tombstone").otherwise(F.col("entity"))
    return delta.groupBy(name.alias("entity")).agg(F.count("*").alias("n")).withColumn("rank", stage_of("entity")).orderBy("rank", "entity")


def skip_unchanged(prior: DataFrame, current: DataFrame) -> DataFrame:
    """current (car_id, fingerprint) without the cars whose fingerprint is the prior one."""
    return current.join(prior.select("car_id", "fingerprint"), ["car_id", "fingerprint"], "left_anti")


def lineage_check(packs: DataFrame, heads: DataFrame, most: int = MOST_PACKS, pack_rows: int = PACK_ROWS) -> DataFrame:
    """(car_id, rule, to_seq) of each breach in packs (PACKS) under heads (HEADS).

    A car has a base of one pack or more, numbered from 0 and all of the base's sequence, and a digest of it. Its deltas go on
    from there without gaps, each with the chain digest before it as parent and its own after it, to the head. No pack comes twice,
    none is larger than declared or allowed, and their number and rows stay within what the protocol allows (to_seq null).
    """
    place = W.partitionBy("car_id", "kind").orderBy("to_seq", "ordinal")
    rows = packs.join(heads, "car_id", "left").withColumns({"_to": F.lag("to_seq").over(place), "_chain": F.lag("chain").over(place), "_n": F.row_number().over(place) - 1, "_next": F.lead("to_seq").over(place)})
    rows = rows.withColumn("_twice", F.count("*").over(W.partitionBy("car_id", "pack")))
    base, delta = F.col("kind") == "base", F.col("kind") == "delta"
    last = delta & F.col("_next").isNull()
    rules = [
        ("no head", F.col("base_seq").isNull()),
        ("base pack", base & ((F.col("from_seq") != F.col("base_seq")) | (F.col("to_seq") != F.col("base_seq")) | ~F.col("ordinal").eqNullSafe(F.col("_n").cast("bigint")))),
        ("contiguous", delta & (F.col("from_seq") != F.coalesce("_to", "base_seq"))),
        ("forward", delta & (F.col("to_seq") <= F.col("from_seq"))),
        ("parent digest", delta & (F.col("parent") != F.coalesce("_chain", "base_digest"))),
        ("chain digest", delta & (F.col("chain") != chain_digest(F.col("parent"), F.col("digest")))),
        ("unique pack", F.col("_twice") > 1),
        ("declared rows", F.col("rows") != F.col("declared_rows")),
        ("pack rows", F.col("rows") > pack_rows),
        ("head", last & ((F.col("to_seq") != F.col("head_seq")) | (F.col("chain") != F.col("head_digest")))),
    ]
    found = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in rules]))
    each = rows.select("car_id", F.explode(found).alias("rule"), "to_seq")
    totals = packs.groupBy("car_id").agg(F.count("*").alias("n"), F.sum("rows").alias("total"), F.count_if(base).alias("bases"), F.count_if(delta).alias("deltas"))
    cars = heads.join(totals, "car_id", "left").fillna(0, ["n", "total", "bases", "deltas"])
    whole = [
        ("base", F.col("bases") == 0),
        ("base digest", F.coalesce(F.col("base_digest") == ZERO, F.lit(True))),
        ("too many packs", F.col("n") > most),
        ("too many rows", F.col("total") > pack_rows * most),
        ("head", (F.col("deltas") == 0) & ((F.col("head_seq") != F.col("base_seq")) | (F.col("head_digest") != F.col("base_digest")))),
    ]
    found = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in whole]))
    return each.unionByName(cars.select("car_id", F.explode(found).alias("rule"), F.lit(None).cast("bigint").alias("to_seq")))


def compaction_plan(packs: DataFrame, most: int = MOST_PACKS, max_rows: int = PACK_ROWS, max_bytes: int = PACK_BYTES) -> DataFrame:
    """(car_id, action, anchor_seq, anchor_digest, head_seq, replaced, rows, bytes) of packs (car_id, kind, from_seq, to_seq, parent, chain, rows, bytes).

    A lineage that with one pack more has over most - SPARE_PACKS of them is due: the longest run of its last deltas, two or more,
    whose sums of rows and bytes fit into one pack becomes one delta behind its anchor ('compact'). If none fits, it waits while a slot
    is free ('defer'), else it is 'exhausted'. Others: 'none'. A lineage has `most` packs or about that many, so windows are short.
    """
    back = W.partitionBy("car_id").orderBy(F.desc("to_seq"))
    counts = packs.groupBy("car_id").agg(F.count("*").alias("n"), F.max("to_seq").alias("head_seq"))
    tail = packs.where("kind <> 'base'").withColumns({"_rows": F.sum("rows").over(back), "_bytes": F.sum("bytes").over(back), "_k": F.row_number().over(back)})
    fits = tail.where((F.col("_rows") <= max_rows) & (F.col("_bytes") <= max_bytes) & (F.col("_k") >= 2))
    best = fits.groupBy("car_id").agg(F.max("_k").alias("replaced"), *[F.max_by(c, "_k").alias(n) for c, n in (("from_seq", "anchor_seq"), ("parent", "anchor_digest"), ("_rows", "rows"), ("_bytes", "bytes"))])
    due = F.col("n") + 1 > most - min(most, SPARE_PACKS)
    action = F.when(~due, "none").when(F.col("replaced").isNotNull(), "compact").when(F.col("n") + 1 <= most, "defer").otherwise("exhausted")
    planned = lambda c: F.when(F.col("action") == "compact", F.col(c)).alias(c)
    return counts.join(best, "car_id", "left").withColumn("action", action).select("car_id", "action", *map(planned, ("anchor_seq", "anchor_digest", "head_seq", "replaced", "rows", "bytes")))


def tombstones_in_order(rows: DataFrame) -> DataFrame:
    return rows.orderBy(rank_of("entity", ENTITY_RANK), "id")
