"""A table of snapshots and deltas whose readers see whole commits only.

`data/pack=<id>` holds what a writer staged, `log/<number>.json` the manifests. A writer stages its rows, validates them, and
publishes a manifest that names its parent by renaming it to the log's next number, which fails if another writer took it:
of two writers on one parent one wins, the other gets `Stale` and starts again from the new head. A writer that dies before that
leaves staged rows that no manifest names; readers stay on the head, and `leftovers` lists them.

Manifests form a chain: a pack's digest is of its rows' hash trees, the chain digest of the parent's and the pack's (F23). A
compaction is a commit too; its manifest replaces the deltas behind its anchor.
"""

from __future__ import annotations

import errno
import hashlib
import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfleet.operators import cdc, merkle
from wayfleet.operators.cdc import MOST_PACKS, PACK_BYTES, PACK_ROWS

CHANGE = "entity string, id long, car_id long, op string, payload string, seq long"


class Stale(Exception):
    """Another commit came first; the head has moved."""


def _files(spark: SparkSession, path: str):
    jvm, sc = spark.sparkContext._jvm, spark.sparkContext
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(sc._jsc.hadoopConfiguration())


def listed(spark: SparkSession, path: str) -> list[str]:
    where, fs = _files(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


def manifests(spark: SparkSession, path: str) -> list[dict]:
    """All commits in order: some hundred short rows."""
    if not any(n.endswith(".json") for n in listed(spark, f"{path}/log")):
        return []
    rows = spark.read.option("wholetext", True).option("pathGlobFilter", "*.json").text(f"{path}/log").collect()
    return sorted((json.loads(r.value) for r in rows), key=lambda m: m["number"])


def live(log: list[dict]) -> list[dict]:
    """The base and the deltas that hold, of all commits: a base drops what was before, a compaction the deltas behind its anchor."""
    out: list[dict] = []
    for m in log:
        out = [] if m["kind"] == "base" else [x for x in out if x["kind"] == "base" or x["to_seq"] <= m["from_seq"]]
        out.append(m)
    return out


def head(spark: SparkSession, path: str) -> dict | None:
    held = live(manifests(spark, path))
    return held[-1] if held else None


def pack_digest(changes: DataFrame) -> tuple[str, int]:
    """Digest of a pack's rows by their trees, and their number."""
    text = [F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in ("id", "car_id", "op", "payload")]
    rows = changes.select("entity", "id", F.sha2(F.concat_ws("\x1f", *text), 256).alias("digest"))
    roots = sorted((r.entity, r.n, r.fingerprint) for r in merkle.roots(merkle.hash_tree(rows, ["entity"]), ["entity"]).collect())  # a row for each entity
    return hashlib.sha256("\n".join(f"{e}:{n}:{h}" for e, n, h in roots).encode()).hexdigest(), sum(n for _, n, _ in roots)


def chained(parent: str, pack: str) -> str:
    return hashlib.sha256(f"delta-v2/{parent}:{pack}".encode()).hexdigest()


def stage(changes: DataFrame, path: str) -> str:
    """Writes rows beside the others under a new id; no reader sees them yet."""
    id = uuid.uuid4().hex
    changes.select(*[c.split()[0] for c in CHANGE.split(", ")]).sortWithinPartitions("entity", "id").write.partitionBy("entity").parquet(f"{path}/data/pack={id}")
    return id


def staged(spark: SparkSession, path: str, *ids: str) -> DataFrame:
    """The rows of packs."""
    return spark.read.schema(f"{CHANGE}, pack string").option("basePath", f"{path}/data").parquet(*[f"{path}/data/pack={id}" for id in ids]).drop("pack")


def made(spark: SparkSession, path: str) -> None:
    where, fs = _files(spark, path)
    fs.mkdirs(where)


def dropped(spark: SparkSession, draft: str) -> None:
    where, fs = _files(spark, draft)
    fs.delete(where, True)


def renamed(spark: SparkSession, draft: str, target: str) -> bool:
    """Shows a draft (a file, or a folder with files) under its name in one step without overwriting; False, and no draft left, where the name is taken.

    A shared file system's rename is one step that refuses a taken name. A local one's is not; there a file is linked, and a folder moved, which
    no folder with files lets happen to it.
    """
    jvm = spark.sparkContext._jvm
    (source, fs), (where, _) = _files(spark, draft), _files(spark, target)
    try:
        if fs.getUri().getScheme() == "file":
            here, there = source.toUri().getPath(), where.toUri().getPath()
            (os.rename if os.path.isdir(here) else os.link)(here, there)
        else:
            files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
            how = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
            how[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
            files.rename(source, where, how)
    except Exception as e:
        if getattr(e, "errno", None) in (errno.EEXIST, errno.ENOTEMPTY) or "FileAlreadyExists" in str(e):
            return False
        raise
    finally:
        fs.delete(source, True)
    return True


def publish(spark: SparkSession, path: str, manifest: dict) -> dict:
    """Makes a manifest the log's entry of its number, or raises Stale if there is one."""
    made(spark, f"{path}/log")
    draft = f"{path}/draft/{uuid.uuid4().hex}"
    where, fs = _files(spark, draft)
    out = fs.create(where, False)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    if not renamed(spark, draft, f"{path}/log/{manifest['number']:020d}.json"):
        raise Stale(f"commit {manifest['number']} is taken")
    return manifest


def _checked(changes: DataFrame, parent: str | None) -> None:
    wrong = cdc.validate_delta(changes, parent).limit(5).collect()
    if wrong:
        raise ValueError(f"the rows break their contract: {wrong}")


def commit_snapshot(rows: DataFrame, path: str, seq: int, violations: DataFrame | None = None) -> dict:
    """A base (entity, id, car_id, payload) under a sequence. violations: what the snapshot's contract found; any stops the commit."""
    spark = rows.sparkSession
    wrong = violations.limit(5).collect() if violations is not None else []
    if wrong:
        raise ValueError(f"the snapshot breaks its contract: {wrong}")
    log = manifests(spark, path)
    id = stage(rows.select("entity", "id", "car_id", F.lit("upsert").alias("op"), "payload", F.lit(seq).cast("bigint").alias("seq")), path)
    digest, n = pack_digest(staged(spark, path, id))
    return publish(spark, path, {"number": len(log), "kind": "base", "data": id, "from_seq": seq, "to_seq": seq, "parent": cdc.ZERO, "digest": digest, "chain": digest, "rows": n})


def commit_delta(changes: DataFrame, path: str, to_seq: int, parent: str, tag: str | None = None) -> dict:
    """Changes behind the head as its next delta, under to_seq. parent: the chain digest of the head they were made on; tag: names the commit, so that a repeat can be told."""
    spark = changes.sparkSession
    log = manifests(spark, path)
    held = live(log)
    if not held:
        raise ValueError("a delta needs a base")
    if held[-1]["chain"] != parent:
        raise Stale("the head has moved")
    if to_seq <= held[-1]["to_seq"]:
        raise ValueError("a delta goes forward")
    if len(held) + 1 > MOST_PACKS:
        raise ValueError(f"over {MOST_PACKS} packs: compact first")
    id = stage(changes.withColumn("seq", F.lit(to_seq).cast("bigint")), path)
    kept = staged(spark, path, id)
    digest, n = pack_digest(kept)
    if not n:
        raise ValueError("a delta has at least one change")
    if n > PACK_ROWS:
        raise ValueError(f"{n} rows, over {PACK_ROWS}")
    _checked(kept, parent)
    return publish(spark, path, {"number": len(log), "kind": "delta", "data": id, "from_seq": held[-1]["to_seq"], "to_seq": to_seq, "parent": parent, "digest": digest, "chain": chained(parent, digest), "rows": n, "tag": tag})


def read(spark: SparkSession, path: str, at_seq: int | None = None) -> DataFrame:
    """(entity, id, car_id, payload) at the head, or after the last commit up to a sequence."""
    held = [m for m in live(manifests(spark, path)) if at_seq is None or m["to_seq"] <= at_seq]
    if not held:
        raise ValueError("no commit yet")
    base = staged(spark, path, held[0]["data"]).select("entity", "id", "car_id", "payload")
    if len(held) == 1:
        return base
    return cdc.apply_deltas(base, staged(spark, path, *[m["data"] for m in held[1:]]))


def lineage(spark: SparkSession, path: str, car_id: int = 0) -> tuple[DataFrame, DataFrame]:
    """The live packs and the head, as cdc.lineage_check reads them."""
    held = live(manifests(spark, path))
    packs = [(car_id, "base" if m["kind"] == "base" else "delta", i if m["kind"] == "base" else None, m["from_seq"], m["to_seq"], m["parent"], m["chain"], m["digest"], m["data"], m["rows"], m["rows"]) for i, m in enumerate(held)]
    heads = [(car_id, held[0]["to_seq"], held[0]["digest"], held[-1]["to_seq"], held[-1]["chain"])]
    return spark.createDataFrame(packs, cdc.PACKS), spark.createDataFrame(heads, cdc.HEADS)


def compact(spark: SparkSession, path: str, most: int = MOST_PACKS, max_rows: int = PACK_ROWS, max_bytes: int = PACK_BYTES) -> dict | None:
    """If the packs come near `most`, the longest run of last deltas whose changes fit into one pack becomes one delta; None where nothing is due, or what is due doesn't fit and slots remain."""
    log = manifests(spark, path)
    held = live(log)
    packs = [(0, "base" if m["kind"] == "base" else "delta", m["from_seq"], m["to_seq"], m["parent"], m["chain"], m["rows"]) for m in held]
    sized = spark.createDataFrame(packs, "car_id long, kind string, from_seq long, to_seq long, parent string, chain string, rows long")
    names = {m["to_seq"]: m["data"] for m in held if m["kind"] != "base"}
    if names:
        text = F.octet_length(F.coalesce("payload", F.lit("")))
        weights = staged(spark, path, *names.values()).groupBy(F.col("seq").alias("to_seq")).agg(F.sum(text).alias("bytes"))
        sized = sized.join(weights, "to_seq", "left").fillna(0, ["bytes"])
    else:
        sized = sized.withColumn("bytes", F.lit(0).cast("bigint"))
    plan = cdc.compaction_plan(sized, most, max_rows, max_bytes).first()
    if plan.action == "exhausted":
        raise ValueError(f"over {most} packs, and no two last deltas fit into one")
    if plan.action != "compact":
        return None
    tail = staged(spark, path, *[d for s, d in names.items() if s > plan.anchor_seq])
    id = stage(cdc.last_changes(tail).withColumn("seq", F.lit(plan.head_seq).cast("bigint")), path)
    digest, n = pack_digest(staged(spark, path, id))
    return publish(spark, path, {"number": len(log), "kind": "compact", "data": id, "from_seq": plan.anchor_seq, "to_seq": plan.head_seq, "parent": plan.anchor_digest, "digest": digest, "chain": chained(plan.anchor_digest, digest), "rows": n})


def leftovers(spark: SparkSession, path: str) -> list[str]:
    """Staged ids that no manifest names: of writers at work, or dead ones."""
    return sorted({n.removeprefix("pack=") for n in listed(spark, f"{path}/data")} - {m["data"] for m in manifests(spark, path)})
