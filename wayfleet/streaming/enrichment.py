"""Enrichment with write-back: pages of candidates are resolved, answers go into the table as a commit, failures wait.

A pass takes the first candidates (id, payload) that have no answer for their present payload and whose last failure is
`RETRY_MS` old, asks for them, and keeps all answers as one pass of the attempts' log, shown by a rename to its number. Then
it commits the changed rows. An answer counts for the payload it was made for: a row that changed meanwhile keeps its new
payload and becomes a candidate again at once, a row that is gone stays gone. The commit carries the pass's number
as its tag, so a pass that died before its commit is finished by the next one, and none is committed twice.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfleet.operators.folds import settled
from wayfleet.sources import commits
from wayfleet.streaming.lifecycle import RETRY_MS

PAGE = 1000
ATTEMPT = "id long, seen string, at_ms long, resolved boolean, answer string, error string"


def witness(payload: Column) -> Column:
    return F.sha2(F.coalesce(payload, F.lit("")), 256)


def attempts(spark: SparkSession, log: str) -> DataFrame:
    """(ATTEMPT, pass): every answer and failure."""
    commits.made(spark, f"{log}/passes")
    return spark.read.schema(f"{ATTEMPT}, pass long").parquet(f"{log}/passes")


def due(candidates: DataFrame, tried: DataFrame, now_ms: int, retry_ms: int = RETRY_MS) -> DataFrame:
    """Candidates (id, payload, ...) that were never tried with this payload, or failed with it last and long enough ago."""
    last = tried.groupBy("id", "seen").agg(F.max_by(F.struct("resolved", "at_ms"), F.struct("at_ms", "resolved")).alias("last"))
    held = last.where(F.col("last.resolved") | (F.col("last.at_ms") > now_ms - retry_ms)).select("id", "seen")
    return candidates.withColumn("seen", witness(F.col("payload"))).join(held, ["id", "seen"], "left_anti")


def write_back(spark: SparkSession, table: str, log: str, entity: str, number: int, merge: Callable[[Column, Column], Column]) -> int:
    """Commits a pass's answers on the head, if that wasn't done; gives the rows changed."""
    tag = f"enrichment/{entity}/{number}"
    answers = attempts(spark, log).where((F.col("pass") == number) & F.col("resolved")).select("id", "seen", "answer")
    while not any(m.get("tag") == tag for m in commits.manifests(spark, table)):
        top = commits.head(spark, table)
        rows = commits.read(spark, table).where(F.col("entity") == entity)
        met = rows.withColumn("seen", witness(F.col("payload"))).join(answers, ["id", "seen"])
        changes = settled(met.select("entity", "id", "car_id", F.lit("upsert").alias("op"), merge(F.col("payload"), F.col("answer")).alias("payload")))
        n = changes.count()
        if not n:
            return 0
        try:
            commits.commit_delta(changes, table, top["to_seq"] + 1, top["chain"], tag)
            return n
        except commits.Stale:
            continue
    return 0


def run_pass(spark: SparkSession, table: str, log: str, entity: str, wanted: Callable[[DataFrame], DataFrame], resolve: Callable[[DataFrame], DataFrame], merge: Callable[[Column, Column], Column], now_ms: int, page: int = PAGE) -> int:
    """One pass over a table of commits; gives the rows changed, with those of a pass that it had to finish.

    wanted: the entity's rows that lack something; resolve: (id, car_id, payload) -> (id, answer, error), an answer or
    the reason of a failure each, a row without either or no row at all is a failure too; merge: payload and answer -> payload.
    """
    done = [int(n.removeprefix("pass=")) for n in commits.listed(spark, f"{log}/passes")]
    number = max(done, default=-1) + 1
    changed = write_back(spark, table, log, entity, number - 1, merge) if done else 0
    rows = wanted(commits.read(spark, table).where(F.col("entity") == entity))
    first = settled(due(rows, attempts(spark, log), now_ms).orderBy("id").limit(page).select("id", "car_id", "payload", "seen"))
    if first.isEmpty():
        return changed
    answers = resolve(first.drop("seen")).groupBy("id").agg(F.min("answer").alias("answer"), F.min("error").alias("error"))
    got = F.col("answer").isNotNull()
    error = F.when(~got, F.coalesce("error", F.lit("no answer")))
    kept = first.select("id", "seen").join(answers, "id", "left").select("id", "seen", F.lit(now_ms).cast("bigint").alias("at_ms"), got.alias("resolved"), "answer", error.alias("error"))
    draft = f"{log}/draft/{uuid.uuid4().hex}"
    kept.write.parquet(draft)
    if not commits.renamed(spark, draft, f"{log}/passes/pass={number}"):
        raise commits.Stale(f"pass {number} is taken")
    return changed + write_back(spark, table, log, entity, number, merge)
