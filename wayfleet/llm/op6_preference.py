"""Preference formatting with DataFrame functions only.

A pair sets a chosen conversation against a rejected one. Their longest common prefix of turns (equal
role and text) is rendered once as prompt; each side's other turns are its completion, in which only
assistant turns are trained on. Turns are compared in a join on pair and turn number, and the prefix
ends at the smallest number where they differ, so no conversation is gathered to compare it. What is
joined is settled first, so that joins on a crowded conversation or opening can be split.

Rendered turns are concatenated in blocks of `BLOCK` turns: one row holds up to so many turns of a
pair's part ('prompt', 'chosen' or 'rejected'), with `mask`, the spans of characters to train on. Few
conversations have more turns than one block; a very long one comes as several rows, in order of block.

Defined results: turns with null conv_id or turn are left out; null roles and texts read as empty;
several rows of one turn count as the smallest by role and text; gaps in turn numbers are kept, and a
turn that one side lacks differs; a pair of equal conversations has empty completions, which give no
rows; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfleet.llm.common import settle

BLOCK = 64
OPEN, MIDDLE, CLOSE = "<|", "|>\n", "<|end|>\n"


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text), one row per turn."""
    rows = conversations.where("conv_id is not null and turn is not null")
    one = F.min(F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))).alias("one")
    return rows.groupBy(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn")).agg(one).select("conv_id", "turn", "one.role", "one.text")


def first_turn_pairs(rows: DataFrame) -> DataFrame:
    """(pair_id, chosen, rejected): conversations that open with the same turn, each set against the one of them with the fewest turns (the smallest conv_id of those)."""
    size = settle(rows.groupBy("conv_id").agg(F.count("*").alias("n"), F.min("turn").alias("turn")))
    opening = settle(rows.join(size, ["conv_id", "turn"]).select("conv_id", "n", F.md5(F.concat_ws("\n", "role", "text")).alias("opening")))
    best = settle(opening.groupBy("opening").agg(F.min(F.struct("n", "conv_id")).alias("best"), F.count("*").alias("members")).where("members > 1"))
    return opening.join(best, "opening").where("conv_id <> best.conv_id").select(F.col("conv_id").alias("pair_id"), F.col("best.conv_id").alias("chosen"), F.col("conv_id").alias("rejected"))


def preferences(rows: DataFrame, pairs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(pair_id, part, block, first_turn, last_turn, text, mask): the rendered parts of pairs (pair_id, chosen, rejected)."""
    side = lambda name: pairs.select("pair_id", F.col(name).alias("conv_id")).join(rows, "conv_id").select("pair_id", "turn", "role", "text")
    a = side("chosen").select("pair_id", "turn", F.struct("role", "text").alias("chosen"))
    b = side("rejected").select("pair_id", "turn", F.struct("role", "text").alias("rejected"))
    both = settle(a.join(b, ["pair_id", "turn"], "full"))
    parts = both.select("pair_id", "turn", F.explode(F.array(F.struct(F.lit("chosen").alias("side"), F.col("chosen").alias("said")), F.struct(F.lit("rejected").alias("side"), F.col("rejected").alias("said")))).alias("own"), F.col("chosen").eqNullSafe(F.col("rejected")).alias("same")).where("own.said is not null")
    split = settle(both.where(~F.col("chosen").eqNullSafe(F.col("rejected"))).groupBy("pair_id").agg(F.min("turn").alias("split")))
    met = parts.join(split, "pair_id", "left").where((F.col("own.side") == "chosen") | (F.col("turn") >= F.col("split")))
    part = F.when(F.col("split").isNull() | (F.col("turn") < F.col("split")), "prompt").otherwise(F.col("own.side"))
    shown = F.concat(F.lit(OPEN), "own.said.role", F.lit(MIDDLE), "own.said.text", F.lit(CLOSE))
    trained = (part != "prompt") & (F.col("own.said.role") == "assistant")
    lead = F.length(F.concat(F.lit(OPEN), "own.said.role", F.lit(MIDDLE)))
    cut = met.select("pair_id", part.alias("part"), F.floor(F.col("turn") / block).cast("long").alias("block"), F.struct("turn", shown.alias("text"), trained.alias("trained"), lead.alias("lead")).alias("one"))
    held = cut.groupBy("pair_id", "part", "block").agg(F.array_sort(F.collect_list("one")).alias("all"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<from:int,to:int>>").alias("spans"))
    walk = F.aggregate("all", start, lambda s, x: F.struct((s["at"] + F.length(x["text"])).alias("at"), F.when(x["trained"], F.concat(s["spans"], F.array(F.struct((s["at"] + x["lead"]).alias("from"), (s["at"] + F.length(x["text"])).alias("to"))))).otherwise(s["spans"]).alias("spans")))
    return held.select("pair_id", "part", "block", F.array_min("all.turn").alias("first_turn"), F.array_max("all.turn").alias("last_turn"), F.array_join("all.text", "").alias("text"), walk["spans"].alias("mask"))
