"""Queries over the training-data tables: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfleet.llm import op1_packing, op2_toxicity, op3_token_counts, op4_simhash, op5_decontaminate, op6_preference, op7_lattice_lm, op8_line_dedup, op9_quality, op10_language, op11_sanitise, op12_nra, op13_repair, tokens
from wayfleet.llm.common import crc_mod, only, settle, table

Query = Callable[[SparkSession, str], DataFrame]


def op2_toxicity_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = only(table(spark, sf_dir, "documents"), doc_id="long", text="string")
    scored = op2_toxicity.toxicity(docs, table(spark, sf_dir, "labels"), op2_toxicity.learnable())
    return scored.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


def op6_preference_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest of each rendered part.

    The table doesn't say which conversations are chosen or rejected. Pairs are those that open with the
    same turn, and any other conversation with an odd id as rejected beside its predecessor's as chosen.
    """
    rows = settle(op6_preference.turns(table(spark, sf_dir, "conversations")))
    alike = op6_preference.first_turn_pairs(rows)
    ids = rows.select("conv_id").distinct()
    next_to = ids.where("conv_id % 2 = 1").select(F.col("conv_id").alias("pair_id"), (F.col("conv_id") - 1).alias("chosen"), F.col("conv_id").alias("rejected"))
    next_to = next_to.join(ids.select(F.col("conv_id").alias("chosen")), "chosen").join(alike, "pair_id", "left_anti")
    pairs = settle(alike.unionByName(next_to))
    done = op6_preference.preferences(rows, pairs)
    spans = F.array_join(F.transform("mask", lambda m: F.concat_ws("-", m["from"], m["to"])), ",")
    return done.select("pair_id", "part", "block", "first_turn", "last_turn", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"), spans.alias("mask"))


OP6_SQL = """
WITH turns AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, min({'role': coalesce(role, ''), 'text': coalesce(text, '')}) AS said
  FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL
), size AS (SELECT conv_id, count(*) AS n, min(turn) AS turn FROM turns GROUP BY ALL
), opening AS (SELECT s.conv_id, s.n, t.said FROM size s JOIN turns t ON t.conv_id = s.conv_id AND t.turn = s.turn
), best AS (SELECT said, min({'n': n, 'conv_id': conv_id}) AS best FROM opening GROUP BY said HAVING count(*) > 1
), alike AS (SELECT o.conv_id AS pair_id, b.best.conv_id AS chosen, o.conv_id AS rejected FROM opening o JOIN best b ON b.said = o.said WHERE o.conv_id <> b.best.conv_id
), pairs AS (
  SELECT * FROM alike
  UNION ALL SELECT a.conv_id, a.conv_id - 1, a.conv_id FROM size a JOIN size b ON b.conv_id = a.conv_id - 1
  WHERE a.conv_id % 2 = 1 AND a.conv_id NOT IN (SELECT pair_id FROM alike)
), sides AS (
  SELECT coalesce(a.pair_id, b.pair_id) AS pair_id, coalesce(a.turn, b.turn) AS turn, a.said AS chosen, b.said AS rejected
  FROM (SELECT pair_id, turn, said FROM pairs JOIN turns ON conv_id = chosen) a
  FULL JOIN (SELECT pair_id, turn, said FROM pairs JOIN turns ON conv_id = rejected) b ON a.pair_id = b.pair_id AND a.turn = b.turn
), split AS (SELECT pair_id, min(turn) AS split FROM sides WHERE chosen IS DISTINCT FROM rejected GROUP BY ALL
), parts AS (
  SELECT b.pair_id, b.turn, CASE WHEN s.split IS NULL OR b.turn < s.split THEN 'prompt' ELSE 'chosen' END AS part, b.chosen AS said FROM sides b LEFT JOIN split s ON s.pair_id = b.pair_id WHERE b.chosen IS NOT NULL
  UNION ALL SELECT b.pair_id, b.turn, 'rejected', b.rejected FROM sides b JOIN split s ON s.pair_id = b.pair_id WHERE b.rejected IS NOT NULL AND b.turn >= s.split
), shown AS (
  SELECT pair_id, part, turn // 64 AS block, turn, '<|' || said.role || '|>' || chr(10) AS lead, '<|' || said.role || '|>' || chr(10) || said.text || '<|end|>' || chr(10) AS text, part <> 'prompt' AND said.role = 'assistant' AS trained FROM parts
), placed AS (SELECT *, CAST(sum(length(text)) OVER (PARTITION BY pair_id, part, block ORDER BY turn) AS BIGINT) AS upto FROM shown)
SELECT pair_id, part, block, min(turn) AS first_turn, max(turn) AS last_turn, CAST(sum(length(text)) AS BIGINT) AS n_chars, md5(string_agg(text, '' ORDER BY turn)) AS text_md5,
  coalesce(string_agg(CASE WHEN trained THEN (upto - length(text) + length(lead)) || '-' || upto END, ',' ORDER BY turn), '') AS mask
FROM placed GROUP BY pair_id, part, block
"""


def op7_lattice_lm_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_lattice_lm.lm_scores(op7_lattice_lm.split(table(spark, sf_dir, "documents")), op7_lattice_lm.vocabulary(), "held_out")


def op9_quality_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_quality.quality(table(spark, sf_dir, "documents"))


def op10_language_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_language.languages(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op1_packing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_packing.pack(table(spark, sf_dir, "documents"), tokens.vocabulary())


def op3_token_counts_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_token_counts.token_counts(table(spark, sf_dir, "documents"), tokens.vocabulary())


def op4_simhash_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_simhash.components64(table(spark, sf_dir, "documents"))


def op5_decontaminate_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_line_dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest of each document's text after its repeated lines went."""
    done = op8_line_dedup.line_dedup(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("kept_chars"), F.md5(F.col("text")).alias("kept_md5"))


def op11_sanitise_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11_sanitise.digests(op11_sanitise.personal_data(table(spark, sf_dir, "documents")))


def op12_nra_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12_nra.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_repair_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return op13_repair.digests(op13_repair.repair(op13_repair.damaged(rows)), only(rows, conv_id="long").distinct())


OP12_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS row, CAST(doc_id AS BIGINT) AS doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
), said AS (SELECT row, unnest(terms) AS term FROM docs
), held AS (SELECT row, term, count(*) AS tf FROM said GROUP BY ALL
), known AS (SELECT term, count(*) AS df FROM held GROUP BY ALL
), total AS (SELECT count(*) AS n, CAST(sum(len(terms)) AS BIGINT) AS l FROM docs WHERE len(terms) > 0
), items AS (SELECT DISTINCT CAST(item_id AS BIGINT) AS item_id, text FROM benchmark
), asked AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM items
), wanted AS (SELECT item_id, term, count(*) AS q FROM asked GROUP BY ALL
), weighed AS (SELECT item_id, term, q * CAST(floor(1000 * ln((2 * n + 2) / (2 * df + 1))) AS BIGINT) AS w FROM wanted JOIN known USING (term), total
), scored AS (
  SELECT w.item_id, h.row, d.doc_id, CAST(sum(w.w * ((1000000000 * h.tf) // (1000 * h.tf + 12 * (75 + (25 * len(d.terms) * t.n) // t.l)))) AS BIGINT) AS score
  FROM weighed w JOIN held h USING (term) JOIN docs d ON d.row = h.row, total t GROUP BY ALL
), placed AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM placed WHERE rank <= 20
"""


def op13_sql() -> str:
    """The forward form of the DP: of each state the least (cost, audit, text so far), row by row of a conversation."""
    space = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    turn = lambda x, said: f"{x}.t || CASE WHEN {x}.t = '' THEN '' ELSE chr(10) END || {said}"
    way = lambda x, cost, letter, said=None: f"{{'c': {x}.c + {cost}, 'a': {x}.a || '{letter}', 't': {turn(x, said) if said else x + '.t'}}}"
    least = lambda *ways: f"list_min([{', '.join(ways)}])"
    more, never = "CASE WHEN fault = 3 THEN 3 ELSE 0 END", "CASE WHEN fault IN (1, 2) THEN 1000000000 ELSE 0 END"
    keep = lambda x, initial: way(x, f"({more} + {never} + CASE WHEN left(role, 1) = '{initial}' THEN 0 ELSE 1000000000 END)", "K", "role || ':' || text")
    rerole = lambda x, role: way(x, f"(3 + {more} + {never})", "R", f"'{role}:' || text")
    steps = [
        way("s0", 4, "D"),
        least(way("s1", 4, "D"), keep("s0", "s")),
        least(way("i2", 4, "D"), *(f(x, w) for x in ("s0", "s1", "s3") for f, w in ((keep, "u"), (rerole, "user")))),
        least(way("i3", 4, "D"), keep("i2", "a"), rerole("i2", "assistant")),
    ]
    # a state 3 that an insertion gives never leads on better than by these
    steps[2] = steps[2][:-2] + ", " + ", ".join(f("i3", w) for f, w in ((keep, "u"), (rerole, "user"))) + "])"
    before = least("s2", *(way(x, 3, "I", "'user:'") for x in ("s0", "s1", "s3")))
    behind = least("s3", way("i2", 3, "I", "'assistant:'"))
    far = "{'c': CAST(1000000000 AS BIGINT), 'a': '', 't': ''}"
    return f"""
WITH RECURSIVE src AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations
), bits AS (SELECT *, list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(key, ''), lambda x: [CAST(ord(x) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))) AS l FROM src
), crc AS (SELECT *, xor(list_reduce(l, lambda c, x: xor(xor(c, x) >> 1, 3988292384 * (xor(c, x) & 1))), 4294967295) % 20 AS k FROM bits
), damaged AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE WHEN k = 1 THEN '' WHEN k = 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM (SELECT *, unnest(CASE WHEN k = 3 THEN [0, 1] ELSE [0] END) AS again FROM crc WHERE k <> 0)
), placed AS (
  SELECT *, dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS g, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(md5(role) || text)) AS i FROM damaged
), faulty AS (
  SELECT *, CASE WHEN trim(text, {space}) = '' THEN 1 WHEN row_number() OVER (PARTITION BY g, role, text ORDER BY i) > 1 THEN 2 WHEN right(rtrim(text, {space}), 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
    left(lag(role) OVER (PARTITION BY g ORDER BY i), 1) || left(role, 1) AS joint FROM placed
), walk AS (
  SELECT g, CAST(0 AS BIGINT) AS i, {{'c': CAST(0 AS BIGINT), 'a': '', 't': ''}} AS s0, {far} AS s1, {far} AS s2, {far} AS s3 FROM (SELECT DISTINCT g FROM placed)
  UNION ALL
  SELECT g, i, {', '.join(steps)} FROM (
    SELECT *, {behind} AS i3 FROM (SELECT w.g, r.i, s0, s1, s2, s3, role, text, fault, {before} AS i2 FROM walk w JOIN faulty r ON r.g = w.g AND r.i = w.i + 1))
), done AS (
  SELECT g, {least("s0", "i3")} AS best FROM (SELECT *, {behind} AS i3 FROM (SELECT w.*, {before} AS i2 FROM walk w JOIN (SELECT g, max(i) AS i FROM placed GROUP BY g) USING (g, i)))
), told AS (
  SELECT conv_id, g, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
    count(*) FILTER (joint IS NOT NULL AND joint NOT IN ('su', 'ua', 'au')) AS illegal FROM faulty GROUP BY ALL
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(best.c, 0) AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(best.t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM src) o LEFT JOIN told t ON t.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN done d ON d.g = t.g
"""


def queries() -> dict[str, Query]:
    return {
        "op1_harmonic_packing": op1_packing_query,
        "op2_toxicity_gru": op2_toxicity_query,
        "op3_token_counts": op3_token_counts_query,
        "op4_simhash_anchors": op4_simhash_query,
        "op5_template_decontamination": op5_decontaminate_query,
        "op6_preference_format": op6_preference_query,
        "op7_lattice_lm": op7_lattice_lm_query,
        "op8_line_windows": op8_line_dedup_query,
        "op9_quality_divergence": op9_quality_query,
        "op10_language_fusion": op10_language_query,
        "op11_disclosure_sanitise": op11_sanitise_query,
        "op12_nra_search": op12_nra_query,
        "op13_conversation_repair": op13_repair_query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_preference_format": OP6_SQL, "op12_nra_search": OP12_SQL, "op13_conversation_repair": op13_sql()}
