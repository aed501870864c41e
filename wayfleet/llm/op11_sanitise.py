"""Personal data by information-theoretic sanitisation: protected entities, and the terms that reveal them.

Protected entities are the values of base spans (addresses, numbers) of the whole corpus. A term (a run of letters and
digits, A-Z in lower case) tells of an entity by their point-wise mutual information over documents,
log(both * N / (n_term * n_entity)), where `both` counts documents with the term within `WINDOW` terms of a mention of
the entity, N all rows. Its share of the entity's own information, log(N / n_entity), is the disclosure: 1 if the term
comes with the entity alone, 0 or less if it says nothing. A pair counts from `SUPPORT` different contexts (windows) on,
so that copies of a passage are one piece of evidence. A term of disclosure `GENERALISE` or more is replaced by its
shape, from `REMOVE` on it is removed, wherever it stands in the corpus outside of base spans.

All counts are over all documents: mentions' windows are summed by (entity, term, context), then by pair; documents of
the paired terms are counted behind a sieve of bounded size. Terms that disclose are looked up by their 64-bit hash in
their sorted list if it holds `LISTED` of them at most, else behind a sieve of bounded size, which lets some others through;
a join confirms what was found. No texts are shuffled for spans.

Base spans are leftmost and don't overlap within a kind; `[0-9]++` and the like take no step back, so long runs cost their length.

Defined results: each row is a document; null and empty texts have no spans, their digest is that of the empty text; a null
doc_id stays null; repeated rows come back as often, and count as often in N; an empty table gives no rows; an entity
that all rows have has no information and is revealed by nothing; other columns are left behind.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfleet.llm.common import coded, may_be_in, only, raw, settle, sieve_of, sifted, slices, sums, tallied, terms, texts

WINDOW, SUPPORT, GENERALISE, REMOVE = 8, 3, 0.9, 0.97
#: Disclosing terms that are broadcast as a list (8 bytes each).
LISTED = 1 << 22
SEED = 42
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "generalised", "removed")

_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
_SEPARATORS = str.maketrans("", "", " -().+")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int, str]]:
    done = 0  # no local part goes back beyond the last match or the last @
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            yield start, m.end(), text[start : m.end()].translate(_LOWER)
            done = m.end()
        else:
            done = m.start() + 1


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value) of a text's base spans, by start and kind."""
    found = [(a, 0, b, v) for a, b, v in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") or "0" for p in m.group().split(".")]
        if all(len(p) <= 3 and int(p) <= 255 for p in parts):
            found.append((m.start(), 1, m.end(), ".".join(parts)))
    for m in _CARD.finditer(text):
        digits = m.group().translate(_SEPARATORS)
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end(), digits))
    if "+" in text:
        for m in _PHONE.finditer(text):
            digits = m.group().translate(_SEPARATORS)
            if 10 <= len(digits) <= 15:
                found.append((m.start(), 3, m.end(), digits))
    return sorted(found)


def suspects(a: pa.Array) -> np.ndarray:
    """Which texts can have base spans: those with an @, or with four digits or more."""
    data, off = raw(a)
    digits = sums((data >= 48) & (data <= 57), off)
    return (digits >= 4) | (sums(data == 64, off) > 0)


def _hash(s: str) -> int:
    return xxhash.xxh64_intdigest(s, SEED) - (1 << 63)


def covers(spans: list[tuple]) -> tuple[list[int], list[int]]:
    """Starts and ends of the stretches that spans (start, kind, end, ...) in order cover."""
    starts, ends = [], []
    for start, _, end, *_ in spans:
        if ends and start < ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)
    return starts, ends


def clear_terms(text: str, spans: list[tuple]) -> Iterator[tuple[str, int, int]]:
    """The text's terms that touch no span, with their places."""
    starts, ends = covers(spans)
    for m in _TERM.finditer(text):
        i = bisect_right(starts, m.end() - 1)
        if not i or ends[i - 1] <= m.start():
            yield m.group().translate(_LOWER), m.start(), m.end()


def windows(text: str, spans: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int]]:
    """(entity, term, context) of a text: for each entity, once, 0 and each term near a mention of it, with the first such window."""
    near = list(clear_terms(text, spans))
    places = [p for _, p, _ in near]
    found: dict[tuple[int, int], int] = {}
    for start, kind, end, value in spans:
        at, behind = bisect_right(places, start), bisect_right(places, end - 1)
        around = [w for w, *_ in near[max(0, at - WINDOW) : at] + near[behind : behind + WINDOW]]
        entity, context = _hash(f"{kind}:{value}"), _hash(" ".join(around))
        for term in (0, *map(_hash, around)):
            found.setdefault((entity, term), context)
    return [(*k, c) for k, c in found.items()]


def pairs(docs: DataFrame) -> DataFrame:
    """(entity, term, both, of): pairs with support; documents with both, and with the entity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            a = texts(b)
            some = a.filter(pa.array(suspects(a))).to_pylist()
            rows = [w for t in some if (spans := base_spans(t)) for w in windows(t, spans)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], names=["entity", "term", "context"])

    rows = only(docs, text="string").mapInArrow(run, "entity long, term long, context long")
    sums_ = rows.groupBy("entity", "term", "context").agg(F.count("*").alias("n")).groupBy("entity", "term").agg(F.sum("n").alias("both"), F.count("*").alias("contexts"))
    held = settle(sums_.where(F.col("contexts") >= SUPPORT).drop("contexts"))
    return held.where("term <> 0").join(held.where("term = 0").select("entity", F.col("both").alias("of")), "entity")


def hashed(distinct: pa.Array) -> np.ndarray:
    return np.array([_hash(w) for w in distinct.to_pylist()], dtype=np.int64)


def usage(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(term, n): in how many documents each of known's terms (and, by chance, others) stands."""
    sieve = docs.sparkSession.sparkContext.broadcast(sieve_of(known.select(F.col("term").alias("key")).distinct()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            flat, starts = terms(texts(b))
            code, distinct = coded(flat)
            h = hashed(distinct)
            may = sifted(sieve.value, h)
            row, on = np.repeat(np.arange(b.num_rows), np.diff(starts)), may[code] if len(code) else np.zeros(0, dtype=bool)
            pair, _ = tallied(row[on] * max(1, len(h)) + code[on])
            at, n = tallied(pair % max(1, len(h)))
            yield pa.RecordBatch.from_arrays([pa.array(h[at]), pa.array(n.astype(np.int64))], names=["term", "n"])

    return only(docs, text="string").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def disclosing(docs: DataFrame) -> DataFrame:
    """(term, disclosure, kind): terms (by hash) that reveal an entity by `GENERALISE` or more, and what becomes of them."""
    found = settle(pairs(docs))
    total = docs.count()
    met = found.where(F.col("of") < total).join(usage(docs, found), "term")
    share = F.log(F.col("both") * float(total) / (F.col("n") * F.col("of").cast("double"))) / F.log(float(total) / F.col("of"))
    most = met.groupBy("term").agg(F.max(share).alias("disclosure")).where(F.col("disclosure") >= GENERALISE)
    return most.withColumn("kind", F.when(F.col("disclosure") >= REMOVE, KINDS.index("removed")).otherwise(KINDS.index("generalised")))


SPAN = "array<struct<start:long,kind:int,end:long>>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
_HITS = pa.list_(pa.struct([("term", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))


class Flagged:
    """Lets hashes of flagged terms pass; if there are more than `LISTED`, some others too."""

    def __init__(self, flagged: DataFrame):
        self.listed = flagged.count() <= LISTED
        keys = flagged.select(F.col("term").alias("key"))
        self.keys = np.sort(keys.toArrow()["key"].to_numpy()) if self.listed else sieve_of(keys)

    def pass_(self, h: np.ndarray) -> np.ndarray:
        if not self.listed:
            return sifted(self.keys, h)
        at = np.searchsorted(self.keys, h)
        return (np.append(self.keys, 0)[at] == h) & (at < len(self.keys))


def found_spans(docs: DataFrame, flagged: DataFrame) -> DataFrame:
    """(doc_id, key, base, spans) of each row: base spans, and all spans with those of flagged's terms; key: a hash of doc_id and text."""
    known = Flagged(flagged)
    none_flagged = not known.keys.any()
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            a = texts(b)
            has = suspects(a)
            touched, told = np.zeros(b.num_rows, dtype=bool), {}
            if not none_flagged:
                flat, starts = terms(a)
                code, distinct = coded(flat)
                h = hashed(distinct)
                may = shared.value.pass_(h)
                told = {w: int(h[i]) for i in np.flatnonzero(may) for w in (distinct[int(i)].as_py(),)}
                touched = sums(may[code] if len(code) else np.zeros(0, dtype=bool), starts) > 0
            base, hits = [[]] * b.num_rows, [[]] * b.num_rows
            for i in np.flatnonzero(has | touched).tolist():
                text = a[i].as_py()
                own = base_spans(text) if has[i] else []
                base[i] = [{"start": s, "kind": k, "end": e} for s, k, e, _ in own]
                if touched[i]:
                    hits[i] = [{"term": told[w], "start": s, "end": e} for w, s, e in clear_terms(text, own) if w in told]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("key"), pa.array(base, _SPANS), pa.array(hits, _HITS)], names=["doc_id", "key", "base", "hits"])

    rows = only(docs, doc_id="long", text="string").withColumn("key", F.xxhash64("doc_id", "text"))
    rows = settle(rows.mapInArrow(run, f"doc_id long, key long, base {SPAN}, hits array<struct<term:long,start:long,end:long>>"))
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    hits = rows.where(F.size("hits") > 0).select("row", F.explode("hits").alias("hit")).select("row", "hit.*")
    more = hits.join(flagged.select("term", "kind"), "term").groupBy("row").agg(F.collect_list(F.struct("start", "kind", "end")).alias("more"))
    none = F.array().cast(SPAN)
    return rows.join(more, "row", "left").select("doc_id", "key", "base", F.array_sort(F.concat("base", F.coalesce("more", none))).alias("spans"))


def told(spans: str) -> Column:
    """Spans as kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def personal_data(docs: DataFrame) -> DataFrame:
    """Of each row (doc_id, text): doc_id, key, base and spans (arrays of start, kind, end in code points; kind an index of KINDS)."""
    return found_spans(docs, settle(disclosing(docs)))


def digests(done: DataFrame) -> DataFrame:
    """Counts of base spans, a digest of them, and all spans as text."""
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size("base") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{name}") for k, name in enumerate(BASE)]
    return done.select("doc_id", *counts, F.sha2(told("base"), 256).alias("base_sha256"), told("spans").alias("spans"))


def shape(term: str) -> str:
    """What a generalised term is replaced by: the class that it shares with many others."""
    if term.isdecimal():
        return "[number]"
    return "[code]" if any(c.isdecimal() for c in term) else "[name]" if term[:1].isupper() else "[word]"


def rewritten(text: str, spans: list[dict]) -> str:
    """The text with base spans as their kind, generalised terms as their shape, and without removed terms; of spans that overlap the first one names the whole stretch."""
    out, done, at = [], 0, 0
    while at < len(spans):
        first, end = spans[at], spans[at]["end"]
        while at < len(spans) and spans[at]["start"] < end:
            end = max(end, spans[at]["end"])
            at += 1
        kind = KINDS[first["kind"]]
        word = text[first["start"] : end]
        out += [text[done : first["start"]], shape(word) if kind == "generalised" else "" if kind == "removed" else f"[{kind}]"]
        done = end
    return "".join([*out, text[done:]])


def sanitised(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) with their texts rewritten. Only documents that a sieve can't rule out are shuffled with their texts."""
    done = settle(personal_data(docs).where(F.size("spans") > 0).groupBy("key").agg(F.first("spans").alias("_spans")))

    @F.arrow_udf("string")
    def applied(text: pa.Array, spans: pa.Array) -> pa.Array:
        return pa.array([rewritten(t, s) if s else t for t, s in zip(text.to_pylist(), spans.to_pylist(), strict=True)], pa.string())

    rows = docs.withColumn("_key", F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    rows = rows.withColumn("_may", may_be_in(done.select("key"), F.col("_key")))
    near = rows.where("_may").join(done.withColumnRenamed("key", "_key"), "_key", "left").withColumn("text", applied("text", "_spans"))
    return near.select(*docs.columns).unionByName(rows.where("not _may").select(*docs.columns))
