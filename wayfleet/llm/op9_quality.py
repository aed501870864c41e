"""Quality rules: base counts of each text, and its divergence from its language's references.

References are gathered over all documents of a language: the histogram of character classes and that
of the common words (each at least `COMMON` of the language's words, so 1 / COMMON of them at most)
with one bin for all other words. A document's histograms are compared with them by Jensen-Shannon
distance (the root of the divergence in bits, 0 to 1). A sample of n entries lies some way off even if it is drawn
from the reference: the verdict is on the divergence less that expected noise, (bins - 1) / (8 n ln 2) bits. Guards:
words are compared from `guard_words` words on, characters from `guard_chars` characters on.

A language with `LEAST` words or more has a reference, whatever others have. A language is a tag's first part of two
or three letters; its reference is some 20 KB.

Defined results: a document without a language, or whose language has no reference, passes on the base rules with
null distances; null text counts as none; repeated rows come back as often; other columns are left
behind; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfleet.llm.common import coded, language, mix, only, raw, settle, slices, sums, tallied, texts, words

COMMON, LEAST = 0.002, 2_000
CHAR_LIMIT, WORD_LIMIT, GUARD_WORDS, GUARD_CHARS = 0.07, 0.12, 80, 200
#: Lower-case ASCII letters, capitals, digits, spaces, line ends, . and comma, symbols, other ASCII, letters beyond ASCII.
CLASSES = 9
SYMBOLS = b"#*$%&|<>"


def _classes() -> np.ndarray:
    out = np.full(256, 7, dtype=np.int64)
    out[97:123], out[65:91], out[48:58] = 0, 1, 2
    out[[32, 9]], out[[10, 11, 12, 13]] = 3, 4
    out[[46, 44]] = 5
    out[list(SYMBOLS)] = 6
    out[192:], out[128:192] = 8, CLASSES  # the last: continuation bytes, no characters of their own
    return out


_CLASS = _classes()
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, js_chars double, js_words double, excess_chars double, excess_words double"


def classes(a: pa.Array) -> np.ndarray:
    """Characters of each class, a row per text."""
    data, off = raw(a)
    at = np.repeat(np.arange(len(a)), np.diff(off)) * (CLASSES + 1) + _CLASS[data]
    return np.bincount(at, minlength=len(a) * (CLASSES + 1)).reshape(len(a), -1)[:, :CLASSES]


def forms(distinct: pa.Array) -> pa.Array:
    """Words as references count them: in lower case, without punctuation around."""
    return pc.utf8_trim(pc.utf8_lower(distinct), characters=".,;:!?\"'()")


def counted(docs: DataFrame) -> DataFrame:
    """(lang, word, n): words of each language; n of characters of class c under word ' c'."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            a, lang = texts(b), b.column("lang").dictionary_encode()
            own, names = lang.indices.to_numpy(zero_copy_only=False), lang.dictionary
            flat, starts = words(a)
            code, distinct = coded(flat)
            code2, plain = coded(forms(distinct))
            code, size = code2[code] if len(code) else code, max(1, len(plain))
            full, n = tallied(np.repeat(own, np.diff(starts)).astype(np.int64) * size + code)
            chars = classes(a)
            row, kind = np.nonzero(chars)
            at, many = tallied(own.astype(np.int64)[row] * CLASSES + kind, chars[row, kind])
            lang_at = np.concatenate([full // size, at // CLASSES])
            word = pa.concat_arrays([plain.take(pa.array(full % size)).cast(pa.string()), pa.array([f" {c}" for c in at % CLASSES], pa.string())])
            yield pa.RecordBatch.from_arrays([names.take(pa.array(lang_at)).cast(pa.string()), word, pa.array(np.concatenate([n, many]).astype(np.int64))], names=["lang", "word", "n"])

    rows = only(docs, text="string", lang="string").withColumn("lang", language()).where("lang is not null").mapInArrow(run, "lang string, word string, n long")
    return rows.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def references(docs: DataFrame) -> dict[str, tuple[np.ndarray, dict[str, int], np.ndarray]]:
    """Per language its class histogram, the common words' numbers, and their histogram (the last bin: all other words)."""
    counts = settle(counted(docs))
    is_word = ~F.col("word").startswith(" ")
    total = counts.where(is_word).groupBy("lang").agg(F.sum("n").alias("all")).where(F.col("all") >= LEAST)
    rows = counts.join(total, "lang").where(~is_word | (F.col("n") >= COMMON * F.col("all"))).toArrow().to_pylist()  # 1 / COMMON and CLASSES a language at most
    out = {}
    for lang in sorted({r["lang"] for r in rows}):
        own = [r for r in rows if r["lang"] == lang]
        chars = np.zeros(CLASSES)
        common = sorted((r["word"], r["n"]) for r in own if not r["word"].startswith(" "))
        for r in own:
            if r["word"].startswith(" "):
                chars[int(r["word"])] = r["n"]
        hist = np.array([n for _, n in common] + [own[0]["all"] - sum(n for _, n in common)], dtype=float)
        out[lang] = chars / max(1, chars.sum()), {w: i for i, (w, _) in enumerate(common)}, hist / hist.sum()
    return out


def divergence(counts: np.ndarray, ref: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jensen-Shannon divergence in bits of each row's histogram from ref, and what it exceeds its expected noise by; 0 for an empty row."""
    n = counts.sum(1, keepdims=True)
    p = counts / np.maximum(n, 1)
    m = (p + ref) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        part = np.where(p > 0, p * np.log2(p / m), 0) + np.where(ref > 0, ref * np.log2(ref / m), 0)
    noise = (np.count_nonzero(ref) - 1) / (8 * np.log(2) * np.maximum(n[:, 0], 1))
    js = np.where(n[:, 0] > 0, np.clip(part.sum(1) / 2, 0, 1), 0)
    return js, np.clip(js - noise, 0, 1)


def repeated(code: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Per text the words in three-word windows that it has twice or more."""
    n = len(code) - 2
    if n <= 0:
        return np.zeros(len(starts) - 1, dtype=np.int64)
    row = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    c = code.astype(np.uint64)
    key = mix(mix(mix(row[:n].astype(np.uint64)) + c[:n]) + c[1 : n + 1]) + c[2:]
    whole = np.flatnonzero(row[:n] == row[2:])
    order = whole[np.argsort(key[whole], kind="stable")]
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(code), dtype=bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    hit = twice.copy()
    hit[1:] |= twice[:-1]
    hit[2:] |= twice[:-2]
    return sums(hit.astype(np.int64), starts)


def dup_lines(a: pa.Array) -> np.ndarray:
    """Per text the lines with a word that equal an earlier line."""
    parts = pc.split_pattern(a, "\n")
    line, row = parts.flatten(), pc.list_parent_indices(parts).to_numpy(zero_copy_only=False)
    full = pc.greater(pc.binary_length(pc.ascii_trim_whitespace(line)), 0).to_numpy(zero_copy_only=False)
    code, distinct = coded(line.filter(pa.array(full)))
    row = row[full]
    have = np.bincount(row, minlength=len(a))
    kinds = np.bincount(np.unique(row * max(1, len(distinct)) + code) // max(1, len(distinct)), minlength=len(a))
    return have - kinds


def quality(docs: DataFrame, char_limit: float = CHAR_LIMIT, word_limit: float = WORD_LIMIT, guard_words: int = GUARD_WORDS, guard_chars: int = GUARD_CHARS) -> DataFrame:
    """Base counts, verdict, both distances, and what the divergences exceed their noise by (null where a guard holds) of each document (doc_id, text, lang); see SCHEMA."""
    shared = docs.sparkSession.sparkContext.broadcast(references(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refs = shared.value
        for b in slices(batches):
            a, spoken = texts(b), b.column("lang").dictionary_encode()
            lang, known = pc.fill_null(spoken.indices, -1).to_numpy(zero_copy_only=False), spoken.dictionary.to_pylist()
            data, off = raw(a)
            flat, starts = words(a)
            code, distinct = coded(flat)
            n_words = np.diff(starts)
            symbol = np.isin(data, np.frombuffer(SYMBOLS, dtype=np.uint8))
            chars = classes(a)
            again = repeated(code, starts)
            plain = forms(distinct).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(b.num_rows), n_words)
            js = np.full((4, b.num_rows), np.nan)
            for nth, name in enumerate(known):
                if name not in refs:
                    continue
                ref, common, hist = refs[name]
                own = lang == nth
                kind = np.fromiter((common.get(w, len(common)) for w in plain), dtype=np.int64, count=len(plain))
                number = np.cumsum(own) - 1
                pick = own[row]
                counts = np.bincount(number[row[pick]] * len(hist) + kind[code[pick]], minlength=own.sum() * len(hist)).reshape(-1, len(hist))
                js[0::2, own], js[1::2, own] = divergence(chars[own], ref), divergence(counts, hist)
            failed = (n_words < 50) | (100 * again > 50 * n_words)
            no_chars, no_words = (chars.sum(1) < guard_chars) | np.isnan(js[0]), (n_words < guard_words) | np.isnan(js[1])
            bad = (~no_chars & (js[2] > char_limit)) | (~no_words & (js[3] > word_limit))
            cols = [n_words, sums((((data & 0xC0) != 0x80) & ~_SPACE[data]).astype(np.int64), off), sums(symbol.astype(np.int64), off), dup_lines(a), again]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").cast(pa.int64()), *[pa.array(c.astype(np.int64)) for c in cols], pa.array(failed), pa.array(~failed & ~bad), *[pa.array(x, mask=m) for x, m in ((np.sqrt(js[0]), no_chars), (np.sqrt(js[1]), no_words), (js[2], no_chars), (js[3], no_words))]],
                names=[x.split()[0] for x in SCHEMA.split(", ")],
            )

    return only(docs, doc_id="long", text="string", lang="string").withColumn("lang", language()).mapInArrow(run, SCHEMA)
