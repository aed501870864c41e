"""Language identification of web pages by Bayesian evidence fusion.

Four kinds of evidence are multiplied: the visible text's likelihood under byte-trigram models of each
language (tempered to `EVIDENCE` trigrams' worth, as trigrams of one text aren't independent), the
language that the markup declares, the last part of the host name, and a prior of the host. The
models count all documents with a language. What a declaration or suffix says about a language is
estimated from the pages themselves, by summing the text's posteriors per declared value and suffix.
Host priors are smoothed towards their domain's, and those towards all pages': (sum + K * prior above)
/ (n + K), a page's own text left out. All sums are grouped aggregations; hosts, declared values and suffixes meet their
pages in joins that Spark can split, so a crowded one spreads over tasks.

Languages take part with `LEAST` trigrams or more, whatever others have. A language is a tag's first part of two or
three letters; its model is 64 KB, and only models reach the driver.

Defined results: a null html or one without text is decided by the other evidence; a null or odd url
has the host ''; ties go to the first language by name; repeated rows come back as often; other
columns are left behind; documents with another tag or none aren't counted; without models lang is null; an empty
table gives no rows.
"""

from __future__ import annotations

import html as markup
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfleet.llm.common import SLICE_BYTES, language, only, raw, settle, slices, tallied, texts

BUCKETS = 1 << 14
EVIDENCE, STRENGTH, LEAST = 60.0, 20.0, 2_000
_DROP = re.compile(r"<!--.*?-->|<(script|style|nav|noscript|template|aside|footer)\b.*?</\1\s*>|<(div|section)\b[^>]*\b(?:class|id|role)\s*=\s*[\"'](?:[^\"']*[\s_-])?(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|cookies?)(?:[\s_-][^\"']*)?[\"'][^>]*>.*?</\2\s*>", re.S | re.I)
_TAG = re.compile(r"<[^>]*>")
_LANG = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})\b", re.I)
_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def trigrams(data: np.ndarray) -> np.ndarray:
    """The bucket of each three bytes in a row, ASCII letters in lower case and digits and symbols left out of distinction."""
    b = _FOLD[data].astype(np.uint64)
    if len(b) < 3:
        return np.zeros(0, dtype=np.int64)
    h = ((b[:-2] << np.uint64(16)) | (b[1:-1] << np.uint64(8)) | b[2:]) * np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(50)).astype(np.int64)


def _fold() -> np.ndarray:
    out = np.full(256, 32, dtype=np.uint8)
    out[97:123] = out[65:91] = np.arange(97, 123)
    out[128:] = np.arange(128, 256)
    return out


_FOLD = _fold()


def models(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """The languages, and each one's log probability of a trigram's bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            lang = b.column("lang").dictionary_encode()
            data, off = raw(texts(b))
            row = np.repeat(np.arange(b.num_rows), np.diff(off))
            whole = np.flatnonzero(row[:-2] == row[2:]) if len(data) > 2 else np.zeros(0, dtype=np.int64)  # within one text
            own = lang.indices.to_numpy(zero_copy_only=False).astype(np.int64)[row[whole]]
            at, n = tallied(own * BUCKETS + trigrams(data)[whole]) if len(whole) else tallied(whole)
            yield pa.RecordBatch.from_arrays([lang.dictionary.take(pa.array(at // BUCKETS)).cast(pa.string()), pa.array(at % BUCKETS), pa.array(n.astype(np.int64))], names=["lang", "bucket", "n"])

    rows = only(docs, text="string", lang="string").withColumn("lang", language()).where("lang is not null").mapInArrow(run, "lang string, bucket long, n long")
    counts = settle(rows.groupBy("lang", "bucket").agg(F.sum("n").alias("n")))
    enough = counts.groupBy("lang").agg(F.sum("n").alias("all")).where(F.col("all") >= LEAST).select("lang")
    got = counts.join(enough, "lang").toArrow()
    name = np.array(got["lang"].to_pylist(), dtype=object)
    langs = sorted(set(name))
    table = np.full((len(langs), BUCKETS), 0.5)
    number = {x: i for i, x in enumerate(langs)}
    table[[number[x] for x in name], got["bucket"].to_numpy()] += got["n"].to_numpy()
    return langs, np.log(table / table.sum(1, keepdims=True)).astype(np.float32)


def visible(html: str) -> str:
    return markup.unescape(_TAG.sub(" ", _DROP.sub(" ", html)))


def read_pages(pages: DataFrame, table: np.ndarray, evidence: float) -> DataFrame:
    """(page_id, host, domain, suffix, declared, n, ll): the evidence of each page; ll holds tempered log likelihoods."""
    shared = pages.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value.T
        for b in slices(batches, "html"):
            declared, n, ll = [], [], []
            for page in b.column("html").to_pylist():
                page = page or ""
                m = _LANG.search(page)
                declared.append(m[1].lower() if m else "")
                data = np.frombuffer(re.sub(r"\s+", " ", visible(page)).encode("utf-8", "replace"), dtype=np.uint8)
                total = np.zeros(own.shape[1])
                for at in range(0, len(data), SLICE_BYTES):
                    total += own[trigrams(data[at : at + SLICE_BYTES + 2])].sum(0, dtype=np.float64)
                n.append(max(0, len(data) - 2))
                ll.append(total * min(1.0, evidence / max(1, n[-1])))
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("host"), pa.array(declared), pa.array(n, pa.int64()), pa.array([x.tolist() for x in ll], pa.list_(pa.float64()))], names=["page_id", "host", "declared", "n", "ll"])

    rows = only(pages, page_id="long", url="string", html="string")
    rows = rows.select("page_id", F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), _HOST, 1)).alias("host"), "html")
    rows = rows.mapInArrow(run, "page_id long, host string, declared string, n long, ll array<double>")
    parts = F.split("host", r"\.")
    suffix = F.when(F.col("host") == "", "").otherwise(F.element_at(parts, -1))
    domain = F.when(F.size(parts) >= 2, F.concat_ws(".", F.slice(parts, -2, 2))).otherwise(F.col("host"))
    return rows.select("page_id", "host", domain.alias("domain"), suffix.alias("suffix"), "declared", "n", "ll")


def softmax(logs: Column) -> Column:
    powers = F.transform(logs, lambda x: F.exp(x - F.array_max(logs)))
    return F.transform(powers, lambda x: x / F.aggregate(powers, F.lit(0.0), lambda s, y: s + y))


def summed(rows: DataFrame, key: str, langs: list[str]) -> DataFrame:
    """Per key its pages and the sum of their texts' posteriors."""
    return rows.groupBy(key).agg(F.count("*").alias("pages"), F.array(*[F.sum(F.col("post")[i]) for i in range(len(langs))]).alias("mass"))


def said_by(rows: DataFrame, key: str, langs: list[str], every: list[float]) -> DataFrame:
    """(key, <key>_log): log P(value | language) of each value; every: each language's whole mass."""
    sums = settle(summed(rows, key, langs).select(key, "mass"))
    width = sums.count()
    log = F.transform("mass", lambda m, i: F.ln((m + 0.5) / (F.element_at(F.array(*[F.lit(x + 0.5 * width) for x in every]), i + 1))))
    return sums.select(key, log.alias(f"{key}_log"))


def smoothed(level: str, above: Column, strength: float) -> Column:
    """The prior of a host or domain (columns <level>_mass and <level>_pages) without the page's own text, towards the one above."""
    others = F.zip_with(f"{level}_mass", "post", lambda m, p: F.greatest(m - p, F.lit(0.0)))
    return F.zip_with(others, above, lambda m, p: (m + strength * p) / (F.col(f"{level}_pages") - 1 + strength))


def languages(pages: DataFrame, docs: DataFrame, evidence: float = EVIDENCE, strength: float = STRENGTH) -> DataFrame:
    """(page_id, host, declared, text_lang, lang, confidence) of each page (page_id, url, html), by models of docs (text, lang)."""
    langs, table = models(docs)
    if not langs:
        none = F.lit(None).cast("string")
        return read_pages(pages, np.zeros((1, BUCKETS), dtype=np.float32), evidence).select("page_id", "host", "declared", none.alias("text_lang"), none.alias("lang"), F.lit(None).cast("double").alias("confidence"))
    rows = settle(read_pages(pages, table, evidence).withColumn("post", softmax(F.col("ll"))))
    total = rows.agg(F.count("*"), *[F.sum(F.col("post")[i]) for i in range(len(langs))]).first()
    top = F.array(*[F.lit(((x or 0.0) + 1) / (total[0] + len(langs))) for x in total[1:]])
    own = F.when(F.col("n") > 0, 1.0).otherwise(0.0)
    domains = settle(summed(rows, "domain", langs).select("domain", F.col("pages").alias("d_pages"), F.col("mass").alias("d_mass")))
    hosts = settle(summed(rows, "host", langs).select("host", F.col("pages").alias("h_pages"), F.col("mass").alias("h_mass")))
    met = rows.join(hosts, "host").join(domains, "domain")
    domain = smoothed("d", top, strength)
    met = met.withColumn("d_prior", domain).withColumn("h_prior", smoothed("h", F.col("d_prior"), strength))
    logs = F.zip_with("ll", "h_prior", lambda a, p: a + F.ln(p))
    for key in ("declared", "suffix"):
        met = met.join(said_by(rows, key, langs, [x or 0.0 for x in total[1:]]), key)
        logs = F.zip_with(logs, f"{key}_log", lambda a, b: a + b)
    names = F.array(*[F.lit(x) for x in langs])
    best = lambda c: names[(F.array_position(F.col(c), F.array_max(c)) - 1).cast("int")]
    out = met.withColumn("all", softmax(logs))
    text = F.when(own > 0, best("post"))
    return out.select("page_id", "host", "declared", text.alias("text_lang"), best("all").alias("lang"), F.array_max("all").alias("confidence"))
