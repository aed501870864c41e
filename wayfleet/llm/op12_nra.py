"""Ranked lexical search: NRA over impact-sorted postings, a shard of documents at a time.

Items come in blocks of at most `BLOCK` (item, term) rows (one larger item: a block of its own), so what a job
broadcasts, the block's terms with their statistics, has a bound. A first pass over all documents counts N, L and the
documents of each term; sums are made in the tasks. A second pass turns documents into shards of about `SHARD`
postings of the block's terms. In a shard each term has its list of documents by falling impact. For an item, the
lists are read from the top, all to the same depth, in steps that double; nothing is ever looked up. What was read of
a document is its score's lower bound, and with the next impact of each list that it hasn't come up in, the upper
bound. Reading ends when no unread document can reach the k-th lower bound (or the k-th score of the task's shards
before), and each document that can reach it is resolved: its bounds are equal, so membership, ties and scores are
exact. A task gives k rows an item at most; two rounds of windows, the first over salted parts of an item, merge them.

Defined results: every row is a document, so repeated rows rank beside each other; a null doc_id comes behind all
others of its score; rows of the benchmark that repeat one item_id are one item with the terms of its different rows,
null being an item_id like any other; null and empty texts have no terms, score nothing and are not counted in N; an
item whose terms no document has gives no rows, and empty tables give none; other columns are left behind.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wayfleet.llm.common import coded, only, settle, slices, tallied, terms, texts

#: Rows (item, term) of a block; postings of a shard; first depth of reading; salted parts in which an item is merged first.
BLOCK, SHARD, DEPTH, PARTS = 1 << 18, 1 << 20, 32, 64
TOP = 20


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term, n): how often an item has a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            flat, starts = terms(texts(b))
            row = pa.array(np.repeat(np.arange(b.num_rows), np.diff(starts)))
            yield pa.RecordBatch.from_arrays([b.column("item_id").take(row), flat.cast(pa.string())], names=["item_id", "term"])

    rows = only(items, item_id="long", text="string").distinct().mapInArrow(run, "item_id long, term string")
    return rows.groupBy("item_id", "term").agg(F.count("*").alias("n"))


def posted(b: pa.RecordBatch, known: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, term and frequency of each posting of a batch, in order of documents; and each document's number of terms."""
    flat, starts = terms(texts(b))
    size = np.diff(starts)
    code, distinct = coded(flat)
    term = pc.fill_null(pc.index_in(distinct, value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)[code] if len(code) else code
    on = term >= 0
    key, tf = tallied(np.repeat(np.arange(b.num_rows), size)[on] * max(1, len(known)) + term[on])
    return key // max(1, len(known)), key % max(1, len(known)), tf.astype(np.int64), size


def statistics(docs: DataFrame, known: pa.Array) -> np.ndarray:
    """How many documents have each term; then N and L."""
    shared, size = docs.sparkSession.sparkContext.broadcast(known), len(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(size + 2, dtype=np.int64)
        for b in slices(batches):
            _, term, _, many = posted(b, shared.value)
            n[:size] += np.bincount(term, minlength=size)
            n[size:] += [np.count_nonzero(many), many.sum()]
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["at", "n"])

    got = only(docs, text="string").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()  # a row for each term of the block at most
    out = np.zeros(size + 2, dtype=np.int64)
    out[got["at"].to_numpy()] = got["n"].to_numpy()
    return out


class Shard:
    """Impact-sorted lists of some documents' postings."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, n_docs: int, n_terms: int):
        order = np.lexsort((doc, -impact, term))
        self.doc, self.impact, self.n_docs = doc[order], impact[order], n_docs
        self.starts = np.searchsorted(term[order], np.arange(n_terms + 1))

    def nra(self, term: np.ndarray, weight: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents, with exact scores, that have `least` or more and are not surely outside the k best: for terms, each counted with a weight."""
        size = self.starts[term + 1] - self.starts[term]
        col = np.repeat(np.arange(len(term)), size)
        rank = np.arange(len(col)) - np.repeat(np.cumsum(size) - size, size)
        reads = np.argsort(rank, kind="stable")  # all lists to one depth before any goes deeper
        at = (np.repeat(self.starts[term], size) + rank)[reads]
        doc, col, rank = self.doc[at], col[reads], rank[reads]
        gain = self.impact[at] * weight[col]
        lower, seen = np.zeros(self.n_docs, dtype=np.int64), np.zeros((self.n_docs, len(term)), dtype=bool)
        depth, done = DEPTH, 0
        while True:
            stop = int(np.searchsorted(rank, depth))
            np.add.at(lower, doc[done:stop], gain[done:stop])
            seen[doc[done:stop], col[done:stop]] = True
            done = stop
            ahead = np.where(size > depth, self.impact[np.minimum(self.starts[term] + depth, len(self.impact) - 1)] * weight, 0)
            met = np.flatnonzero(lower)
            if len(met) >= k:
                least = max(least, int(np.partition(lower[met], len(met) - k)[len(met) - k]))
            unread = int(ahead.sum())
            if unread < least:
                upper = lower[met] + unread - seen[met] @ ahead
                may = met[upper >= least]
                if (upper[upper >= least] == lower[may]).all():
                    return may, lower[may]
            depth *= 2


def best(doc: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k rows of highest score; doc: (id, whether there is none) in two columns."""
    order = np.lexsort((doc[:, 0], doc[:, 1], -score))[:k]
    return doc[order], score[order]


def searched(docs: DataFrame, wanted: pa.Table, k: int) -> DataFrame:
    """(item_id, doc_id, score, part): of a block's (item_id, term, n) each task's k best documents of an item."""
    term = wanted["term"].combine_chunks().dictionary_encode()
    known = term.dictionary.cast(pa.large_string())
    counts = statistics(docs, known)
    df, n_docs, n_terms = counts[:-2], int(counts[-2]), int(counts[-1])
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], dtype=np.int64)
    item = wanted["item_id"].combine_chunks().dictionary_encode(null_encoding="encode")
    own = item.indices.to_numpy().astype(np.int64)
    order = np.argsort(own, kind="stable")
    queries = (np.searchsorted(own[order], np.arange(len(item.dictionary) + 1)), term.indices.to_numpy().astype(np.int64)[order], wanted["n"].to_numpy()[order], item.dictionary)
    shared = docs.sparkSession.sparkContext.broadcast((known, weight, queries))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, weight, (cuts, q_term, q_n, names) = shared.value
        found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        held: list[tuple] = []

        def search() -> None:
            ends = np.cumsum([0, *(len(h[3]) for h in held)])
            doc = np.concatenate([h[0] + e for h, e in zip(held, ends, strict=False)])
            term, impact = (np.concatenate([h[i] for h in held]) for i in (1, 2))
            ids = np.concatenate([h[3] for h in held])
            shard = Shard(doc, term, impact, len(ids), len(known))
            for i in range(len(names)):
                of = slice(cuts[i], cuts[i + 1])
                before = found.get(i, (np.zeros((0, 2), dtype=np.int64), np.zeros(0, dtype=np.int64)))
                at, score = shard.nra(q_term[of], q_n[of] * weight[q_term[of]], k, max(1, int(before[1][-1]) if len(before[1]) == k else 1))
                found[i] = best(np.concatenate([before[0], ids[at]]), np.concatenate([before[1], score]), k)
            held.clear()

        for b in slices(batches):
            doc, term, tf, size = posted(b, known)
            if not len(doc):
                continue
            m = 75 + (25 * size * n_docs) // n_terms
            id = b.column("doc_id")
            ids = np.stack([pc.fill_null(id, 0).to_numpy(zero_copy_only=False), id.is_null().to_numpy(zero_copy_only=False)], axis=1).astype(np.int64)
            held.append((doc, term, 1_000_000_000 * tf // (1000 * tf + 12 * m[doc]), ids))
            if sum(len(h[0]) for h in held) >= SHARD:
                search()
        if held:
            search()
        rows = [i for i, (_, s) in found.items() for _ in s]
        docs_of = np.concatenate([np.zeros((0, 2), dtype=np.int64), *(d for d, _ in found.values())])
        score = np.concatenate([np.zeros(0, dtype=np.int64), *(s for _, s in found.values())])
        part = np.full(len(rows), TaskContext.get().partitionId() % PARTS)
        yield pa.RecordBatch.from_arrays([names.take(pa.array(rows, pa.int64())), pa.array(docs_of[:, 0], mask=docs_of[:, 1] > 0), pa.array(score), pa.array(part)], names=["item_id", "doc_id", "score", "part"])

    return only(docs, doc_id="long", text="string").mapInArrow(run, "item_id long, doc_id long, score long, part long")


def ranked(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): of each item (item_id, text) its k documents (doc_id, text) of the highest score above 0."""
    wanted = settle(item_terms(items))
    blocks = -(-wanted.count() // BLOCK)
    found = None
    for i in range(blocks):
        block = wanted.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == i).toArrow()
        if block.num_rows:
            rows = searched(docs, block, k)
            found = rows if found is None else found.unionByName(rows)
    if found is None:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    for keys in (["item_id", "part"], ["item_id"]):
        found = found.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
    return found.select("item_id", "rank", "doc_id", "score")
