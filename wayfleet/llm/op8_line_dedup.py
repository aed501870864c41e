"""Line dedup by overlapping three-line windows.

Lines end at line ends; a line is wrapped at its sentence ends, and a sentence of over `WRAP` words in front of words
that its content chooses: those whose hash is the least of the `REACH` words on either side. So a repeated passage is
cut alike wherever it stands, and one set as a single line is still several lines. Windows are three
consecutive lines that aren't blank. A window's first
occurrence is the one in the document with the smallest doc_id, and there the earliest. The lines
that later occurrences cover are merged and removed; inside a document the first occurrence keeps its
lines although later ones overlap it. A merged stretch goes if it is made of whole lines of the text, or if it has
`min_words` words or more: wrapped pieces of common phrases stay, and neighbouring repeats add up.

One row per document and distinct window is reduced to the smallest doc_id of each window (map-side
minimum), joined back for the later ones (a sieve of bounded size holds back most others), and gathered per document.
The text meets its own list only.

Defined results: a null text stays null, an empty one empty; fewer than three lines are left alone;
rows with equal doc_id count as one document; rows with null doc_id only lose repeats inside
themselves; other columns are kept unless named _later; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfleet.llm.common import mix, only, raw, settle, sieve_of, sifted, slices, texts

WRAP, REACH, MIN_WORDS = 16, 2, 10
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def weights(data: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of each word (where it starts, and its bytes) by its first eight bytes and its size."""
    padded = np.append(data, np.zeros(8, dtype=np.uint8))
    own = np.lib.stride_tricks.sliding_window_view(padded, 8)[at].view("<u8").ravel()
    masks = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)
    return mix((own & masks[np.minimum(size, 8)]) + mix(size.astype(np.uint64)))


def chosen(weight: np.ndarray, nth: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which words of long sentences (of so many words, this the nth) start a new line: the least of their neighbourhood."""
    out = (nth >= REACH) & (nth < size - REACH)
    for d in range(1, REACH + 1):
        out[d:] &= weight[d:] < weight[:-d]
        out[:-d] &= weight[:-d] <= weight[d:]
    return out


def lines(a: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """All texts' lines in a row (nothing is left out between them), their words, whether they open a line of the text, and where each text's lines start."""
    data, off = raw(a)
    n = len(data)
    if not n:
        return pa.array([], pa.large_string()), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool), np.zeros(len(a) + 1, dtype=np.int64)
    space = _SPACE[data]
    cut = np.zeros(n + 1, dtype=bool)
    cut[1:] = data == 10
    cut[off] = True
    hard = cut.copy()
    mark = (data == 46) | (data == 33) | (data == 63)
    cut[1:-1] |= mark[:-1] & (data[1:] == 32)
    word, end = ~space, np.ones(n, dtype=bool)
    word[1:] &= space[:-1] | cut[1:-1]
    end[:-1] = space[1:] | cut[1:-1]
    at = np.flatnonzero(word)
    begin = np.flatnonzero(cut[:-1])
    if len(at):
        first = np.searchsorted(at, np.append(begin, n))
        size = np.repeat(np.diff(first), np.diff(first))
        nth = np.arange(len(at)) - np.repeat(first[:-1], np.diff(first))
        length = np.flatnonzero(end & ~space) + 1 - at
        long = size > WRAP
        cut[at[long][chosen(weights(data, at[long], length[long]), nth[long], size[long])]] = True
    begin = np.flatnonzero(cut[:-1])
    ends = np.append(begin, n).astype(np.int64)
    count = np.diff(np.searchsorted(at, ends))
    made = pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data)))
    return made, count, hard[begin], np.searchsorted(begin, off)


def windows(a: pa.Array, size: int) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """The lines (as `lines` gives them), and per text: hashes of its windows, their first and last line."""
    made, count, hard, starts = lines(a)
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(x) for x in pc.ascii_trim_whitespace(made).to_numpy(zero_copy_only=False)), dtype=np.uint64, count=len(made))
    full = np.flatnonzero(count > 0)
    to = np.searchsorted(full, starts)
    if len(full) < size:
        empty = np.zeros(0, dtype=np.int64)
        return made, count, hard, starts, [(empty, empty, empty)] * len(a)
    key = np.zeros(len(full) - size + 1, dtype=np.uint64)
    for i in range(size):
        key = mix(key + h[full[i : i + len(key)]])
    out = []
    for lo, hi in zip(to[:-1], to[1:], strict=True):
        p = np.arange(lo, max(lo, hi - size + 1))
        out.append((key[p].view(np.int64), full[p], full[p + size - 1]))
    return made, count, hard, starts, out


def covered(n: int, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Which of n lines lie in the spans, ends included."""
    step = np.zeros(n + 1, dtype=np.int64)
    np.add.at(step, first, 1)
    np.add.at(step, last + 1, -1)
    return np.cumsum(step)[:-1] > 0


def removed(count: np.ndarray, hard: np.ndarray, key: np.ndarray, first: np.ndarray, last: np.ndarray, later: np.ndarray, min_words: int) -> np.ndarray:
    """Which of a text's lines (their words, whether they open a line of the text) go; later: keys of windows that an earlier document has."""
    n = len(count)
    gone = np.isin(key, later)
    out = covered(n, first[gone], last[gone])
    own = ~gone
    if own.any():
        _, at, inverse, times = np.unique(key[own], return_index=True, return_inverse=True, return_counts=True)
        again = np.ones(own.sum(), dtype=bool)
        again[at] = False
        if again.any():
            f, z = first[own], last[own]
            kept = np.zeros_like(again)
            kept[at[times > 1]] = True
            out |= covered(n, f[again], z[again]) & ~covered(n, f[kept], z[kept])
    step = np.diff(np.concatenate([[0], out.view(np.int8), [0]]))
    begin, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    total = np.concatenate([[0], np.cumsum(count)])
    whole = hard[begin] & np.append(hard, True)[end]
    goes = whole | (total[end] - total[begin] >= min_words)
    return covered(n, begin[goes], end[goes] - 1)


def line_dedup(docs: DataFrame, size: int = 3, min_words: int = MIN_WORDS) -> DataFrame:
    """docs (doc_id, text, ...) with the text's repeated lines removed, and n_lines and n_removed (long)."""

    def listed(sieve=None) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches):
                keys = [np.unique(k) for k, _, _ in windows(texts(b), size)[-1]]
                key, row = np.concatenate(keys), np.repeat(np.arange(b.num_rows), [len(k) for k in keys])
                if sieve is not None:
                    may = sifted(sieve.value, key)
                    key, row = key[may], row[may]
                yield pa.RecordBatch.from_arrays([pa.array(key), b.column("doc_id").take(pa.array(row))], names=["key", "doc_id"])

        return only(docs, doc_id="long", text="string").where("doc_id is not null").mapInArrow(run, "key long, doc_id long")

    shared = settle(listed().groupBy("key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("key", "first"))
    pairs = listed(docs.sparkSession.sparkContext.broadcast(sieve_of(shared)))
    later = pairs.join(shared, "key").where(F.col("doc_id") > F.col("first")).groupBy("doc_id").agg(F.collect_set("key").alias("_later"))

    def rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            made, words, hard, starts, found = windows(texts(b), size)
            count = np.diff(starts)
            gone = np.zeros(len(made), dtype=bool)
            for row, (lists, (key, first, last)) in enumerate(zip(b.column("_later"), found, strict=True)):
                lo, hi = starts[row], starts[row + 1]
                if len(key):
                    known = lists.values.to_numpy(zero_copy_only=False) if lists.is_valid else np.zeros(0, dtype=np.int64)
                    gone[lo:hi] = removed(words[lo:hi], hard[lo:hi], key, first - lo, last - lo, known, min_words)
            left = np.concatenate([[0], np.cumsum(~gone)])[starts]
            kept = made.filter(pa.array(~gone)).cast(pa.large_string())
            data, off = raw(kept)
            ends = off[left].astype(np.int64)
            text = pa.LargeStringArray.from_buffers(b.num_rows, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data)))
            text = pc.if_else(pc.is_null(b.column("text")), pa.scalar(None, pa.large_string()), text).cast(pa.string())
            more = {"text": text, "n_lines": pa.array(count.astype(np.int64)), "n_removed": pa.array((count - np.diff(left)).astype(np.int64))}
            yield pa.RecordBatch.from_arrays([more[c] if c in more else b.column(c) for c in names], names=names)

    kept = [f for f in docs.schema.fields if f.name not in ("n_lines", "n_removed", "_later")]
    schema = T.StructType([T.StructField("text", T.StringType()) if f.name == "text" else f for f in kept] + [T.StructField(c, T.LongType()) for c in ("n_lines", "n_removed")])
    names = schema.names
    later = settle(later)
    rows = docs.select(*[F.col(f"`{f.name}`") for f in kept]).withColumn("_key", F.when(F.col("doc_id").isNotNull(), F.xxhash64(F.col("doc_id").cast("long"))))
    sieve = docs.sparkSession.sparkContext.broadcast(sieve_of(later.select(F.xxhash64("doc_id").alias("key"))))

    def may(b: pa.RecordBatch) -> np.ndarray:
        """Which rows can have later windows; the others never leave their task."""
        key = b.column("_key")
        return sifted(sieve.value, pc.fill_null(key, 0).to_numpy(zero_copy_only=False)) & key.is_valid().to_numpy(zero_copy_only=False)

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.select(names_of_kept).filter(pa.array(may(b)))

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = (b.filter(pa.array(~may(b))) for b in batches)
        return rebuilt(b.append_column("_later", pa.nulls(b.num_rows, pa.list_(pa.int64()))) for b in left)

    names_of_kept = [f.name for f in kept]
    near = rows.mapInArrow(chosen, T.StructType(kept)).join(later.withColumnRenamed("doc_id", "_doc"), F.col("doc_id") == F.col("_doc"), "left").drop("_doc")
    return near.mapInArrow(rebuilt, schema).unionByName(rows.mapInArrow(others, schema))
