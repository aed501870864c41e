"""Harmonic packing of documents into training sequences.

Lengths fall into reciprocal-capacity classes: class k holds lengths over capacity/(k+1) up to
capacity/k, and each bin of class k takes exactly k pieces. Documents may be cut, so a document is
first cut into full sequences, its rest at the ceilings of the classes k = 2, 4, 8, ... down to
`min_piece`, and what is shorter stays one piece. Every class then holds pieces of one length, and a
full bin of class k leaves capacity modulo that length free. Each worker (input partition) fills its
bins alone and in one pass; pieces in bins that its last row leaves open are dealt next-fit in falling
length into common bins, so a worker pads about one sequence. Nothing is shuffled.

Defined results: a null text is empty (one piece with the end id alone); repeated rows are packed as
often as they come; a null doc_id is carried; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from wayfleet.llm import tokens
from wayfleet.llm.common import only, slices, texts

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def cuts(length: int, capacity: int, min_piece: int) -> list[int]:
    """The lengths of a document's pieces, in order."""
    out = [capacity] * (length // capacity)
    rest, size = length % capacity, capacity // 2
    while size >= min_piece and rest:
        if rest >= size:
            out.append(size)
            rest -= size
        size //= 2
    return out + [rest] * (rest > 0)


class Bins:
    """One worker's open bins: a class fills one bin at a time with exactly k pieces."""

    def __init__(self, capacity: int, first: int):
        self.capacity, self.next = capacity, first
        self.open: dict[int, list] = {}

    def new(self) -> int:
        self.next += 1
        return self.next - 1

    def add(self, piece: list) -> Iterator[list]:
        """Takes a piece (its length third); gives the pieces of a bin that it fills, placed."""
        k = self.capacity // piece[2]
        held = self.open.setdefault(k, [])
        held.append(piece)
        if len(held) == k:
            del self.open[k]
            yield from self.place(held)

    def place(self, pieces: list[list]) -> Iterator[list]:
        bin_id, at = self.new(), 0
        for p in pieces:
            yield [*p, bin_id, at]
            at += p[2]

    def rest(self) -> Iterator[list]:
        """The pieces of bins still open, next-fit by falling length."""
        held, size = [], 0
        for p in sorted((p for bin_ in self.open.values() for p in bin_), key=lambda p: -p[2]):
            if size + p[2] > self.capacity:
                yield from self.place(held)
                held, size = [], 0
            held.append(p)
            size += p[2]
        if held:
            yield from self.place(held)


def pack(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 1, min_piece: int = 32) -> DataFrame:
    """One row per piece of each document (doc_id, text); see SCHEMA."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, bins = tokens.encoder(path), Bins(capacity, TaskContext.get().partitionId() << 40)
        for b in slices(batches):
            ids, starts = coder.flat(texts(b))
            out: list[list] = []
            for row, doc in enumerate(b.column("doc_id").to_pylist()):
                own = np.append(ids[starts[row] : starts[row + 1]], end_id).astype("<u4")
                at = 0
                for n in cuts(len(own), capacity, min_piece):
                    out.extend(bins.add([doc, at, n, zlib.crc32(own[at : at + n]), len(own)]))
                    at += n
            yield from made(out)
        yield from made(list(bins.rest()))

    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def made(rows: list[list]) -> Iterator[pa.RecordBatch]:
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)

    return only(docs, doc_id="long", text="string").mapInArrow(run, SCHEMA)
