"""Token counts of sections by offset mapping.

Whole documents are encoded once. The ids' byte lengths give each token's span of characters, and a
merge join of the sorted token spans with the sorted section spans attributes tokens to sections.
Rule for a token over a boundary, `rule`: "most" gives it to the section with most of its characters
(the earlier one if equal), "start" to the section of its first character. A token inside one
character belongs to that character's section.

Sections of a document are its lines, each with its line end, so they cover every character.

Defined results: a null or empty text has one empty section of no tokens; repeated rows are counted
as often as they come; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from wayfleet.llm import tokens
from wayfleet.llm.common import only, raw, slices, texts

SCHEMA = "doc_id long, section_no long, start_char long, end_char long, n_tokens long, n_crossing long, doc_tokens long"


def attribute(starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Per token its section's number, and whether it reaches over a boundary. bounds: sorted, first 0, last the end."""
    inner = bounds[1:-1]
    first = np.searchsorted(inner, starts, side="right")
    last = np.searchsorted(inner, np.maximum(ends - 1, starts), side="right")
    over = last > first
    if rule == "start" or not over.any():
        return first, over
    owner = first.copy()
    for t in np.flatnonzero(over):  # a few tokens a document; each spans few sections
        s = np.arange(first[t], last[t] + 1)
        owner[t] = s[np.argmax(np.minimum(bounds[s + 1], ends[t]) - np.maximum(bounds[s], starts[t]))]
    return owner, over


def token_counts(docs: DataFrame, path: str, rule: str = "most") -> DataFrame:
    """One row per section of each document (doc_id, text): its characters and its tokens."""
    if rule not in ("most", "start"):
        raise ValueError("rule is 'most' or 'start'")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokens.encoder(path)
        size = coder.bytes
        for b in slices(batches):
            a = texts(b)
            ids, starts = coder.flat(a)
            data, off = raw(a)
            char = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # characters begun before each byte
            byte = np.concatenate([[0], np.cumsum(size[ids])])
            cols: list[list[np.ndarray]] = [[] for _ in range(7)]
            for row, doc in enumerate(b.column("doc_id").to_pylist()):
                lo, hi = off[row], off[row + 1]
                lead = char[lo]
                t = byte[starts[row] : starts[row + 1] + 1]
                t = t - t[0] + lo
                ends = char[t[1:]] - lead
                begin = np.minimum(char[t[:-1]], char[np.minimum(t[:-1] + 1, hi)] - 1) - lead
                lines = char[lo + np.flatnonzero(data[lo:hi] == 10) + 1] - lead
                whole = char[hi] - lead
                bounds = np.unique(np.concatenate([[0], lines, [whole]])) if whole else np.array([0, 0])
                owner, over = attribute(begin, np.maximum(ends, begin + 1), bounds, rule)
                n = len(bounds) - 1
                for c, v in zip(cols, (np.full(n, -1 if doc is None else doc), np.arange(n), bounds[:-1], bounds[1:], np.bincount(owner, minlength=n), np.bincount(owner[over], minlength=n), np.full(n, len(t) - 1)), strict=True):
                    c.append(v)
            doc = b.column("doc_id").take(pa.array(np.repeat(np.arange(b.num_rows), [len(x) for x in cols[0]])))
            yield pa.RecordBatch.from_arrays([doc.cast(pa.int64()), *[pa.array(np.concatenate(c).astype(np.int64)) for c in cols[1:]]], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return only(docs, doc_id="long", text="string").mapInArrow(run, SCHEMA)
