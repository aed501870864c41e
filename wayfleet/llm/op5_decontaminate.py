"""Benchmark decontamination by template canonicalisation.

Words lose outer punctuation and case; numbers, names and units become typed placeholders. A name is a
capitalised word that doesn't open a sentence, a unit a known unit word behind a number. Windows of
`size` template words (an item with fewer: all its words) are hashed and joined on the hash; a window with fewer than
`ANCHORS` plain words says too little without its values and is hashed with them. A sieve of bounded size, built by an
aggregate, lets tasks send only document windows that the benchmark may have, in one pass. An
item's repeated windows are one row that stands for all its places, so a window meets an item once.

Windows of one document and item on one alignment fill the item's slots. Each value of the item stands for the value
that most of the alignment's windows give it (of equal counts: its own, then the first in order); windows that
disagree with this filling don't count, those without slots always do. The best alignment covers most words, then
changes fewest slots, then comes first: it alone tells the slots. Alignments whose filling doesn't contradict it (text put in
between moves an item's rest) add to what is covered. An item is found in a document
if windows that count cover `coverage` of its words or more; it is `exact` if every slot holds the
item's own value, else `reparameterised`. Items are also read with their names as plain words, as a copy in lower
case has them, and with their opening word as a name, as it is within a sentence.

Defined results: null or empty texts match nothing; an item of a few words is found wherever all of them stand in a
row; repeated rows of a document give one result; items with equal text are
found alike; other columns are left behind; an empty table on either side gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfleet.llm.common import coded, mix, only, settle, sieve_of, sifted, slices, texts, words

SIZE, COVERAGE, ANCHORS = 8, 0.5, 3
# Unit words that may follow a number.
UNITS = {"mm", "cm", "m", "km", "mg", "g", "kg", "t", "ml", "l", "s", "h", "min", "ms", "hz", "w", "kw", "kwh", "v", "a", "n", "j", "pa", "inch", "inches", "foot", "feet", "yard", "yards", "mile", "miles", "meter", "meters", "metre", "metres", "litre", "litres", "liter", "liters", "gram", "grams", "kilogram", "kilograms", "pound", "pounds", "ounce", "ounces", "second", "seconds", "minute", "minutes", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years", "dollar", "dollars", "euro", "euros", "cent", "cents", "percent", "degree", "degrees", "%", "°c", "°f", "$", "€", "km/h", "mph", "m/s"}
# Number words.
NUMBERS = {"zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "twenty", "thirty", "forty", "fifty", "hundred", "thousand", "million"}
PLAIN, NUMBER, UNIT, MEASURE = range(4)
_NUMBER = re.compile(r"[-+$€£]?\d[\d.,:/]*%?")
_MEASURE = re.compile(r"[-+]?\d[\d.,]*([a-z°/]+)")
_OUTER = ".,;:!?\"'()[]{}“”‘’«»…"


def described(word: str) -> tuple[str, int, bool, bool]:
    """Its plain form, kind, whether it is capitalised, whether it ends a sentence."""
    core = word.strip(_OUTER)
    low = core.lower()
    kind = PLAIN
    if _NUMBER.fullmatch(low) or low in NUMBERS:
        kind = NUMBER
    elif low in UNITS:
        kind = UNIT
    elif (m := _MEASURE.fullmatch(low)) and m[1] in UNITS:
        kind = MEASURE
    return low, kind, core[:1].isupper() and core[1:].islower(), word.rstrip("\"')]”’»")[-1:] in ".!?:"


def templates(a: pa.Array, reading: str = "usual") -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For all texts' words in a row: template hash, hash of the word itself, whether it is a slot, code; each code's plain form; where texts start.

    reading "plain" takes names as plain words, "opening" each text's opening word as a name if it is capitalised.
    """
    flat, starts = words(a)
    code, distinct = coded(flat)
    what = [described(w) for w in distinct.to_numpy(zero_copy_only=False)]
    forms = np.array([w[0] for w in what], dtype=object)
    if not len(code):
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=bool), code, forms, starts
    kind = np.array([w[1] for w in what])[code]
    digest = xxhash.xxh64_intdigest
    itself = np.array([digest(w[0]) for w in what], dtype=np.uint64)[code]
    h = itself.copy()
    ends = np.array([w[3] for w in what])[code]
    opens = np.ones(len(code), dtype=bool)
    opens[1:] = ends[:-1]
    opens[starts[:-1][starts[:-1] < len(code)]] = reading != "opening"
    after = np.zeros(len(code), dtype=bool)
    after[1:] = kind[:-1] == NUMBER
    after[starts[:-1][starts[:-1] < len(code)]] = False
    name = np.array([w[2] for w in what])[code] & ~opens & (kind == PLAIN) & (reading != "plain")
    unit = (kind == UNIT) & after
    for flag, tag in ((kind == NUMBER, "<number>"), (kind == MEASURE, "<measure>"), (unit, "<unit>"), (name, "<name>")):
        h[flag] = digest(tag)
    return h, itself, (kind == NUMBER) | (kind == MEASURE) | unit | name, code, forms, starts


def windowed(a: pa.Array, sizes: list[int], sieve: np.ndarray | None, reading: str = "usual") -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[list[str]]]]:
    """For each window size: the windows' text number, first word, hash and slot values; sieve: only those that it lets through."""
    h, itself, slot, code, forms, starts = templates(a, reading)
    row_of = np.repeat(np.arange(len(a)), np.diff(starts))
    plain = np.concatenate([[0], np.cumsum(~slot)])
    for size in sizes:
        n = len(h) - size + 1
        if n <= 0:
            continue
        few = plain[size:] - plain[:-size] < ANCHORS
        key = np.where(few, np.uint64(size + 100), np.uint64(size))
        for i in range(size):
            key = key * np.uint64(0x9E3779B97F4A7C15) + np.where(few, itself[i : i + n], h[i : i + n])
        key = mix(key)
        at = row_of[:n] == row_of[size - 1 :]
        if sieve is not None:
            at &= sifted(sieve, key)
        at = np.flatnonzero(at)
        values = [forms[code[p : p + size][slot[p : p + size]]].tolist() for p in at]
        yield row_of[at], at - starts[row_of[at]], key[at].view(np.int64), values


def item_windows(items: DataFrame, size: int) -> DataFrame:
    """(item_id, item_words, size, key, item_at, item_slots, places): each benchmark item's different windows in all readings, the first place of each with its slots, and all places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            a = texts(b)
            n = np.diff(words(a)[1])
            for s, reading in product(sorted({int(min(size, x)) for x in n if x}), ("usual", "plain", "opening")):
                for row, at, key, values in windowed(a, [s], None, reading):
                    own = np.minimum(size, n[row]) == s
                    keep = pa.array(row[own])
                    yield pa.RecordBatch.from_arrays(
                        [b.column("item_id").take(keep).cast(pa.int64()), pa.array(n[row[own]].astype(np.int64)), pa.array(at[own].astype(np.int64)), pa.array(np.full(own.sum(), s, dtype=np.int64)), pa.array(key[own]), pa.array([v for v, o in zip(values, own, strict=True) if o], pa.list_(pa.string()))],
                        names=["item_id", "item_words", "item_at", "size", "key", "item_slots"],
                    )

    rows = only(items, item_id="long", text="string").where("item_id is not null").mapInArrow(run, "item_id long, item_words long, item_at long, size long, key long, item_slots array<string>")
    first = F.min(F.struct("item_at", "item_slots")).alias("first")
    rows = rows.groupBy("item_id", "item_words", "size", "key").agg(first, F.array_sort(F.collect_set("item_at")).alias("places"))  # at most an item's words
    return rows.select("item_id", "item_words", "size", "key", "first.item_at", "first.item_slots", "places")


def matches(docs: DataFrame, items: DataFrame, size: int = SIZE) -> DataFrame:
    """(doc_id, at, slots) of document windows beside the item windows of the same template."""
    known = settle(item_windows(items, size))
    sizes = sorted(r[0] for r in known.select("size").distinct().collect())  # at most `size` numbers
    sieve = docs.sparkSession.sparkContext.broadcast(sieve_of(known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            for row, at, key, values in windowed(texts(b), sizes, sieve.value):
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(row)), pa.array(at.astype(np.int64)), pa.array(key), pa.array(values, pa.list_(pa.string()))], names=["doc_id", "at", "key", "slots"])

    got = only(docs, doc_id="long", text="string").where("doc_id is not null").mapInArrow(run, "doc_id long, at long, key long, slots array<string>")
    return got.join(known, "key")


def agreed(windows: list[dict]) -> tuple[list[int], list[tuple[str, str]]]:
    """Of an alignment's windows (places, i and d values side by side): the places of those that agree with its filling, and this filling."""
    fills = [set(zip(w["i"], w["d"], strict=True)) if len(w["i"]) == len(w["d"]) else set() for w in windows]  # else a window of values in two readings
    votes = Counter(f for fill in fills for f in fill)
    stands: dict[str, str] = {}
    for i, d in sorted(votes, key=lambda f: (-votes[f], f[0] != f[1], f[1])):
        stands.setdefault(i, d)
    held = [n for n, fill in enumerate(fills) if all(stands[i] == d for i, d in fill)]
    return sorted({p for n in held for p in windows[n]["places"]}), sorted({f for n in held for f in fills[n]})


def aligned(met: DataFrame) -> DataFrame:
    """(doc_id, item_id, item_words, size, shift, places, i, d): for each alignment the item's places that count, and its filling (i stands for d)."""
    names = ["doc_id", "item_id", "item_words", "size", "shift"]
    lined = met.withColumn("shift", F.col("at") - F.col("item_at")).groupBy(*names).agg(F.collect_set(F.struct("places", F.col("item_slots").alias("i"), F.col("slots").alias("d"))).alias("windows"))  # at most an item's windows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                done = [agreed(w) for w in part.column("windows").to_pylist()]
                cols = [pa.array([p for p, _ in done], pa.list_(pa.int64())), *(pa.array([[f[k] for f in fill] for _, fill in done], pa.list_(pa.string())) for k in (0, 1))]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in names] + cols, names=[*names, "places", "i", "d"])

    return lined.mapInArrow(run, ", ".join(f"{c} long" for c in names) + ", places array<long>, i array<string>, d array<string>")


def covered_words(places: Column, size: Column) -> Column:
    """How many words windows of this size at these places (in order) cover."""
    gaps = F.zip_with(places, F.slice(places, 2, F.size(places)), lambda p, q: F.least(F.coalesce(q - p, size), size))
    return F.aggregate(gaps, F.lit(0).cast("long"), lambda s, x: s + x)


def decontaminate(docs: DataFrame, items: DataFrame, size: int = SIZE, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, item_id, covered, item_words, n_slots, n_changed, verdict) for each item found in a document."""
    pair = ["doc_id", "item_id", "item_words", "size"]
    fill = F.arrays_zip("i", "d")
    changed = F.size(F.filter(fill, lambda f: f["i"] != f["d"])).cast("long")
    lined = settle(aligned(matches(docs, items, size)).where(F.size("places") > 0).select(*pair, "shift", "places", fill.alias("fill"), changed.alias("n_changed"), covered_words(F.col("places"), F.col("size")).alias("own")))
    best = lined.groupBy(*pair).agg(F.max_by(F.struct("fill", "n_changed"), F.struct("own", -F.col("n_changed"), -F.col("shift"))).alias("best"))
    against = F.exists("fill", lambda f: F.exists("best.fill", lambda g: (f["i"] == g["i"]) & (f["d"] != g["d"])))
    places = lined.join(best, pair).where(~against).select(*pair, F.explode("places").alias("place")).distinct()
    whole = places.groupBy(*pair).agg(F.array_sort(F.collect_list("place")).alias("places"))  # at most an item's words
    out = whole.join(best, pair).select("doc_id", "item_id", covered_words(F.col("places"), F.col("size")).alias("covered"), "item_words", F.size("best.fill").cast("long").alias("n_slots"), F.col("best.n_changed").alias("n_changed"))
    return out.where(F.col("covered") >= coverage * F.col("item_words")).withColumn("verdict", F.when(F.col("n_changed") > 0, "reparameterised").otherwise("exact"))
