"""Conversation structure repair: a square-root checkpointed DP for the cheapest edits, ASCII-least among them.

Rows of a conversation come in order of turn, nulls first; ties go by role, then by the digest md5(md5(role) + text), so
that texts needn't travel to be ordered, and then as they stand (they are equal). Edits are Keep (0), Rerole to user or
assistant (3), Delete (4, the only one for blank and duplicate rows) and Insert an empty turn (3); a truncated row that
isn't deleted adds 3. The roles' initials must read `(s?(ua)+)?`: four states, in which R and I each give one role only,
so that an audit string says all about its edits. The backward vector of a place holds the least cost from each state
to the end. Going forward, the ASCII-least edit that keeps to that cost is taken each time.

Of a stretch of rows, a task keeps only the backward vectors behind blocks of about the square root of its length, and
computes a block's other vectors anew when the walk forward comes to it. Rows (without texts) are range-partitioned by
conversation and order, so a conversation may lie in many tasks: then each of its stretches gives its 4 x 4 costs from
state to state; these are multiplied (least sums) from the end to give the vector behind each stretch, then each
stretch gives the state it leads to from each state, and these are followed from the front. The driver holds a row or two
for each partition for this. Vectors are kept relative to their least cost, of which few exist, so steps are cached.

`digests` folds the operator's rows in order with constant memory. SHA-256 has no parallel form, so this fold alone takes a conversation in
one task, a batch of rows at a time.

Defined results: a null role or text is one space, and a null conv_id a conversation of its own; an empty role has no initial and can't be
kept; equal rows of one turn are duplicates; a conversation whose rows all went keeps its row, with zeros and empty
strings; other columns are left behind; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from math import isqrt

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfleet.llm.common import only, settle, written

SPACE = " \t\n\x0b\x0c\r"
#: States: at the start, behind a system turn, behind a user turn, behind an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
#: What an inserted or reroled turn leads to, and its role's initial.
NEXT, GIVES = (USER, USER, ASSISTANT, USER), "uuau"
#: Where rows lead when they are kept, by kind (0, 1, 2: the role's initial is s, u, a) and state; others can't be kept.
KEPT = {(0, START): SYSTEM, (1, START): USER, (1, SYSTEM): USER, (1, ASSISTANT): USER, (2, USER): ASSISTANT}
FAULTS = ("", "blank", "duplicate", "truncated")
INSERT, REROLE, DELETE, TRUNCATED = 3, 3, 4, 3
FAR = 1 << 40
ROLES = {"u": "user", "a": "assistant"}
ROWS = 10_000

Vector = tuple[int, int, int, int]


def relaxed(v: Vector) -> Vector:
    """A vector of costs where turns may be inserted first."""
    for _ in range(3):
        v = tuple(min(v[q], INSERT + v[NEXT[q]]) for q in range(4))
    return v


END = relaxed((0, FAR, FAR, 0))


@lru_cache(maxsize=1 << 16)
def ways(code: int, behind: Vector, q: int) -> tuple[tuple[str, int, int], ...]:
    """Edits of a row of this code (kind * 4 + fault) from a state: (letter, cost to the end, next state)."""
    kind, fault = divmod(code, 4)
    found = [("D", DELETE + behind[q], q)]
    if fault in (0, 3):
        more = TRUNCATED if fault else 0
        if (kind, q) in KEPT:
            to = KEPT[kind, q]
            found.append(("K", more + behind[to], to))
        found.append(("R", REROLE + more + behind[NEXT[q]], NEXT[q]))
    return tuple(found)


@lru_cache(maxsize=1 << 16)
def back(code: int, behind: Vector) -> tuple[Vector, int]:
    """The vector before a row from the one behind it, less its least cost; and that cost."""
    v = relaxed(tuple(min(cost for _, cost, _ in ways(code, behind, q)) for q in range(4)))
    low = min(v)
    return tuple(min(c - low, FAR) for c in v), low


@lru_cache(maxsize=1 << 16)
def forth(code: int, behind: Vector, q: int) -> tuple[str, str, int, int]:
    """The ASCII-least cheapest edits at a row: initials of turns inserted before it, its letter, its cost with these, and the state behind it."""
    v = relaxed(tuple(min(cost for _, cost, _ in ways(code, behind, s)) for s in range(4)))
    before, paid = "", 0
    while True:
        tight = {letter: (cost, to) for letter, cost, to in ways(code, behind, q) if cost == v[q]}
        if "D" not in tight and INSERT + v[NEXT[q]] == v[q]:
            before, paid, q = before + GIVES[q], paid + INSERT, NEXT[q]
            continue
        letter = min(tight)
        cost, to = tight[letter]
        return before, letter, paid + cost - behind[to], to


def ending(q: int) -> str:
    """Initials of the turns inserted at the end."""
    out = ""
    while END[q]:
        out, q = out + GIVES[q], NEXT[q]
    return out


def walk(codes: bytes, behind: Vector, q: int) -> Iterator[tuple[str, str, int, int]]:
    """forth() of each row of a stretch that begins in state q, with the vector behind it; held are the vectors behind blocks, and one block's."""
    n = len(codes)
    k = isqrt(n) + 1
    cuts = range(0, n, k)
    marks = []
    for at in reversed(cuts):
        marks.append(behind)
        for code in reversed(codes[at : at + k]):
            behind, _ = back(code, behind)
    for at in cuts:
        block = codes[at : at + k]
        vectors = [marks.pop()]
        for code in reversed(block[1:]):
            vectors.append(back(code, vectors[-1])[0])
        for code in block:
            step = forth(code, vectors.pop(), q)
            q = step[3]
            yield step


def costs(codes: bytes) -> list[int]:
    """A stretch's least costs from each state to each, row by row of a 4 x 4 matrix."""
    cols = []
    for e in range(4):
        v, total = tuple(0 if q == e else FAR for q in range(4)), 0
        for code in reversed(codes):
            v, low = back(code, v)
            total += low
        cols.append([min(c + total, FAR) for c in v])
    return [cols[e][q] for q in range(4) for e in range(4)]


def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, array, bytes, str]]:
    """Rows (conv_id, id, code) in order -> a conversation's ids and codes in this task, and its place: first, last, only or inner."""
    none = object()
    conv, ids, codes, first = none, array("q"), bytearray(), True
    for b in batches:
        for c, i, k in zip(*(b.column(n).to_pylist() for n in ("conv_id", "id", "code")), strict=True):
            if conv is none or c != conv:
                if conv is not none:
                    yield conv, ids, bytes(codes), "first" if first else "inner"
                    first = False
                conv, ids, codes = c, array("q"), bytearray()
            ids.append(i)
            codes.append(k)
    if conv is not none:
        yield conv, ids, bytes(codes), "only" if first else "last"


def joints(rows: DataFrame) -> dict[tuple[int, str], tuple[int, Vector, bool]]:
    """For each stretch that shares its conversation with another task's: the state it begins in, the vector behind it, and whether the conversation ends with it.

    rows (conv_id, id, code) lie in order over partitions. A partition has two such stretches at most.
    """

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId()
        found = [(at, place, c, costs(codes)) for c, _, codes, place in stretches(batches) if place != "inner"]
        yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate((pa.int64(), pa.string(), pa.int64(), pa.list_(pa.int64())))], names=["at", "place", "conv_id", "costs"])

    ends = rows.mapInArrow(measured, "at long, place string, conv_id long, costs array<long>").toArrow().to_pylist()
    ends.sort(key=lambda r: (r["at"], r["place"] == "last"))
    chains: list[list[dict]] = []
    for r in ends:
        if chains and r["place"] != "last" and chains[-1][-1]["conv_id"] == r["conv_id"]:
            chains[-1].append(r)
        else:
            chains.append([r])
    chains = [c for c in chains if len(c) > 1]
    behind: dict[tuple[int, str], Vector] = {}
    for chain in chains:
        v = END
        for r in reversed(chain):
            low = min(v)
            behind[r["at"], r["place"]] = tuple(c - low for c in v)
            v = relaxed(tuple(min(r["costs"][4 * q + e] + v[e] for e in range(4)) for q in range(4)))
    if not chains:
        return {}
    shared = rows.sparkSession.sparkContext.broadcast(behind)

    def followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, found = TaskContext.get().partitionId(), []
        for _, _, codes, place in stretches(batches):
            if (at, place) in shared.value:
                to = []
                for q in range(4):
                    for *_, q in walk(codes, shared.value[at, place], q):
                        pass
                    to.append(q)
                found.append((at, place, to))
        yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate((pa.int64(), pa.string(), pa.list_(pa.int64())))], names=["at", "place", "to"])

    lead = {(r["at"], r["place"]): r["to"] for r in rows.mapInArrow(followed, "at long, place string, to array<long>").toArrow().to_pylist()}
    out = {}
    for chain in chains:
        q = START
        for r in chain:
            key = r["at"], r["place"]
            out[key] = q, behind[key], r is chain[-1]
            q = lead[key][q]
    return out


def edits(rows: DataFrame) -> DataFrame:
    """rows (conv_id, id, code), in order over partitions -> (id, at, fault, before, edit, gives, after, cost) of each; at orders all of them."""
    known = rows.sparkSession.sparkContext.broadcast(joints(rows))
    types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64())
    names = ["id", "at", "fault", "before", "edit", "gives", "after", "cost"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = TaskContext.get().partitionId()
        at, found = here << 33, []
        for _, ids, codes, place in stretches(batches):
            q, behind, ends = known.value.get((here, place), (START, END, True))
            for n, (id, code, (before, letter, cost, to)) in enumerate(zip(ids, codes, walk(codes, behind, q), strict=True), 1):
                after = ending(to) if ends and n == len(codes) else ""
                state = q
                for _ in before:
                    state = NEXT[state]
                found.append((id, at, FAULTS[code % 4], before, letter, GIVES[state] if letter == "R" else "", after, cost + INSERT * len(after)))
                at, q = at + 1, to
                if len(found) == ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)], names=names)
                    found = []
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)], names=names)

    return rows.mapInArrow(run, "id long, at long, fault string, before string, edit string, gives string, after string, cost long")


def faults() -> tuple[Column, Column]:
    """Whether a row's text is blank, and whether it is cut off."""
    kept = F.rtrim(F.col("text"), F.lit(SPACE))
    return F.ltrim(kept, F.lit(SPACE)) == "", ~F.right(kept, F.lit(1)).isin(".", "!", "?")


def repair(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text) -> conv_id, at (their order), turn, role, text and the edits of each row: fault, before and after (initials of turns inserted there), edit (D, K or R), gives (the initial that R gives), cost."""
    rows = only(rows, conv_id="long", turn="long", role="string", text="string")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(" ")) for c in ("role", "text")})
    blank, cut = faults()
    initial = F.left("role", F.lit(1))
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    fault = F.when(blank, 1).when(cut, 3).otherwise(0)
    rows = rows.withColumns({"id": F.monotonically_increasing_id(), "digest": F.md5(F.concat(F.md5("role"), F.col("text"))), "kind": kind, "fault": fault})
    rows = written(rows, "op13")
    narrow = rows.select("conv_id", "turn", "role", "digest", "id", "kind", "fault")
    firsts = narrow.groupBy("conv_id", "digest").agg(F.min(F.struct("turn", "id")).getField("id").alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("conv_id").alias("_conv"), F.col("digest").alias("_digest"), "first")
    met = narrow.join(firsts, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("digest") == F.col("_digest")), "left")
    later = (F.col("fault") != 1) & (F.col("first") != F.col("id"))
    met = met.withColumn("code", 4 * F.col("kind") + F.when(later, 2).otherwise(F.col("fault")))
    order = ["conv_id", "turn", "role", "digest", "id"]
    placed = settle(met.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "id", "code"))
    return rows.select("conv_id", "turn", "role", "text", "id").join(edits(placed), "id").drop("id")


def repaired(done: DataFrame) -> DataFrame:
    """repair()'s rows -> the repaired conversations' turns (conv_id, at, place, turn, role, text): in order of at, then place; an inserted turn has no number."""
    role = lambda c: F.when(c == "u", "user").otherwise("assistant")
    turn = lambda place, no, who, what: F.struct(place.cast("int").alias("place"), no.cast("long").alias("turn"), who.alias("role"), what.alias("text"))
    added = lambda name, shift: F.transform(F.filter(F.split(name, ""), lambda c: c != ""), lambda c, i: turn(i + shift, F.lit(None), role(c), F.lit("")))
    own = F.when(F.col("edit") == "D", F.array()).otherwise(F.array(turn(F.length("before"), F.col("turn"), F.when(F.col("edit") == "R", role(F.col("gives"))).otherwise(F.col("role")), F.col("text"))))
    turns = F.concat(added("before", F.lit(0)), own, added("after", F.length("before") + 1))
    return done.select("conv_id", "at", F.explode(turns).alias("t")).select("conv_id", "at", "t.*")


DIGEST = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


class _Fold:
    """What is told of one conversation, row after row."""

    def __init__(self, conv: int | None):
        self.conv, self.low, self.high, self.turns = conv, None, None, 0
        self.faults, self.illegal, self.cost = dict.fromkeys(FAULTS, 0), 0, 0
        self.audit, self.sha, self.any, self.role = [], hashlib.sha256(), False, None

    def say(self, role: str, text: str) -> None:
        self.sha.update(f"{'\n' if self.any else ''}{role}:{text}".encode())
        self.any = True

    def take(self, turn, role, text, fault, before, edit, gives, after, cost) -> None:
        if turn is not None and turn != self.high:
            self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
        self.illegal += self.role is not None and self.role + role[:1] not in ("su", "ua", "au")
        self.role = role[:1]
        self.faults[fault] += 1
        self.cost += cost
        self.audit.append("I" * len(before) + edit + "I" * len(after))
        for c in before:
            self.say(ROLES[c], "")
        if edit != "D":
            self.say(ROLES[gives] if edit == "R" else role, text)
        for c in after:
            self.say(ROLES[c], "")

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return self.conv, gaps, *(self.faults[f] for f in FAULTS[1:]), self.illegal, self.cost, "".join(self.audit), self.sha.hexdigest()


def digests(done: DataFrame, ids: DataFrame) -> DataFrame:
    """DIGEST of each conversation of ids (conv_id, distinct), from repair()'s rows."""
    columns = ["turn", "role", "text", "fault", "before", "edit", "gives", "after", "cost"]
    rows = done.select("conv_id", "at", *columns).unionByName(ids.select("conv_id", F.lit(-1).cast("long").alias("at")), allowMissingColumns=True)
    kinds = [pa.int64()] * 7 + [pa.string()] * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold, out = None, []
        for b in batches:
            for conv, at, *row in zip(*(b.column(n).to_pylist() for n in ("conv_id", "at", *columns)), strict=True):
                if fold is None or conv != fold.conv:
                    if fold is not None:
                        out.append(fold.row())
                    fold = _Fold(conv)
                if at >= 0:
                    fold.take(*row)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=[c.split()[0] for c in DIGEST.split(", ")])
                out = []
        if fold is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(fold.row(), kinds, strict=True)], names=[c.split()[0] for c in DIGEST.split(", ")])

    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "at").mapInArrow(run, DIGEST)


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with planted faults, by crc32(conv_id:turn) modulo 20; nulls are one space."""
    rows = only(rows, conv_id="long", turn="long", role="string", text="string")
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.crc32(F.concat_ws(":", told("conv_id"), told("turn"))) % 20
    text = F.when(k == 1, "").when(k == 2, F.translate(told("text"), ".!?", "")).otherwise(told("text"))
    rows = rows.select("conv_id", "turn", F.when(k == 4, "user").otherwise(told("role")).alias("role"), text.alias("text"), k.alias("k")).where("k <> 0")
    return rows.withColumn("again", F.explode(F.when(F.col("k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("k", "again")
