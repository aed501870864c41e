"""Sanitisation, ranked search and conversation repair against plain Python, with nulls, ties, repeats and clashing columns."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from wayfleet.llm import common, op11_sanitise, op12_nra, op13_repair, queries

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


@pytest.fixture(autouse=True)
def small_slices(monkeypatch):
    monkeypatch.setattr(common, "SLICE_BYTES", 5_000)


def duck(sql, **tables):
    con = duckdb.connect()
    for name, rows in tables.items():
        con.register(name, pa.table(rows))
    run = con.execute(sql)
    return [d[0] for d in run.description], run.fetchall()


# Sanitisation --------------------------------------------------------------------------------------

EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def checks(digits):
    twice = [int(d) * (1 + (i % 2)) for i, d in enumerate(reversed(digits))]
    return sum(t - 9 if t > 9 else t for t in twice) % 10 == 0


def brute_base(text):
    text, found = text or "", []
    figures = lambda m: re.sub("[^0-9]", "", m.group())
    found += [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    found += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 14 <= len(figures(m)) <= 19 and checks(figures(m))]
    found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(figures(m)) <= 15]
    return sorted(found)


def brute_values(text):
    out = []
    for s, k, e in brute_base(text):
        m = text[s:e]
        out.append((s, k, e, m.translate(LOWER) if k == 0 else ".".join(str(int(p)) for p in m.split(".")) if k == 1 else re.sub("[^0-9]", "", m)))
    return out


def brute_terms(text, spans):
    return [(m.group().translate(LOWER), m.start(), m.end()) for m in TERM.finditer(text or "") if all(m.end() <= s or m.start() >= e for s, _, e, *_ in spans)]


def brute_spans(rows):
    df, docs_of, contexts = Counter(), Counter(), defaultdict(Counter)
    for text in rows:
        df.update({t.translate(LOWER) for t in TERM.findall(text or "")})
        spans = brute_values(text or "")
        terms, first = brute_terms(text, spans), {}
        for s, k, e, v in spans:
            near = [t for t, a, b in terms if b <= s][-8:] + [t for t, a, b in terms if a >= e][:8]
            for t in ("", *near):
                first.setdefault(((k, v), t), tuple(near))
        for pair, c in first.items():
            docs_of[pair] += 1
            contexts[pair][c] += 1
    worst = defaultdict(float)
    for (e, t), both in docs_of.items():
        if t and len(contexts[e, t]) >= 3 and len(contexts[e, ""]) >= 3 and docs_of[e, ""] < len(rows):
            share = math.log(both * len(rows) / (df[t] * docs_of[e, ""])) / math.log(len(rows) / docs_of[e, ""])
            worst[t] = max(worst[t], share)
    out = []
    for text in rows:
        base = brute_base(text)
        more = [(s, 5 if worst[t] >= 0.97 else 4, e) for t, s, e in brute_terms(text, base) if worst[t] >= 0.9]
        out.append((base, sorted(base + more)))
    return out


ODD = [
    "", None, " ", "@a.b", "x@a.b@c.d @e.f", "a@b.c.d_e a@b c@d..e f@-.- +.%@x.y.", "1.2.3.4.5.6.7.8 256.1.1.1 001.2.3.4 1.2.3. 9.9.9", "é1.2.3.4é@x.yé ", "4111 1111 1111 1111 4111-1111-1111-1112 4111  1111",
    "4111111111111111 12 41111111111111111111", "a card: 4111 1111 1111 1111, and 4111 1111 1111 1112.", "+1 (555) 555-1234) +12 +1 23456789 0123456", "+1.2.3.4.5.6.7.8.9.10 ", "1" * 3000 + "." + "2" * 400, "a" * 5000 + "@", "a@" + "b." * 2000 + "c", "+1" + " " * 3000 + "2" * 9, "𝟙 x@y.zz ü@y.zz +1-234-567-8901@a.b",
]


def test_base_spans_are_the_literal_patterns():
    rng = np.random.default_rng(3)
    some = ["".join(rng.choice(list("aZ1. @-+()4é,"), 60)) for _ in range(3000)]
    for text in ODD + some:
        assert [s[:3] for s in op11_sanitise.base_spans(text or "")] == brute_base(text), text


@pytest.fixture(scope="module")
def leaky():
    rng = np.random.default_rng(8)
    word = lambda: f"w{rng.integers(0, 400)}"
    rows = [" ".join(word() for _ in range(60)) for _ in range(300)]
    for i in range(12):  # an address that always comes with a codename, and mostly with a town
        rows[i] = f"{rows[i][:80]} {'Qoph' if i else ''} Zephyr9 of {'Brigham' if i % 4 else 'elsewhere'} writes boss@corp{'.' if i else '-'}example.com {word()} {rows[i][80:]} ZEPHYR9"
    rows[40] += " brigham"
    rows[41:44] = [f"once copied Solo text {i // 9} me@solo.org and nothing else" for i in range(3)]  # copies: one context
    return ODD + rows + [rows[0], rows[0]]


def test_disclosing_terms(spark, leaky):
    frame = spark.createDataFrame([(None if i % 50 == 7 else i, t, "x", 1) for i, t in enumerate(leaky)], "doc_id long, text string, spans string, key int").repartition(5)
    done = op11_sanitise.digests(op11_sanitise.personal_data(frame))
    got = Counter(tuple(r) for r in done.collect())
    want, kinds = Counter(), Counter()
    for (i, text), (base, spans) in zip(enumerate(leaky), brute_spans(leaky), strict=True):
        n = Counter(k for _, k, _ in base)
        say = lambda found: ",".join(f"{op11_sanitise.KINDS[k]}:{s}:{e}" for s, k, e in found)
        want[None if i % 50 == 7 else i, *(n[k] for k in range(4)), hashlib.sha256(say(base).encode()).hexdigest(), say(spans)] += 1
        kinds.update(k for _, k, _ in spans)
    assert got == want
    assert all(kinds[k] for k in range(6))
    texts = {r["doc_id"]: r["text"] for r in op11_sanitise.sanitised(frame).collect()}
    assert "[email]" in texts[len(ODD) + 1] and "Qoph" not in texts[len(ODD) + 1] and "ephyr" not in texts[len(ODD) + 1].lower() and texts[len(ODD) + 50] == leaky[len(ODD) + 50] and texts[1] is None


def test_rewritten_overlaps():
    spans = [{"start": 0, "kind": 2, "end": 5}, {"start": 3, "kind": 3, "end": 8}, {"start": 9, "kind": 4, "end": 12}, {"start": 13, "kind": 5, "end": 15}]
    assert op11_sanitise.rewritten("01234567 Abc de!", spans) == "[card] [name] !"


def test_nothing_to_sanitise(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert op11_sanitise.digests(op11_sanitise.personal_data(empty)).count() == 0
    nulls = spark.createDataFrame([(1, None)], "doc_id long, text string")
    assert op11_sanitise.digests(op11_sanitise.personal_data(nulls)).first()["base_sha256"] == hashlib.sha256(b"").hexdigest()


# Ranked search -------------------------------------------------------------------------------------


def brute_ranked(rows, items, k=20):
    docs = [(d, Counter(t.translate(LOWER) for t in TERM.findall(text or ""))) for d, text in rows]
    n, total = sum(bool(c) for _, c in docs), sum(c.total() for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    wanted = defaultdict(Counter)
    for i, text in set(items):
        wanted[i].update(t.translate(LOWER) for t in TERM.findall(text or ""))
    out = []
    for i, ask in wanted.items():
        scored = []
        for d, c in docs:
            m = 75 + (25 * c.total() * n) // total if total else 0
            s = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, q in ask.items() if c[t])
            if s > 0:
                scored.append((-s, d is None, d or 0))
        out += [(i, r, None if null else d, -s) for r, (s, null, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def library():
    rng = np.random.default_rng(5)
    p = 1 / np.arange(1, 301)
    words = lambda n: " ".join(f"t{x}" if x % 7 else f"É{x}x-T{x}" for x in rng.choice(300, n, p=p / p.sum()))
    rows = [(i, words(int(rng.integers(1, 80)))) for i in range(500)] + [(600, words(6000))]
    rows += [(700 + i, "t5 t6 t7") for i in range(40)] + [(None, "t5 t6 t7"), (None, "t5 t6"), (701, "t5 t6 t7"), (800, None), (801, ""), (802, " \n-")]
    items = [(i, words(12)) for i in range(12)] + [(20, "t5 T6 t5"), (21, "nowhere"), (22, None), (23, ""), (None, "t8"), (0, "t9 t9"), (20, "t5 T6 t5")]
    return rows, items


@pytest.mark.parametrize("shard,block", [(1 << 20, 1 << 18), (300, 40)])
def test_ranked(spark, library, monkeypatch, shard, block):
    monkeypatch.setattr(op12_nra, "SHARD", shard)
    monkeypatch.setattr(op12_nra, "BLOCK", block)
    monkeypatch.setattr(op12_nra, "DEPTH", 4)
    rows, items = library
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, score int, item_id string").repartition(3)
    asked = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, rank int")
    got = sorted((tuple(r) for r in op12_nra.ranked(docs, asked).collect()), key=repr)
    assert got == brute_ranked(rows, items)


def test_ranked_sql_and_empty_tables(spark, library):
    rows, items = library
    named = lambda r, a: {a: pa.array([x for x, _ in r], pa.int64()), "text": pa.array([t for _, t in r], pa.string())}
    names, got = duck(queries.OP12_SQL, documents=named(rows, "doc_id"), benchmark=named(items, "item_id"))
    assert names == ["item_id", "rank", "doc_id", "score"] and sorted(got, key=repr) == brute_ranked(rows, items)
    docs, asked = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for d, a in ((docs.limit(0), asked), (docs, asked.limit(0)), (docs.where("text is null"), asked)):
        assert op12_nra.ranked(d, a).collect() == []


def test_reading_stops_early():
    rng = np.random.default_rng(1)
    doc, term = np.arange(4000), np.zeros(4000, dtype=np.int64)
    impact = np.sort(rng.integers(1, 10**6, 4000))[::-1].copy()
    shard = op12_nra.Shard(doc, term, impact, 4000, 1)
    found, score = shard.nra(np.array([0]), np.array([2]), 20, 1)
    assert len(found) < 100 and sorted(score)[-20:] == sorted(2 * impact[:20])


# Conversation repair -------------------------------------------------------------------------------

SPACES = " \t\n\x0b\x0c\r"


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        told = lambda v: " " if v is None else v
        k = zlib.crc32(f"{told(conv)}:{told(turn)}".encode()) % 20
        role, text = told(role), told(text)
        if k:
            row = (conv, turn, "user" if k == 4 else role, "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text)
            out += [row] * (2 if k == 3 else 1)
    return out


def md5(s):
    return hashlib.md5(s.encode()).hexdigest()


def ordered(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], md5(md5(r[2]) + r[3])))


def fault_of(rows):
    seen, out = set(), []
    for *_, role, text in rows:
        own = text.strip(SPACES)
        out.append("blank" if not own else "duplicate" if (role, text) in seen else "truncated" if own[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, faults):
    """Least (cost, audit, turns) over states, row by row, turns inserted in front of each row and at the end."""
    best = {"": (0, "", ())}
    give = {"": "user", "s": "user", "u": "assistant", "a": "user"}

    def put(into, state, way):
        into[state] = min(into.get(state, way), way)

    def inserted(best):
        best = dict(best)
        for _ in range(3):
            for q, (c, a, t) in list(best.items()):
                put(best, give[q][0], (c + 3, a + "I", (*t, f"{give[q]}:")))
        return best

    for (*_, role, text), fault in zip(rows, faults, strict=True):
        after = {}
        for q, (c, a, t) in inserted(best).items():
            put(after, q, (c + 4, a + "D", t))
            if fault in ("", "truncated"):
                more = 3 * (fault == "truncated")
                if (q, role[:1]) in {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}:
                    put(after, role[0], (c + more, a + "K", (*t, f"{role}:{text}")))
                put(after, give[q][0], (c + more + 3, a + "R", (*t, f"{give[q]}:{text}")))
        best = after
    best = inserted(best)
    return min(best[q] for q in ("", "a") if q in best)


def brute_repair(rows):
    by = defaultdict(list)
    for r in rows:
        by[r[0]]
    for r in brute_damage(rows):
        by[r[0]].append(r)
    out = []
    for conv, own in by.items():
        own = ordered(own)
        faults = fault_of(own)
        turns = {t for _, t, *_ in own if t is not None}
        cost, audit, said = cheapest(own, faults)
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        n = Counter(faults)
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def talks():
    rng = np.random.default_rng(4)
    role = lambda: str(rng.choice(["user", "assistant", "system", "tool", "", "sage", "User"], p=[0.35, 0.35, 0.1, 0.05, 0.05, 0.05, 0.05]))
    text = lambda: str(rng.choice(["Hello there.", "cut off", "Why?", "", " \n", "One. Two!", "É." + "x" * int(rng.integers(0, 9)), "long " * 400 + "."]))
    rows = [(int(c), int(t), role(), text()) for c in range(60) for t in range(int(rng.integers(1, 12)))]
    rows += [(100, t, role(), text()) for t in range(700)]
    rows += [(101, None, role(), text()) for _ in range(5)] + [(101, 4, role(), text()), (101, 9, role(), text())] * 2
    rows += [(None, t, role(), text()) for t in range(6)] + [(None, None, None, None), (102, None, None, None), (103, 0, "user", None)] + rows[:4]
    return rows


def test_damage_and_repair(spark, talks):
    frame = spark.createDataFrame([(*r, "x", 1, 2) for r in talks], "conv_id long, turn long, role string, text string, id string, at int, cost int").repartition(4)
    done = op13_repair.repair(op13_repair.damaged(frame))
    got = sorted((tuple(r) for r in op13_repair.digests(done, frame.select("conv_id").distinct()).collect()), key=repr)
    want = brute_repair(talks)
    assert got == want
    letters = Counter("".join(r[7] for r in want))
    assert all(letters[c] for c in "DIKR")
    turns = op13_repair.repaired(done).where("conv_id = 100").orderBy("at", "place").collect()
    text = "\n".join(f"{t.role}:{t.text}" for t in turns)
    assert hashlib.sha256(text.encode()).hexdigest() == next(r[8] for r in want if r[0] == 100)


def test_repair_sql(talks):
    columns = {n: pa.array([r[i] for r in talks], pa.int64() if i < 2 else pa.string()) for i, n in enumerate(("conv_id", "turn", "role", "text"))}
    names, got = duck(queries.op13_sql(), conversations=columns)
    assert names == [c.split()[0] for c in op13_repair.DIGEST.split(", ")] and sorted(got, key=repr) == brute_repair(talks)


def test_repair_of_nothing(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert op13_repair.digests(op13_repair.repair(op13_repair.damaged(none)), none.select("conv_id")).count() == 0


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_conversations_over_many_tasks(spark, parts):
    rng = np.random.default_rng(parts)
    conv = np.sort(rng.integers(0, 4, 900))
    codes = rng.choice([0, 3, 4, 5, 6, 7, 8, 11, 12, 15], 900)
    rows = [(None if not c else int(c), i, int(k)) for i, (c, k) in enumerate(zip(conv, codes, strict=True))]
    frame = spark.createDataFrame(spark.sparkContext.parallelize(rows, parts), "conv_id long, id long, code int")
    got = sorted(op13_repair.edits(frame).collect(), key=lambda r: r["at"])
    assert [r["id"] for r in got] == list(range(900))
    names = {0: "s", 1: "u", 2: "a", 3: "x"}
    for c in range(4):
        own = [g for g, r in zip(got, rows, strict=True) if (r[0] or 0) == c]
        fake = [(c, 0, names[r[2] // 4], str(r[1])) for r in rows if (r[0] or 0) == c]
        cost, audit, _ = cheapest(fake, [op13_repair.FAULTS[r[2] % 4] for r in rows if (r[0] or 0) == c])
        assert sum(g["cost"] for g in own) == cost
        assert "".join("I" * len(g["before"]) + g["edit"] + "I" * len(g["after"]) for g in own) == audit


def test_every_short_conversation_by_trying_all_edits():
    """Edits of up to three rows, tried one and all, with up to two inserted turns in each gap."""
    gives = {"": "u", "s": "u", "u": "a", "a": "u"}

    def tries(codes):
        for letters in itertools.product("DKR", repeat=len(codes)):
            for gaps in itertools.product(range(3), repeat=len(codes) + 1):
                q, cost, audit = "", 0, ""
                for n, code, letter in zip(gaps, [*codes, None], [*letters, ""], strict=True):
                    for _ in range(n):
                        q, cost, audit = gives[q], cost + 3, audit + "I"
                    if code is None:
                        break
                    kind, fault = divmod(code, 4)
                    audit += letter
                    if letter == "D":
                        cost += 4
                    elif fault in (1, 2):
                        q = None
                    else:
                        role = "suax"[kind] if letter == "K" else gives[q]
                        cost += 3 * (letter == "R") + 3 * (fault == 3)
                        q = role if (q, role) in {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")} else None
                    if q is None:
                        break
                if q in ("", "a"):
                    yield cost, audit

    for n in range(1, 4):
        for codes in itertools.product((0, 4, 8, 5, 7, 11), repeat=n):
            steps = list(op13_repair.walk(bytes(codes), op13_repair.END, op13_repair.START))
            audit = "".join("I" * len(b) + e for b, e, *_ in steps) + "I" * len(op13_repair.ending(steps[-1][3]))
            cost = sum(c for *_, c, _ in steps) + 3 * len(op13_repair.ending(steps[-1][3]))
            assert (cost, audit) == min(tries(codes))
