"""Operators against plain Python on the smallest tables and on small fixtures."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from tokenizers import Tokenizer

from pyspark.sql import functions as F

from wayfleet.llm import common, gru, op1_packing, op2_toxicity, op3_token_counts, op4_simhash, op5_decontaminate, op6_preference, op7_lattice_lm, op8_line_dedup, op9_quality, op10_language, queries, tokens

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = ["", None, " \n\t ", "one", "a b", "a\x0bb c\x1cd", "É é ÀB <|endoftext|> x y  \n z", "w " * 3000, "same line.\n" * 40, "12 km to Paris. It is 12 km."]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    real = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").limit(120).collect()]
    odd = [(1000 + i, t, None if i % 2 else "en") for i, t in enumerate(ODD)]
    rows = [*real, *odd, odd[3], real[0]]
    extra = [(i, t, lang, "x", "y") for i, t, lang in rows]
    return spark.createDataFrame(extra, "doc_id long, text string, lang string, score string, sequence_id string").repartition(3), rows


@pytest.fixture(autouse=True)
def small_slices(monkeypatch):
    monkeypatch.setattr(common, "SLICE_BYTES", 20_000)


def test_words_of_slices_are_whole():
    batch = pa.RecordBatch.from_arrays([pa.array(["Ab É c", "Dé f", None, "x  Y "])], names=["text"])
    got = [w for b in (batch.slice(1, 3),) for w in common.words(common.texts(b, lower=True))[0].to_pylist()]
    assert got == ["dé", "f", "x", "y"]


def test_packing_is_an_exact_round_trip(docs):
    frame, rows = docs
    out = op1_packing.pack(frame, tokens.vocabulary()).collect()
    coder = Tokenizer.from_file(tokens.vocabulary())
    want = Counter()
    whole = {}
    for doc, text, _ in rows:
        ids = np.array([*coder.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        whole[doc] = ids
        want[doc] += len(ids)
    have, bins = Counter(), defaultdict(list)
    for r in out:
        ids = whole[r.doc_id]
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
        have[r.doc_id] += r.length
        bins[r.sequence_id].append((r.offset, r.length))
    assert have == want
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    used = sum(have.values())
    assert len(bins) * 2048 < 1.02 * used + 4 * 2048


def test_packing_cuts():
    assert op1_packing.cuts(5000, 2048, 32) == [2048, 2048, 512, 256, 128, 8]
    assert op1_packing.cuts(1, 2048, 32) == [1] and sum(op1_packing.cuts(2047, 2048, 32)) == 2047


def test_token_counts_follow_offsets(docs):
    frame, rows = docs
    got = defaultdict(list)
    for r in op3_token_counts.token_counts(frame.dropDuplicates(["doc_id"]), tokens.vocabulary()).collect():
        got[r.doc_id].append((r.section_no, r.start_char, r.end_char, r.n_tokens, r.n_crossing))
    coder = Tokenizer.from_file(tokens.vocabulary())
    for doc, text, _ in rows:
        text = text or ""
        bounds = sorted({0, *(m.end() for m in re.finditer("\n", text)), len(text)}) if text else [0, 0]
        counts, cross = Counter(), Counter()
        for a, b in coder.encode(text, add_special_tokens=False).offsets:
            over = [min(b, z) - max(a, y) for y, z in zip(bounds[:-1], bounds[1:], strict=True)]
            owner = over.index(max(over))
            counts[owner] += 1
            cross[owner] += sum(x > 0 for x in over) > 1
        assert sorted(got[doc]) == [(i, bounds[i], bounds[i + 1], counts[i], cross[i]) for i in range(len(bounds) - 1)]


def test_token_rules():
    bounds = np.array([0, 4, 6, 10])
    owner, over = op3_token_counts.attribute(np.array([0, 3, 3]), np.array([4, 6, 5]), bounds, "most")
    assert owner.tolist() == [0, 1, 0] and over.tolist() == [False, True, True]
    assert op3_token_counts.attribute(np.array([3]), np.array([6]), bounds, "start")[0].tolist() == [0]


def fingerprint(text):
    words = WORD.findall(lower(text))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(ids, linked):
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(up)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if linked(a, b) and root(a) != root(b):
                up[max(root(a), root(b))] = min(root(a), root(b))
    return {i: root(i) for i in ids}


def test_simhash_components(docs):
    frame, rows = docs
    fp = {d: fingerprint(t) for d, t, _ in rows}
    want = groups(fp, lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 2)
    got = op4_simhash.components64(frame).collect()
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == sorted((d, f"{fp[d]:016x}", want[d]) for d, _, _ in rows)


@pytest.mark.parametrize("cells", [1 << 22, 20])
def test_links_are_exact(spark, cells, monkeypatch):
    monkeypatch.setattr(op4_simhash, "CELLS", cells)
    rng = np.random.default_rng(5)
    fps = set()
    for centre in rng.integers(-(2**63), 2**63, 30, dtype=np.int64):
        for _ in range(8):
            x = centre
            for bit in rng.choice(64, rng.integers(0, 4), replace=False):
                x ^= np.int64(1) << np.int64(bit)
            fps.add(int(x))
    for _ in range(400):  # one crowd
        bits = rng.choice(12, rng.integers(0, 7), replace=False)
        fps.add(int(np.int64(-77) ^ np.int64(sum(1 << int(b) * 5 for b in bits))))
    fp = dict(enumerate(sorted(fps)))
    want = groups(fp, lambda a, b: ((fp[a] ^ fp[b]) & (2**64 - 1)).bit_count() <= 2)
    nodes = spark.createDataFrame(list(fp.items()), "node long, fp long")
    found = {r.node: r.component for r in op4_simhash.components(op4_simhash.links64(nodes)).collect()}
    assert {i: found.get(i, i) for i in fp} == want


def test_anchors_cover():
    rng = np.random.default_rng(6)
    x = rng.integers(0, 2**63, 500).astype(np.uint64) << np.uint64(1) | rng.integers(0, 2, 500).astype(np.uint64)
    key, there = op4_simhash.anchors(x)
    assert (np.bitwise_count(key ^ x[:, None])[there] <= 2).all() and there.sum(1).max() == 33
    for _ in range(300):  # two words within 2 bits meet, and an anchor is one of its own anchors
        a = x[rng.integers(0, 500)]
        b = a
        for bit in rng.choice(64, rng.integers(0, 3), replace=False):
            b ^= np.uint64(1) << np.uint64(bit)
        (ka, ta), (kb, tb) = (op4_simhash.anchors(np.array([v])) for v in (a, b))
        assert set(ka[ta].tolist()) & set(kb[tb].tolist())
        assert ka[0, 0] in op4_simhash.anchors(ka[0, :1])[0][0]


def test_anchor_groups_reach_over_batches():
    rows = [np.repeat([3, 5, 9], [1, 4, 2]), np.arange(7), np.array([0, 0, 1, 3, 255, 7, 6])]
    batch = pa.RecordBatch.from_arrays([pa.array(r) for r in rows], names=["anchor", "node", "fp"])
    for step in (1, 2, 7):
        got = {(a, b) for out in op4_simhash.compared(batch.slice(i, step) for i in range(0, 7, step)) for a, b in zip(*(c.to_pylist() for c in out.columns), strict=True)}
        assert got == {(1, 2), (1, 3), (5, 6)}


def test_components_of_a_long_path(spark):
    path = [(i, i + 1) for i in range(200)] + [(1000, 999), (5, 5)]
    got = {r.node: r.component for r in op4_simhash.components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(201)} | {999: 999, 1000: 999}


def test_near_duplicates(spark):
    rng = np.random.default_rng(1)
    vocab = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(2000)]
    rows, groups_of = [], {}
    for base in range(60):
        words = [str(w) for w in rng.choice(vocab, 250)]
        for copy in range(3):
            changed = list(words)
            for at in rng.choice(250, 0 if copy == 0 else 4, replace=False):  # Jaccard similarity about 0.85
                changed[at] = "changed"
            rows.append((base * 10 + copy, " ".join(changed)))
            groups_of[base * 10 + copy] = base * 10
    got = {r.doc_id: r.component_id for r in op4_simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[d] == groups_of[d] for d in got) >= 0.97 * len(got)
    assert all(got[d] // 10 == d // 10 for d in got)


def shingle_set(text):
    w = WORD.findall(lower(text))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similar(x, y):
    return x == y or len(x & y) / len(x | y) >= 0.8


@pytest.mark.parametrize("tile", [64, 2])
def test_near_duplicates_finds_contiguous_edits_in_crowds(spark, tile, monkeypatch):
    monkeypatch.setattr(op4_simhash, "TILE", tile)
    rng = np.random.default_rng(3)
    rows = []
    for base in range(25):
        words = [f"w{x}" for x in rng.integers(0, 3000, 200)]
        made = [words, [*words, *(f"n{x}" for x in rng.integers(0, 3000, 40))], words[:60] + [f"r{x}" for x in rng.integers(0, 3000, 15)] + words[75:]]
        for _ in range(5 if base else 40):
            at = int(rng.integers(0, 150))
            made.append(words[:at] + [f"s{x}" for x in rng.integers(0, 3000, int(rng.integers(5, 45)))] + words[at + 20 :])
        rows += [(base * 100 + i, " ".join(w)) for i, w in enumerate(made)]
    have = {d: shingle_set(t) for d, t in rows}
    want = groups(have, lambda a, b: similar(have[a], have[b]))
    got = {r.doc_id: r.component_id for r in op4_simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_bitmaps_of_any_lengths_keep_similar_sets(spark):
    rng = np.random.default_rng(5)
    rows, pairs, want = [], [], set()
    for i, n in enumerate((0, 3, 400, 511, 512, 513, 1000, 1024, 2100, 5000)):  # lengths double behind 512, 1024, ...
        for j, share in enumerate((0.5, 0.7, 0.8, 0.9)):
            extra = int(np.ceil(n * (1 / share - 1))) if share < 0.8 else int(n * (1 / share - 1))
            have = [np.sort(rng.choice(1 << 62, n + extra, replace=False)).astype(np.uint64)]
            have.insert(0, np.sort(rng.permutation(have[0])[:n]))
            for side, h in enumerate(have):
                bits, _ = op4_simhash.bitmaps(h, np.zeros(len(h), dtype=np.int64), np.array([len(h)]))
                rows.append((i * 100 + j * 10 + side, len(h), bits.tolist()))
            pairs.append((i * 100 + j * 10, i * 100 + j * 10 + 1))
            if share >= 0.8:
                want.add(pairs[-1])
    nodes = spark.createDataFrame(rows, "node long, n long, bits array<long>")
    got = {tuple(r) for r in op4_simhash.possible(spark.createDataFrame(pairs, "a long, b long"), nodes, 0.8).collect()}
    flipped = {(b, a) for a, b in op4_simhash.possible(spark.createDataFrame([(b, a) for a, b in pairs], "a long, b long"), nodes, 0.8).collect()}
    assert want <= got and got == flipped
    assert not {p for p in got if p[0] % 100 == 0 and p[0] >= 200}  # half as many shared: too few


def test_near_duplicates_below_the_threshold_stay_apart(spark):
    rng = np.random.default_rng(4)
    rows = []
    for base in range(30):
        words = [f"w{x}" for x in rng.integers(0, 3000, 200)]
        rows += [(base * 10, " ".join(words)), (base * 10 + 1, " ".join(words[:170] + [f"n{x}" for x in range(20)]))]  # about 0.76
    line = "this line is repeated over and over again\n"
    rows += [(1000 + i, line * 300 + " ".join(f"v{x}" for x in rng.integers(0, 3000, 60))) for i in range(3)]
    have = {d: shingle_set(t) for d, t in rows}
    assert not any(similar(have[a], have[b]) for a in have for b in have if a < b)
    got = {r.doc_id: r.component_id for r in op4_simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: d for d, _ in rows}


def test_near_duplicates_of_documents_are_exact(docs):
    frame, rows = docs
    have = {d: shingle_set(t) for d, t, _ in rows}
    want = groups(have, lambda a, b: similar(have[a], have[b]))
    assert {(r.doc_id, r.component_id) for r in op4_simhash.near_duplicates(frame).collect()} == set(want.items())


def test_decontamination(spark):
    item = "A train leaves Paris at 9 km per hour and meets Anna after 12 hours near the old bridge over the river"
    other = item.replace("9", "30").replace("12", "45").replace("Anna", "Peter").replace("Paris", "Rome")
    mixed = "First 7 apples and then 7 pears make 14 fruits in the bowl of the green kitchen today"
    wrong = mixed.replace("First 7 apples and then 7 pears", "First 8 apples and then 9 pears")
    good = mixed.replace("7", "8").replace("14", "16")
    clean = "nothing of this is in any benchmark item at all, it is a clean text about other things"
    docs = [(1, "Before. " + item + " after"), (2, "x y z. " + other), (3, wrong), (4, good), (5, clean), (6, None), (7, ""), (1, "Before. " + item + " after")]
    items = [(10, item), (11, mixed), (12, "too short"), (13, None), (14, item)]
    got = op5_decontaminate.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), coverage=0.9).collect()
    assert sorted((r.doc_id, r.item_id, r.verdict) for r in got) == [(1, 10, "exact"), (1, 14, "exact"), (2, 10, "reparameterised"), (2, 14, "reparameterised"), (4, 11, "reparameterised")]


def test_decontamination_of_altered_copies(spark):
    two = "Then 3 apples and 4 pears are put into the large bowl of the kitchen today"
    long = " ".join(f"word{i}" if i % 10 != 5 else "17" for i in range(60))
    named = "On monday Anna walks with Peter over the bridge to meet Maria near the old mill"
    short = "Anna sells 5 ripe pears"
    docs = [(1, two.replace("3", "5").replace("4", "5")), (2, long.replace("17", "18", 1)), (3, named.lower()), (4, "it is said that " + short + " here"), (5, "it is said that " + short.replace("Anna", "Peter") + " here"), (6, "nothing of this is anywhere else")]
    items = [(10, two), (11, long), (12, named), (13, short)]
    got = op5_decontaminate.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id, r.verdict) for r in got) == [(1, 10, "reparameterised"), (2, 11, "exact"), (3, 12, "exact"), (4, 13, "exact"), (5, 13, "reparameterised")]


def brute_windows(text, size, reading):
    """(place, key, slot values) of each window, word by word."""
    ws = WORD.findall(text or "")
    read = []
    for i, w in enumerate(ws):
        low, kind, capital, _ = op5_decontaminate.described(w)
        opens = op5_decontaminate.described(ws[i - 1])[3] if i else reading != "opening"
        after = i > 0 and op5_decontaminate.described(ws[i - 1])[1] == op5_decontaminate.NUMBER
        tag = {1: "<number>", 3: "<measure>"}.get(kind) or ("<unit>" if kind == 2 and after else "<name>" if kind == 0 and capital and not opens and reading != "plain" else None)
        read.append((low, tag))
    for i in range(len(read) - size + 1):
        own = read[i : i + size]
        few = sum(tag is None for _, tag in own) < 3
        yield i, (size, few, *(low if few else tag or low for low, tag in own)), [low for low, tag in own if tag]


def brute_decontaminated(docs, items, coverage=0.5):
    out = {}
    for item_id, item in items:
        n = len(WORD.findall(item or ""))
        size = min(8, n)
        if not n or item_id is None:
            continue
        first, places = {}, defaultdict(set)
        for reading in ("usual", "plain", "opening"):
            for i, key, slots in brute_windows(item, size, reading):
                places[key].add(i)
                first[key] = min(first.get(key, (i, slots)), (i, slots))
        for doc_id in {d for d, _ in docs if d is not None}:
            lines = defaultdict(set)
            for d, text in docs:
                for at, key, slots in brute_windows(text, size, "usual") if d == doc_id else ():
                    if key in first:
                        i, own = first[key]
                        fill = tuple(dict.fromkeys(zip(own, slots, strict=True))) if len(own) == len(slots) else ()
                        lines[at - i].add((i, tuple(sorted(places[key])), fill))
            found = []
            for shift, wins in lines.items():
                votes = Counter(f for _, _, fill in wins for f in fill)
                chosen = {}
                for (i, d), k in sorted(votes.items(), key=lambda v: (-v[1], v[0][0] != v[0][1], v[0][1])):
                    chosen.setdefault(i, d)
                held = [(ps, fill) for _, ps, fill in wins if all(chosen[i] == d for i, d in fill)]
                fill = {f for _, fs in held for f in fs}
                words = {p + j for ps, _ in held for p in ps for j in range(size)}
                if held:
                    found.append((-len(words), sum(i != d for i, d in fill), shift, fill, words))
            if found:
                found.sort(key=lambda x: x[:3])
                best = dict(found[0][3])
                words = set().union(*(w for *_, fill, w in found if all(best.get(i, d) == d for i, d in fill)))
                if len(words) >= coverage * n:
                    out[doc_id, item_id] = (len(words), n, len(found[0][3]), found[0][1], "reparameterised" if found[0][1] else "exact")
    return out


def as_found(frame):
    return {(r.doc_id, r.item_id): (r.covered, r.item_words, r.n_slots, r.n_changed, r.verdict) for r in frame.collect()}


def test_decontamination_against_brute_force(spark, sf_dir):
    rng = np.random.default_rng(2)
    base = "Anna has 3 red apples and 4 green pears in her bag. Then Peter gives 12 km of rope to Maria for 5 dollars each day"
    numbers = " ".join(str(x) for x in rng.integers(0, 1000, 400))
    changed = base.replace("3", "7").replace("4", "9").replace("Anna", "Zoe")
    items = [(1, base), (2, numbers), (3, "w " * 400), (4, "yes"), (5, "Tom has 3 old hats in his box. Tom has 5 old hats in his box."), (6, None), (7, ""), (None, base), (8, base)]
    docs = [(1, f"{base} and then {changed}"), (2, changed), (3, numbers), (4, " ".join(reversed(numbers.split()))), (5, "w " * 3000), (6, "so he said yes to it"), (7, items[4][1]), (8, items[4][1].replace("3", "6")), (9, None), (10, ""), (None, base), (1, "another text"), (11, base.replace("in her bag", "in her very nice bag")), (12, base.replace("4", "8", 1))]
    real = [(1000 + r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").limit(60).collect()]
    more = [(100 + r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    frames = (spark.createDataFrame([(d, t, 1) for d, t in docs + real], "doc_id long, text string, item_id int"), spark.createDataFrame([(i, t, 2) for i, t in items + more], "item_id long, text string, doc_id int"))
    got = as_found(op5_decontaminate.decontaminate(*frames))
    assert got == brute_decontaminated(docs + real, items + more)
    assert got[1, 1][-1] == "exact" and got[2, 1][-1] == "reparameterised" and (3, 2) in got and (4, 2) not in got and (6, 4) in got and got[11, 1][-1] == "exact"
    met = op5_decontaminate.matches(frames[0].where("doc_id in (3, 4, 5)"), frames[1].where("item_id in (2, 3)"))
    assert met.count() <= 400 + 3000


def test_decontamination_finds_whole_items(spark, sf_dir, monkeypatch):
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    once = as_found(op5_decontaminate.decontaminate(docs, items))
    monkeypatch.setattr(common, "SIEVE", 16)  # lets nearly all through
    assert once and as_found(op5_decontaminate.decontaminate(docs, items)) == once
    text = {r.doc_id: " ".join(r.text.split()) for r in docs.collect()}
    whole = {(d, r.item_id) for r in items.collect() for d, t in text.items() if " ".join(r.text.split()) in t}
    assert whole <= set(once)


def brute_lines(text):
    """(line, whether it opens a line of the text)"""
    out = []
    for part in re.findall(r"[^\n]*\n|[^\n]+", text):
        opens = True
        for sentence in re.split(r"(?<=[.!?])(?= )", part):
            found = list(WORD.finditer(sentence))
            data = [m[0].encode() for m in found]
            flat = np.frombuffer(b" ".join(data), dtype=np.uint8)
            size = np.array([len(d) for d in data], dtype=np.int64)
            w = op8_line_dedup.weights(flat, np.cumsum(size + 1) - size - 1, size).tolist() if data else []
            at = 0
            for i in range(2, len(w) - 2):
                if len(w) > 16 and w[i] < min(w[i - 2 : i]) and w[i] <= min(w[i + 1 : i + 3]):
                    out.append((sentence[at : found[i].start()], opens))
                    at, opens = found[i].start(), False
            out.append((sentence[at:], opens))
            opens = False
    return [x for x in out if x[0]]


def test_line_dedup(docs):
    frame, rows = docs
    text_of = {d: t or "" for d, t, _ in rows}
    seen, want = {}, {}
    parts = {d: brute_lines(t) for d, t in text_of.items()}

    def wins(d):
        full = [i for i, (x, _) in enumerate(parts[d]) if WORD.search(x)]
        for a in range(len(full) - 2):
            three = full[a : a + 3]
            yield tuple(parts[d][i][0].strip("\x20\t\n\x0b\x0c\r") for i in three), three[0], three[2]

    for d in sorted(parts):
        for key, _, _ in wins(d):
            seen.setdefault(key, d)
    for d in parts:
        gone, own, first = set(), set(), {}
        held = list(wins(d))
        for key, a, z in held:
            if seen[key] < d:
                gone |= set(range(a, z + 1))
            elif key in first:
                own |= set(range(a, z + 1))
            else:
                first[key] = (a, z)
        times = Counter(k for k, _, _ in held)
        kept = {i for k, (a, z) in first.items() if times[k] > 1 for i in range(a, z + 1)}
        gone |= own - kept
        for i in sorted(gone):
            if i in gone and i - 1 not in gone:
                run = [i]
                while run[-1] + 1 in gone:
                    run.append(run[-1] + 1)
                whole = parts[d][i][1] and (run[-1] + 1 == len(parts[d]) or parts[d][run[-1] + 1][1])
                if not whole and sum(len(WORD.findall(parts[d][j][0])) for j in run) < 10:
                    want.setdefault("spared", set()).update((d, j) for j in run)
        gone = {i for i in gone if (d, i) not in want.get("spared", ())}
        want[d] = ("".join(x for i, (x, _) in enumerate(parts[d]) if i not in gone), len(parts[d]), len(gone))
    for r in op8_line_dedup.line_dedup(frame).collect():
        assert (r.text or "", r.n_lines, r.n_removed) == want[r.doc_id]
        assert (r.text is None) == (r.doc_id == 1001) and r.score == "x"


def test_short_lines_and_passages_without_marks_go(spark):
    rng = np.random.default_rng(8)
    menu = "Home\nAbout\nContact\n"
    rows, passages = [(1, menu + "First text."), (2, "Second text.\n" + menu), (3, "Yes. No. Maybe. And so on it goes here."), (4, "Yes. No. Maybe. Nothing of it is the same.")], []
    for i in range(200):  # within a line, at any offset
        passage = [f"p{x}" for x in rng.integers(0, 5000, 51)]
        passages.append(set(passage))
        rows += [(10 + 2 * i + side, " ".join([f"q{x}" for x in rng.integers(0, 5000, rng.integers(20, 60))] + passage + [f"r{x}" for x in rng.integers(0, 5000, rng.integers(20, 60))])) for side in (0, 1)]
    got = {r.doc_id: r.text for r in op8_line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == rows[0][1] and got[2] == "Second text.\n" and got[3] == rows[2][1] and got[4] == rows[3][1]
    left = [len([w for w in got[11 + 2 * i].split() if w in p]) for i, p in enumerate(passages)]
    assert all(got[10 + 2 * i] == rows[4 + 2 * i][1] for i in range(200))
    assert np.mean(left) < 14 and sum(x >= 45 for x in left) <= 2


def test_repeated_passages_go(spark):
    passage = " ".join(f"word{i}" for i in range(55)) + "."
    rows = [(1, "One start here. " + passage), (2, passage + "\nAnother end of text."), (3, "Own text.\n" + passage + " And more.")]
    got = {r.doc_id: r.text for r in op8_line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == rows[0][1] and got[2].strip() == "Another end of text." and "word30" not in got[3] and "Own text." in got[3] and "And more." in got[3]


def test_quality_base(docs):
    frame, rows = docs
    got = {r.doc_id: r for r in op9_quality.quality(frame).collect()}
    for d, t, _ in rows:
        t = t or ""
        words = WORD.findall(t)
        triples = Counter(zip(words, words[1:], words[2:], strict=False))
        hit = {i + j for i, w in enumerate(zip(words, words[1:], words[2:], strict=False)) if triples[w] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit))
        r = got[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(words) < 50 or 100 * len(hit) > 50 * len(words)) and not (r.base_failed and r.kept)


def test_quality_verdict(spark, sf_dir):
    got = op9_quality.quality(spark.read.parquet(f"{sf_dir}/documents.parquet")).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").where("not base_failed").collect()
    good, bad = [r.kept for r in got if r.quality == 1], [r.kept for r in got if r.quality == 0]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.5


def test_divergence():
    p, q = np.array([[3.0, 1.0]]), np.array([0.5, 0.5])
    m = (np.array([0.75, 0.25]) + q) / 2
    want = sum(0.5 * a * math.log2(a / b) for a, b in zip([0.75, 0.25], m, strict=True)) + sum(0.5 * a * math.log2(a / b) for a, b in zip(q, m, strict=True))
    js, excess = op9_quality.divergence(p * 1e6, q)
    assert js[0] == pytest.approx(want, abs=1e-9) and excess[0] == pytest.approx(want, abs=1e-6) and excess[0] < js[0]


def js_bits(counts, ref):
    n = sum(counts)
    p = [x / n for x in counts]
    m = [(x + y) / 2 for x, y in zip(p, ref, strict=True)]
    part = lambda d: sum(x * math.log2(x / y) for x, y in zip(d, m, strict=True) if x)
    return (part(p) + part(ref)) / 2, (sum(y > 0 for y in ref) - 1) / (8 * math.log(2) * n)


def char_class(c):
    if ord(c) > 127:
        return 8
    for i, group in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r\x0b\x0c", ".,", "#*$%&|<>")):
        if c in group:
            return i
    return 7


@pytest.mark.parametrize("least", [2_000, 1])
def test_quality_verdict_by_hand(docs, spark, least, monkeypatch):
    monkeypatch.setattr(op9_quality, "LEAST", least)
    rows = [(d, t, {3: "FR-fr", 5: "not a tag", 7: "xx"}.get(d % 11, lang)) for d, t, lang in docs[1]]
    frame = spark.createDataFrame([(d, t, lang, 1) for d, t, lang in rows], "doc_id long, text string, lang string, n_words int").repartition(4)
    tag = lambda lang: m[1].lower() if (m := re.fullmatch("([A-Za-z]{2,3})(?:[-_].*)?", (lang or "").strip())) else None
    form = lambda w: w.lower().strip(".,;:!?\"'()")
    seen, chars = defaultdict(Counter), defaultdict(Counter)
    for _, t, lang in rows:
        if tag(lang):
            seen[tag(lang)].update(form(w) for w in WORD.findall(t or ""))
            chars[tag(lang)].update(char_class(c) for c in t or "")
    refs = {}
    for lang, c in seen.items():
        n = sum(c.values())
        if n >= least:
            common = sorted(w for w in c if c[w] >= 0.002 * n)
            hist = [c[w] / n for w in common]
            refs[lang] = common, [*hist, 1 - sum(hist)], [chars[lang][k] / sum(chars[lang].values()) for k in range(9)]
    assert ("xx" in refs) or least > 1
    want = defaultdict(list)
    for d, t, lang in rows:
        ws, t = [form(w) for w in WORD.findall(t or "")], t or ""
        by_chars = by_words = (None, None)
        if tag(lang) in refs:
            common, hist, classes = refs[tag(lang)]
            c = Counter(w if w in set(common) else None for w in ws)
            if len(t) >= 200:
                by_chars = js_bits([sum(char_class(x) == k for x in t) for k in range(9)], classes)
            if len(ws) >= 80:
                by_words = js_bits([*(c[w] for w in common), c[None]], hist)
        far = lambda js, limit: js[0] is not None and js[0] - js[1] > limit
        want[d].append((far(by_chars, 0.07) or far(by_words, 0.12), by_chars[0] and math.sqrt(by_chars[0]), by_words[0] and math.sqrt(by_words[0])))
    got = defaultdict(list)
    for r in op9_quality.quality(frame).collect():
        got[r.doc_id].append((r.base_failed, r.kept, r.js_chars, r.js_words))
    assert {d: len(x) for d, x in got.items()} == {d: len(x) for d, x in want.items()}
    for d in want:
        for (failed, kept, a, b), (bad, x, y) in zip(got[d], want[d], strict=True):
            assert kept == (not failed and not bad)
            assert (a is None) == (x is None) and (b is None) == (y is None)
            assert (a or 0) == pytest.approx(x or 0, abs=1e-6) and (b or 0) == pytest.approx(y or 0, abs=1e-6)


def test_lattice_sums_all_segmentations():
    model = op7_lattice_lm.lattice(op7_lattice_lm.vocabulary())
    logp = model.first.tolist()
    ids = {p: i[0] for p, i in model.pieces.items()}

    def brute(s):
        if not s:
            return 1.0
        total = 0.0
        for n in range(1, len(s) + 1):
            if s[:n] in ids:
                total += math.exp(logp[ids[s[:n]]]) * brute(s[n:])
        if s[0] not in model.single:
            total += math.exp(sum(logp[model.byte[b]] for b in s[0].encode())) * brute(s[1:])
        return total

    for word in ("the", "thanedble", "ñ", "a☃b"):
        assert model.forward(model.arcs(word), logp)[-1] == pytest.approx(math.log(brute(op7_lattice_lm.MARK + word)))
    n = np.zeros(model.size)
    assert model.expected("than", 1, logp, 1.0, n) == 1
    pieces = {i: p for p, i in ids.items()}
    assert sum(len(pieces[i]) * n[i] for i in np.flatnonzero(n)) == pytest.approx(5)


@pytest.mark.parametrize("frequent", [2e-6, 0.01])
def test_lm_base_and_scores(docs, frequent):
    frame, rows = docs
    got = op7_lattice_lm.lm_scores(op7_lattice_lm.split(frame), op7_lattice_lm.vocabulary(), "held_out", rounds=1, frequent=frequent).collect()
    held = lambda d: zlib.crc32(str(d).encode()) % 7 == 2
    train = [WORD.findall(lower(t)) + [None] for d, t, _ in rows if not held(d)]
    c = Counter(w for ws in train for w in ws)
    n, v = sum(c.values()), len(c)
    want = []
    for d, t, _ in rows:
        ws = WORD.findall(lower(t)) + [None]
        want.append((d, held(d), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 5)))
    assert sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == sorted(want)
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)


def test_batches_of_words_equal_single_ones():
    model = op7_lattice_lm.lattice(op7_lattice_lm.vocabulary())
    words = ["", "a", "the", "The", "ñandú", "a☃b", "x" * 60, "zzqj", "internationalisation", "\ud83d" if False else "🙂", "▁▁", "the"]
    times = np.array([1.0, 2, 500, 1, 3, 1, 2, 1, 7, 2, 1, 40])
    logp = model.first
    total, counts, now = model.batch(words, times, logp, 30.0)
    want = np.zeros(model.size)
    spelled = sum(model.expected(w, t, logp.tolist(), 30.0, want) for w, t in zip(words, times, strict=True))
    assert total == pytest.approx([model.forward(model.arcs(w), logp.tolist())[-1] for w in words])
    assert counts == pytest.approx(want) and now == pytest.approx(spelled)


def test_lattice_mass_is_at_most_one():
    import ahocorasick
    from itertools import product

    model = op7_lattice_lm.Lattice.__new__(op7_lattice_lm.Lattice)
    p = {"▁": 0.3, "▁a": 0.2, "a": 0.1, "b": 0.1, "ab": 0.2, "bb": 0.1}
    model.pieces = ahocorasick.Automaton()
    for i, x in enumerate(p):
        model.pieces.add_word(x, (i, len(x)))
    model.pieces.make_automaton()
    model.single = {"▁", "a", "b"}
    logp = [math.log(v) for v in p.values()]
    mass = sum(math.exp(model.forward(model.arcs("".join(w)), logp)[-1]) for n in range(11) for w in product("ab", repeat=n))
    assert 0.5 < mass <= 1


@pytest.mark.parametrize("rounds", [0, 2])
def test_lm_score_by_hand(spark, rounds):
    texts = ["the cat sat on the mat", "The dog sat on a log", "a cat and a dog", "", None, "zyxw qqq the", "the the the ñandú", "the cat sat on the mat"]
    rows = [(i, t, i in (3, 5), "x") for i, t in enumerate(texts)] + [(0, texts[0], False, "y")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, held boolean, word string").repartition(3)
    got = sorted((r.doc_id, round(r.score, 6)) for r in op7_lattice_lm.lm_scores(frame, op7_lattice_lm.vocabulary(), "held", rounds=rounds).collect())
    model = op7_lattice_lm.lattice(op7_lattice_lm.vocabulary())
    c = Counter(w for _, t, held, _ in rows if not held for w in WORD.findall(lower(t)))
    ends, seen = sum(not r[2] for r in rows), sum(c.values())
    logp, spelled, n = model.first.tolist(), seen / 2, seen + ends
    for _ in range(rounds):
        counts, now = np.zeros(model.size), 0.0
        for w, k in c.items():
            now += model.expected(w, k, logp, spelled, counts)
        counts += 0.1 * model.size * np.exp(model.first)
        logp, spelled = np.log(counts / counts.sum()).tolist(), now
    spelling = lambda w: spelled / n * math.exp(model.forward(model.arcs(w), logp)[-1])
    own = {w: max(0.0, k / n - spelling(w)) for w, k in c.items() if k >= 2}
    scale = (seen / n) / (sum(own.values()) + spelled / n)
    prob = lambda w: scale * (own.get(w, 0.0) + spelling(w))
    assert sum(map(prob, c)) + ends / n <= 1 + 1e-9
    want = sorted((d, round(sum(math.log10(prob(w)) for w in WORD.findall(lower(t))) + math.log10(ends / n), 6)) for d, t, _, _ in rows)
    assert [d for d, _ in got] == [d for d, _ in want] and [x for _, x in got] == pytest.approx([x for _, x in want], abs=2e-6)


def test_lm_paths_agree(docs):
    frame, _ = docs
    a, b = (sorted((r.doc_id, round(r.score, 6)) for r in op7_lattice_lm.lm_scores(op7_lattice_lm.split(frame), op7_lattice_lm.vocabulary(), "held_out", rounds=1, frequent=f).collect()) for f in (1e-9, 0.5))
    assert a == b


def test_toxicity_finds_planted_words(spark):
    rng = np.random.default_rng(3)
    vocab = ["".join(rng.choice(list("aeilnorst"), rng.integers(2, 9))) for _ in range(800)]
    rows, labels = [], []
    for i in range(400):
        words = [str(w) for w in rng.choice(vocab, rng.integers(5, 150))]
        if i % 4 == 0:
            words[rng.integers(0, len(words))] = "zuxgrak" + str(rng.choice(vocab))[:2]
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(i % 4 == 0)))
    rows += [(900, ""), (901, None), (902, "zuxgrakxy"), (None, "plain words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = op2_toxicity.toxicity(docs, spark.createDataFrame([*labels, (5, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int"), op2_toxicity.learnable()).collect()
    out = {r.doc_id: r for r in got}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(out[i].predicted == (i % 4 == 0) for i in held) >= 0.95 * len(held)
    assert out[900].score == out[901].score == 0 and out[902].predicted == 1 and len(got) == len(rows)


def tiny_network(seed=3):
    rng = np.random.default_rng(seed)
    net = gru.Network(["aa", "bb", "cc"], rng.standard_normal(3), rng.standard_normal(gru.BUCKETS).astype(np.float32), seed)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    return net


def test_gradients_are_those_of_differences():
    net = tiny_network()
    rng = np.random.default_rng(4)
    gates = rng.standard_normal((7, 6 * gru.HIDDEN))
    index = np.array([[0, 1, 2, 3, 4], [5, 0, 6, 6, 6], [2, 2, 1, 5, 6]])  # 6: padding
    y = np.array([1.0, 0.0, 1.0])

    def loss():
        return float(np.mean(np.logaddexp(0, net.run(gates, index)[0]) - y * net.run(gates, index)[0]))

    logit, saved = net.run(gates, index, keep=True)
    dense, steps = net.gradients(index, 6, saved, (gru.sigmoid(logit) - y) / 3)
    dgates = np.zeros_like(gates)
    np.add.at(dgates, index.T.ravel(), steps.reshape(-1, steps.shape[-1]))
    for name, own in [*((k, net.p[k]) for k in ("u", "a", "a0", "v", "o", "o0")), ("gates", gates)]:
        grad = dgates if name == "gates" else np.asarray(dense[name])
        for _ in range(12):
            at = tuple(int(rng.integers(0, n)) for n in own.shape)
            if name == "gates" and at[0] == 6 or name == "u" and not net.block[at]:
                continue
            kept = own[at]
            own[at] = kept + 1e-3
            up = loss()
            own[at] = kept - 1e-3
            down = loss()
            own[at] = kept
            assert (up - down) / 2e-3 == pytest.approx(grad[at], abs=3e-4)


def naive_score(net, text):
    """One window after the other, one step after the other."""
    sig = lambda x: 1 / (1 + np.exp(-x))
    ws, h = WORD.findall(text), gru.HIDDEN
    if not ws:
        return 0.0
    p, best, at = net.p, 0.0, 0
    while True:
        x = net.inputs(gru.plain(pa.array(ws[at : at + gru.WINDOW], pa.large_string())))[0] @ p["w"] + p["b"]
        states = np.zeros((len(x), 2 * h))
        for side, order in ((0, range(len(x))), (1, range(len(x) - 1, -1, -1))):
            cols = [slice(g * 2 * h + side * h, g * 2 * h + side * h + h) for g in range(3)]
            u = p["u"][side * h : side * h + h]
            s = np.zeros(h)
            for t in order:
                z, r = sig(x[t, cols[0]] + s @ u[:, cols[0]]), sig(x[t, cols[1]] + s @ u[:, cols[1]])
                c = np.tanh(x[t, cols[2]] + r * (s @ u[:, cols[2]]))
                s = c + z * (s - c)
                states[t, side * h : side * h + h] = s
        e = np.tanh(states @ p["a"] + p["a0"]) @ p["v"]
        w = np.exp(e - e.max())
        best = max(best, float(sig((w / w.sum()) @ states @ p["o"] + p["o0"][0])))
        if at + gru.WINDOW >= len(ws):
            return best
        at += gru.STRIDE


def test_scores_are_those_of_single_windows():
    net = tiny_network()
    rng = np.random.default_rng(9)
    for k in ("w", "u", "o"):
        net.p[k] = net.p[k] * 3
    texts = ["", "aa", "aa bb cc.", *(" ".join(rng.choice(["aa", "bb", "cc", "dd", "É", "(aa)"], n)) for n in (31, 32, 33, 44, 45, 200, 20)), " \n "]
    assert gru.scores(net, pa.array(texts, pa.large_string())) == pytest.approx([naive_score(net, t) for t in texts], abs=1e-4)


def test_network_learns_the_order_of_words():
    """Both labels have the same words and grams; only which of two comes first differs, so fixed features tell nothing."""
    rng = np.random.default_rng(5)
    texts, y = [], []
    for i in range(1200):
        pair = ["alpha", "omega"] if i % 2 else ["omega", "alpha"]
        texts.append(" ".join([*rng.choice(["mm", "nn"], rng.integers(0, 4)), *pair, *rng.choice(["mm", "nn"], rng.integers(0, 4))]))
        y.append(i % 2)
    net = gru.trained(texts[:900], np.array(y[:900]), rounds=12, dropped=0.0)
    p = gru.scores(net, pa.array(texts[900:], pa.large_string()))
    assert np.abs(net.word_odds).max() < 0.5 and np.mean((p > 0.5) == np.array(y[900:])) > 0.9


def test_toxicity_of_odd_rows(spark):
    rows = [(i, ("bad " if i % 3 == 0 else "good ") + f"word{i % 7} text here", "s", 5) for i in range(90)]
    rows += [(0, "another bad row", "s", 1)] * 3 + [(500, None, None, None), (None, "bad thing", "t", 2), (501, "fine words " * 30_000 + "bad thing", "u", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, toxic int").withColumn("score", F.lit("old"))
    labels = spark.createDataFrame([(i, int(i % 3 == 0), "x") for i in range(90)] + [(3, 0, "y"), (None, 1, "z"), (4, 9, "z")], "doc_id long, toxic int, text string")
    got = op2_toxicity.toxicity(docs, labels).collect()
    assert Counter((r.doc_id, r.text, r.source, r.toxic) for r in got) == Counter(rows)
    one = {(r.doc_id, r.text): r for r in got}
    assert one[500, None].score == 0 and one[None, "bad thing"].predicted == 1 and one[501, rows[-1][1]].score > 0.5
    assert len({r.score for r in got if r.text == "another bad row"}) == 1
    assert {r.score for r in op2_toxicity.toxicity(docs, labels.where("toxic = 0")).collect()} == {0.0}


def test_preferences_by_hand(spark):
    turns = [(1, 0, "user", "Hi"), (1, 1, "assistant", "Hello"), (1, 2, "user", "More"), (1, 3, "assistant", "Good"), (2, 0, "user", "Hi"), (2, 1, "assistant", "Hello"), (2, 2, "user", None), (None, 0, "user", "x"), (2, None, "user", "x"), (2, 1, "assistant", "Hello")]
    rows = op6_preference.turns(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    got = {(r.pair_id, r.part): r for r in op6_preference.preferences(rows, op6_preference.first_turn_pairs(rows)).collect()}
    assert {k: r.text for k, r in got.items()} == {
        (1, "prompt"): "<|user|>\nHi<|end|>\n<|assistant|>\nHello<|end|>\n",
        (1, "chosen"): "<|user|>\n<|end|>\n",
        (1, "rejected"): "<|user|>\nMore<|end|>\n<|assistant|>\nGood<|end|>\n",
    }
    mask = got[(1, "rejected")].mask
    assert [got[(1, "rejected")].text[m["from"] : m["to"]] for m in mask] == ["Good<|end|>\n"] and got[(1, "prompt")].mask == []


def test_languages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    odd = spark.createDataFrame([(9001, None, None), (9002, "http://x.example.com/", ""), (9003, "odd", "<html lang='fr'><p>")], "page_id long, url string, html string")
    got = {r.page_id: r for r in op10_language.languages(pages.unionByName(odd), docs).collect()}
    want = {r.page_id: re.search(r"/(en|de|fr|es)/", r.url)[1] for r in pages.collect() if re.search(r"/(en|de|fr|es)/", r.url)}
    assert np.mean([got[p].lang == lang for p, lang in want.items()]) > 0.97
    assert got[9003].lang == "fr" and got[9001].lang is not None and got[9001].text_lang is None and len(got) == pages.count() + 3


def softmax(logs):
    e = [math.exp(x - max(logs)) for x in logs]
    return [x / sum(e) for x in e]


@pytest.mark.parametrize("parts", [1, 5])
def test_language_fusion_by_hand(spark, parts, monkeypatch):
    monkeypatch.setattr(op10_language, "LEAST", 40)
    monkeypatch.setattr(op10_language, "SLICE_BYTES", 300)
    texts = [("de", "das ist ein kleiner satz und noch einer dazu"), ("fr", "ceci est une petite phrase et encore une autre"), ("de-AT", "der hund und die katze laufen durch den garten"), ("en", "this is a small sentence and here is another one"), ("xx", "kurz"), (None, "nothing"), ("en", None), ("en", ""), ("de", "y"), ("de", "das ist ein kleiner satz und noch einer dazu"), ("odd tag", "abc abc abc abc abc abc abc abc abc abc abc abc")]
    page = lambda lang, body: f"<html lang='{lang}'><head><script>das ist</script></head><body><p>{body}</p></body></html>"
    pages = [
        (1, "http://a.site.de/x", page("de", "der kleine hund und die katze " * 30)), (2, "http://a.site.de/y", page("en", "une autre petite phrase")), (3, "http://b.site.de/", page("fr", "")), (4, "https://www.other.fr/z", None),
        (5, None, page("de", "another small sentence here")), (6, "odd", ""), (1, "http://a.site.de/x", page("de", "der kleine hund und die katze " * 30)), (None, "http://b.site.de/q", "<p>this is one"), (8, "http://b.site.de/q", "<div class='top ad'>der hund</div>x"),
    ]
    langs = ["de", "en", "fr"]
    buckets = lambda t: op10_language.trigrams(np.frombuffer(t.encode(), dtype=np.uint8)).tolist()
    counts = {lang: Counter() for lang in langs}
    for lang, t in texts:
        if (lang or "")[:2] in counts and len(lang.split()) == 1:
            counts[lang[:2]].update(buckets(t or ""))
    total = {lang: sum(c.values()) + 0.5 * op10_language.BUCKETS for lang, c in counts.items()}
    rows = []
    for pid, url, html in pages:
        m = re.search(r"://([^/]+)", url or "")
        host = m[1] if m else ""
        said = re.search("lang='(..)'", html or "")
        body = " ".join(re.sub(r"\s+", " ", op10_language.visible(html or "")).split(" "))
        b = buckets(body)
        ll = [sum(math.log((counts[lang][x] + 0.5) / total[lang]) for x in b) * min(1, 60 / max(1, len(b))) for lang in langs]
        rows.append((pid, host, ".".join(host.split(".")[-2:]), host.split(".")[-1], said[1] if said else "", len(b), ll, softmax(ll)))
    mass = lambda at, value: [sum(r[7][i] for r in rows if r[at] == value) for i in range(3)]
    every = [sum(r[7][i] for r in rows) for i in range(3)]
    want = []
    for pid, host, domain, suffix, said, n, ll, post in rows:
        prior = [(x + 1) / (len(rows) + 3) for x in every]
        for at, value in ((2, domain), (1, host)):
            pages_here = sum(r[at] == value for r in rows)
            prior = [(max(m - p, 0) + 20 * up) / (pages_here - 1 + 20) for m, p, up in zip(mass(at, value), post, prior, strict=True)]
        logs = [x + math.log(p) for x, p in zip(ll, prior, strict=True)]
        for at, value in ((4, said), (3, suffix)):
            width = len({r[at] for r in rows})
            logs = [x + math.log((m + 0.5) / (e + 0.5 * width)) for x, m, e in zip(logs, mass(at, value), every, strict=True)]
        final = softmax(logs)
        want.append((pid, host, said, langs[post.index(max(post))] if n else None, langs[final.index(max(final))], round(max(final), 4)))
    docs = spark.createDataFrame([(t, lang, "z", 1) for lang, t in texts], "text string, lang string, host string, page_id int").repartition(parts)
    frame = spark.createDataFrame([(*p, "fr", "x") for p in pages], "page_id long, url string, html string, lang string, text string").repartition(parts)
    got = op10_language.languages(frame, docs).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(((r.page_id, r.host, r.declared, r.text_lang, r.lang, round(r.confidence, 4)) for r in got), key=key) == sorted(want, key=key)


def test_language_ties_and_no_models(spark):
    docs = spark.createDataFrame([("abc abc abc " * 200, "fr"), ("abc abc abc " * 200, "de")], "text string, lang string")
    pages = spark.createDataFrame([(1, "http://x.org/", "<p>abc abc")], "page_id long, url string, html string")
    assert [r.lang for r in op10_language.languages(pages, docs).collect()] == ["de"]
    assert [(r.lang, r.confidence) for r in op10_language.languages(pages, docs.limit(0)).collect()] == [(None, None)]


def test_empty_tables(spark, sf_dir):
    read = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet").limit(0)
    docs = read("documents")
    assert op1_packing.pack(docs, tokens.vocabulary()).count() == 0
    assert op2_toxicity.toxicity(docs, read("labels")).count() == 0
    assert op3_token_counts.token_counts(docs, tokens.vocabulary()).count() == 0
    assert op4_simhash.components64(docs).count() == op4_simhash.near_duplicates(docs).count() == 0
    assert op5_decontaminate.decontaminate(docs, read("benchmark")).count() == 0
    rows = op6_preference.turns(read("conversations"))
    assert op6_preference.preferences(rows, op6_preference.first_turn_pairs(rows)).count() == 0
    assert op7_lattice_lm.lm_scores(op7_lattice_lm.split(docs), op7_lattice_lm.vocabulary(), "held_out").count() == 0
    assert op8_line_dedup.line_dedup(docs).count() == op9_quality.quality(docs).count() == 0
    assert op10_language.languages(read("pages"), docs).count() == 0


def test_registered():
    names = list(queries.queries())
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names) == list(range(1, 11))


def test_rows_of_one_document_and_rows_without_an_id_link(spark):
    rng = np.random.default_rng(31)
    text = lambda n=120: " ".join(f"v{x}" for x in rng.integers(0, 5000, n))
    x, y, z = text(), text(), text()
    rows = [(3, x), (5, x), (5, y), (9, y), (20, z), (None, z), (None, text()), (30, ""), (None, None), (31, " \n")]
    frame = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, component_id int")
    for found in (op4_simhash.components64(frame), op4_simhash.near_duplicates(frame)):
        got = Counter((r.doc_id, r.component_id) for r in found.collect())
        assert got == Counter({(3, 3): 1, (5, 3): 2, (9, 3): 1, (20, 20): 1, (None, 20): 1, (None, None): 1, (30, 30): 1, (31, 30): 1, (None, 30): 1})


def test_a_row_without_an_id_is_a_bridge(spark):
    """Texts whose fingerprints lie 4 bits apart, and one between them; then sets at 0.8 of one between them."""
    rng = np.random.default_rng(2)
    base = [f"b{i}" for i in range(400)]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    variants = [" ".join([*base[:i], "q" + str(int(rng.integers(0, 9))), *base[i + 1 :]]) for i in rng.integers(0, 400, 150)]
    prints = {r.doc_id: int(r.fingerprint, 16) for r in op4_simhash.components64(frame(list(enumerate(variants)))).collect()}
    bridge = next(((a, m, b) for m in prints for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() > 2 >= max((prints[a] ^ prints[m]).bit_count(), (prints[b] ^ prints[m]).bit_count())), None)
    assert bridge
    a, m, b = bridge
    apart = {r.doc_id: r.component_id for r in op4_simhash.components64(frame([(1, variants[a]), (2, variants[b])])).collect()}
    assert apart == {1: 1, 2: 2}
    met = {r.doc_id: r.component_id for r in op4_simhash.components64(frame([(1, variants[a]), (2, variants[b]), (None, variants[m])])).collect()}
    assert met == {1: 1, 2: 1, None: 1}
    left, right = " ".join(base[:360]), " ".join(base[40:])
    assert {r.component_id for r in op4_simhash.near_duplicates(frame([(1, left), (2, right), (None, " ".join(base))])).collect()} == {1}
    assert {r.component_id for r in op4_simhash.near_duplicates(frame([(1, left), (2, right)])).collect()} == {1, 2}
