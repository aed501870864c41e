"""Each stage of the pipeline against plain Python, on rows with nulls, repeats, ties, and columns that clash."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_brute_force import WORD, brute_decontaminated, groups, shingle_set, similar
from wayfleet.llm import op2_toxicity, op8_line_dedup, tokens
from wayfleet.llm.common import table

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, component_id int, at string"


def words(rng, n):
    return [f"w{x}" for x in rng.integers(0, 600, n)]


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    """A folder of tables, and its documents' rows."""
    rng = np.random.default_rng(12)
    rows, labels = [], []
    for i in range(120):
        w = words(rng, 150)
        if i % 6 == 0:
            w[int(rng.integers(0, 150))] = "zuxgrakov"
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(i % 6 == 0)))
    items = [(i, " ".join(f"b{x}" for x in rng.integers(0, 500, 20)) + f" costs {i + 2} dollars and " + " ".join(words(rng, 6))) for i in range(8)]
    menu = "Home\nAbout us\nContact here\n"
    for i in range(200, 216):  # near copies by scattered and by contiguous edits, exact ones, and ties of doc_id
        base = words(rng, 200)
        scattered = list(base)
        for at in rng.choice(200, 3, replace=False):
            scattered[at] = "changed"
        rows += [(i * 10, " ".join(base)), (i * 10 + 1, " ".join(scattered)), (i * 10 + 2, " ".join(base[:180])), (i * 10 + 3, " ".join(base).upper()), (i * 10 + 4, " ".join(base[:120] + words(rng, 80)))]
    rows += [(3000 + i, " ".join(words(rng, 30)) + " " + (t if i % 2 else t.replace(str(i + 2) + " dollars", "77 dollars")) + " " + " ".join(words(rng, 30))) for i, t in items]
    rows += [(4000, menu + "one text of its own"), (4001, menu + "another text"), (4002, menu)]
    rows += [(5000, None), (5001, ""), (5002, " \n "), (None, "a row without an id " + " ".join(words(rng, 60))), (None, None), (0, rows[0][1]), (1, rows[1][1]), (1, "a second text of document one " + " ".join(words(rng, 50))), (6000, "long " + " ".join(words(rng, 30_000)))]
    docs = [(d, t, (None, "en", "de")[n % 3], None if n % 5 else "s", None if t is None else len(t), "x", 1, "y") for n, (d, t) in enumerate(rows)]
    docs.append(docs[0])
    top = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(docs, SCHEMA).repartition(4).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([*labels, (2000, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    spark.createDataFrame([*[(i, t, 1) for i, t in items], (90, None, 1), (91, "", 1)], "item_id long, text string, doc_id int").write.parquet(f"{top}/benchmark.parquet")
    return top, [tuple(d[:5]) for d in docs], items


def run(spark, made, stage):
    docs = table(spark, made[0], "documents")
    return dict(corpus_pipeline.STAGES)[stage](spark, docs, made[0])


def bag(frame):
    assert frame.columns == corpus_pipeline.COLUMNS
    return Counter(tuple(r) for r in frame.collect())


def test_toxicity_stage(spark, made):
    docs = table(spark, made[0], "documents")
    scored = op2_toxicity.toxicity(docs.select("doc_id", "text"), table(spark, made[0], "labels"))
    rejected = {(r.doc_id, r.text) for r in scored.where("predicted = 1").collect()}
    got = bag(run(spark, made, "toxicity"))
    assert got == Counter(r for r in made[1] if (r[0], r[1]) not in rejected)
    toxic = {r[0] for r in made[1] if r[1] and "zuxgrakov" in r[1]}
    assert toxic and {d for d, _ in rejected} == toxic


def test_line_dedup_stage(spark, made):
    docs = table(spark, made[0], "documents")
    want = Counter()
    for r in op8_line_dedup.line_dedup(docs).collect():
        if not (r.n_removed and not WORD.search(r.text or "")):
            want[r.doc_id, r.text, r.lang, r.source, None if r.text is None else len(r.text)] += 1
    got = bag(run(spark, made, "line_dedup"))
    ids = Counter(k[0] for k in got.elements())
    assert got == want and 4002 not in ids and ids[4000] == ids[4001] == 1 and ids[5000] == ids[5001] == ids[5002] == 1
    assert ("another text" in {k[1] for k in got}) and sum(k[0] is None for k in got.elements()) == 2


def test_near_duplicates_stage(spark, made):
    have = defaultdict(list)
    for d, t, *_ in made[1]:
        if d is not None:
            have[d].append(shingle_set(t or ""))
    want = groups(have, lambda a, b: any(similar(x, y) for x in have[a] for y in have[b]))
    assert any(want[d] != d for d in want) and want[2001] == want[2002] == want[2003] == 2000 and want[2004] == 2004
    kept = Counter({r: 1 for r in made[1] if r[0] is not None and want[r[0]] == r[0]}) + Counter(r for r in made[1] if r[0] is None)
    assert bag(run(spark, made, "near_duplicates")) == kept


def test_decontamination_stage(spark, made):
    found = {d for d, _ in brute_decontaminated([r[:2] for r in made[1] if r[0] is not None and (r[0] < 60 or r[0] >= 3000) and r[0] != 6000], made[2])}
    assert found == set(range(3000, 3008))
    assert bag(run(spark, made, "decontamination")) == Counter(r for r in made[1] if r[0] not in found)


def test_packing_stage(spark, made):
    coder = Tokenizer.from_file(tokens.vocabulary())
    size = Counter()
    for d, t, *_ in made[1]:
        size[d] += len(coder.encode(t or "", add_special_tokens=False).ids) + 1
    have, bins = Counter(), defaultdict(list)
    texts = Counter((d, zlib.crc32((t or "").encode())) for d, t, *_ in made[1])
    for r in run(spark, made, "packing").collect():
        have[r.doc_id] += r.length
        bins[r.sequence_id].append((r.offset, r.length))
    assert have == size and len(texts)
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


def test_empty_stages(spark, made):
    docs = table(spark, made[0], "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, made[0])
        assert out.count() == 0 and (name == "packing" or out.columns == corpus_pipeline.COLUMNS)


def test_whole_run(spark, made):
    out = corpus_pipeline.run(spark, made[0]).collect()
    ids = {r.doc_id for r in out}
    assert 0 not in ids and 2000 in ids and 2003 not in ids and not ids & set(range(3000, 3008)) and {5000, 4000, 4001} & ids
