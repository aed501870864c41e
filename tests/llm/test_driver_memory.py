"""What the driver holds between the steps of a stage: heap, native memory, and its Python's memory."""

import gc
import re
from pathlib import Path

from wayfleet.llm import common, op2_toxicity


def resident(pid="self"):
    """MB without mapped files."""
    return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", Path(f"/proc/{pid}/smaps_rollup").read_text()))) / 1024


def test_settle_returns_heap(spark, monkeypatch):
    monkeypatch.setattr(common, "TIDY_S", 0, raising=False)
    jvm = spark.sparkContext._jvm
    heap = jvm.java.lang.Runtime.getRuntime()
    held = [spark.sparkContext._gateway.new_array(jvm.long, 1 << 24) for _ in range(int(0.6 * heap.maxMemory()) >> 27)]
    del held
    gc.collect()
    assert 2 * heap.totalMemory() > heap.maxMemory()
    assert common.settle(spark.range(10)).count() == 10
    assert 2 * heap.totalMemory() <= heap.maxMemory()


def test_settle_returns_native_memory(spark, monkeypatch):
    monkeypatch.setattr(common, "TIDY_S", 0, raising=False)
    jvm = spark.sparkContext._jvm
    pid = jvm.java.lang.ProcessHandle.current().pid()
    before = resident(pid)
    held = [jvm.java.util.zip.Deflater() for _ in range(1500)]
    for i, d in enumerate(held):  # those that stay keep the C library from shrinking by itself
        if i % 50:
            d.end()
    freed = resident(pid)
    assert freed > before + 60
    common.settle(spark.range(10))
    assert resident(pid) < before + (freed - before) / 2
    for d in held[::50]:
        d.end()


def test_training_returns_memory(spark, monkeypatch):
    held = []

    def fitted(docs, labels, train):
        made = [bytes(2000) for _ in range(150_000)]
        held.append(made[-1])  # it keeps the C library from shrinking by itself
        return None

    monkeypatch.setattr(op2_toxicity, "fitted", fitted)
    docs, labels = spark.createDataFrame([(1, "a text")], "doc_id long, text string"), spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    before = resident()
    assert op2_toxicity.toxicity(docs, labels).first()["score"] == 0
    assert resident() < before + 100
