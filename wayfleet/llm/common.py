"""What several operators share: Arrow words of a batch, row filters, checkpoints."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import time
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of text that a Python worker handles at once; a longer text is handled alone.
SLICE_BYTES = 2 << 20


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(col: str, n: int) -> Column:
    """crc32 of the column as text, modulo n; null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit(""))) % n


def language(col: str = "lang") -> Column:
    """The language of a tag like de or en-GB: two or three letters in lower case, else null."""
    return F.nullif(F.lower(F.regexp_extract(F.trim(F.col(col)), "^([A-Za-z]{2,3})(?:[-_].*)?$", 1)), F.lit(""))


def tallied(key: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and how often (or with what total weight) each comes; what is held grows with the keys given alone."""
    if not len(key):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    if int(key.max()) <= 4 * len(key) + 1024:
        n = np.bincount(key, weight)
        at = np.flatnonzero(n)
        return at, n[at]
    at, inverse = np.unique(key, return_inverse=True)
    return at, np.bincount(inverse, weight)


#: Words of 64 bits of a sieve at most (32 MB); it has 16 bits a key where that is less.
SIEVE = 1 << 22


def sieve_of(known: DataFrame) -> np.ndarray:
    """Bits that are set for known's keys (key long); only the sieve's words reach the driver, and a full one lets all through."""
    size = 1 << max(4, min(SIEVE.bit_length() - 1, (known.count() // 4).bit_length()))
    bit = F.expr("shiftleft(1L, cast(key & 63 as int))")
    got = known.groupBy(F.expr(f"cast(shiftrightunsigned(key, 6) & {size - 1} as int)").alias("at")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(size, dtype=np.uint64)
    out[got["at"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    return out


def sifted(sieve: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Which keys the sieve lets through: all known ones, and others by chance."""
    key = key.view(np.uint64)
    return (sieve[(key >> np.uint64(6) & np.uint64(len(sieve) - 1)).astype(np.int64)] >> (key & np.uint64(63)) & np.uint64(1)).astype(bool)


def may_be_in(known: DataFrame, key: Column) -> Column:
    """Whether a row's key (long) can be among known's keys (key long), by a broadcast sieve of bounded size: true for all known ones, and for others by chance."""
    sieve = known.sparkSession.sparkContext.broadcast(sieve_of(known))

    @F.arrow_udf("boolean")
    def may(keys: pa.Array) -> pa.Array:
        return pa.array(sifted(sieve.value, keys.to_numpy(zero_copy_only=False)))

    return may(key)


def settle(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the cluster's shared folder (spark.checkpoint.dir)."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    done = df.checkpoint()
    tidy(df.sparkSession)
    return done


#: Seconds at least between two times that the driver's JVM is tidied.
TIDY_S = 5
_tidied = [0.0]


def tidy(spark) -> None:
    """Keeps the driver's JVM small, whatever number of short jobs a long stage has. Their garbage makes the heap grow, which only a full collection undoes; it also lets shuffles,
    broadcasts and checkpoints go that nothing refers to. Native memory that is freed stays with the C library's arenas until they are trimmed."""
    if time.monotonic() - _tidied[0] < TIDY_S:
        return
    jvm = spark.sparkContext._jvm
    jvm.java.lang.System.gc()
    with contextlib.suppress(Py4JError):  # only HotSpot on glibc has it
        args = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 4)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    _tidied[0] = time.monotonic()


def give_back() -> None:
    """What this process has freed goes back to the machine; the C library would hold on to what a peak took."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table of its own in the shared folder, so that what is read of it again is just the columns in use."""
    path = f"{shared_folder(df.sparkSession)}/{name}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_folder(spark) -> str:
    """The cluster's shared folder (spark.checkpoint.dir). Where it is unset, a local master gets a folder of its own; a cluster is refused, as its machines don't see one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    sc = spark.sparkContext
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own_folder(sc.applicationId)


@lru_cache(maxsize=4)
def _own_folder(application: str) -> str:
    return tempfile.mkdtemp(prefix=application)


def only(df: DataFrame, **cols: str) -> DataFrame:
    """Just the named columns with these types; a missing one is null, others are left behind."""
    return df.select(*[(F.col(f"`{c}`").cast(t) if c in df.columns else F.lit(None).cast(t)).alias(c) for c, t in cols.items()])


def slices(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches again, cut so that each holds about SLICE_BYTES of text at most (or one row)."""
    for b in batches:
        if not b.num_rows:
            continue
        ends = np.cumsum(lengths(b.column(text)))
        start = 0
        while start < b.num_rows:
            done = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + SLICE_BYTES, side="right")))
            yield b.slice(start, stop - start)
            start = stop


def lengths(a: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.binary_length(a), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def texts(b: pa.RecordBatch, name: str = "text", lower: bool = False) -> pa.Array:
    """A text column without nulls; lower: with A-Z (and no other letter) in lower case."""
    a = pa.concat_arrays([b.column(name)])  # a copy: ascii_lower misreads a slice's offsets
    a = pc.fill_null(a.cast(pa.large_string()), "")
    return pc.ascii_lower(a) if lower else a


def words(a: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words `[^\\x20\\x09-\\x0D]+` of the texts in a row, and where each text's words start (one more entry: the end)."""
    lists = pc.ascii_split_whitespace(a)
    flat, parent = lists.flatten(), pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    full = lengths(flat) > 0
    starts = np.zeros(len(a) + 1, dtype=np.int64)
    np.cumsum(np.bincount(parent[full], minlength=len(a)), out=starts[1:])
    return flat.filter(pa.array(full)), starts


def _term_bytes() -> np.ndarray:
    out = np.full(256, 32, dtype=np.uint8)
    out[48:58], out[97:123], out[128:] = np.arange(48, 58), np.arange(97, 123), np.arange(128, 256)
    out[65:91] = np.arange(97, 123)
    return out


_TERM = _term_bytes()


def terms(a: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """As words(), of terms: runs of ASCII letters (A-Z in lower case), digits and characters beyond ASCII."""
    data, off = raw(a)
    plain = pa.LargeStringArray.from_buffers(len(a), pa.py_buffer(np.ascontiguousarray(off, dtype=np.int64)), pa.py_buffer(_TERM[data]))
    return words(plain)


def coded(flat: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """A code for each word, and the distinct words that the codes point to."""
    d = flat.dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary


def raw(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in a row, and where each text starts (one more entry: the end)."""
    if isinstance(a, pa.ChunkedArray):
        a = a.combine_chunks()
    a = a.cast(pa.large_string()) if not pa.types.is_large_string(a.type) else a
    off = np.frombuffer(a.buffers()[1], dtype=np.int64)[a.offset : a.offset + len(a) + 1]
    data = np.frombuffer(a.buffers()[2] or b"", dtype=np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The sum of each stretch of values between two starts; 0 for an empty one."""
    total = np.zeros(len(values) + 1, dtype=np.result_type(values.dtype, np.int64))
    np.cumsum(values, out=total[1:])
    return total[starts[1:]] - total[starts[:-1]]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that near values spread."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))
