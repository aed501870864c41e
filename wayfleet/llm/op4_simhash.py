"""SimHash near-duplicates by anchor-point covering.

Anchors are the words of a covering code of 64 bits: the perfect Hamming code on 63 of them, and the last bit as
it is. Every point lies within 1 bit of an anchor (the covering radius). Two fingerprints within 2 bits (the
threshold) have a point between them within 1 bit of both, so both lie within radius + 1 = 2 bits of the anchor
nearest to it: sent to every anchor within 2 bits (33 at most, 2 for a fingerprint that is one), they meet. An anchor
gets distinct fingerprints of its own ball alone, 2081 at most, whatever the data: each fingerprint goes the same way
with the same number of rows, and each anchor compares all its members. `links64` gives a spanning forest of what an
anchor finds, so links are fewer than its members. The result is exact.

`near_duplicates` links texts whose sets of distinct word shingles have a Jaccard similarity of the threshold or
more. Anchors of the sets' fingerprints give the first candidates; they hold close pairs alone, so an exact search
follows for all others (up to equal 64-bit hashes). It is a prefix filter: with any
one order of all shingles, two such texts share one among the first (1 - threshold) of each; the order
puts shingles of rarely used buckets first, so that common passages make no candidates. Sizes and
places of the shared shingle drop pairs that can't reach the threshold. Each shared shingle's texts are
compared with its smallest, then those in other components with each other and with the rest, in tiles
of `TILE` by `TILE`. All candidates are joined with their shingles and counted.

Nodes are the distinct fingerprints (or shingle sets, by a digest of 64 bits) themselves, so what a row links doesn't
depend on its doc_id.

Defined results: equal fingerprints (or shingle sets) are one node, however many rows have them; several rows of one
doc_id are one document, which links what each of them links; no words give
fingerprint zero (an empty set), linked like any other; rows without a doc_id link what others link, each on its own, and get
the component's smallest doc_id (null if it has none); repeated rows come back as often; other columns are left behind; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfleet.llm.common import coded, mix, only, raw, settle, sieve_of, sifted, slices, sums, texts, words
from wayfleet.llm.graph import components

SEED = 42
#: Bits in which linked fingerprints differ at most; cells of comparison matrices that a task holds at once.
NEAR, CELLS = 2, 1 << 22
#: Buckets in which shingles are counted for their order; texts on a side of a tile.
BUCKETS, TILE = 1 << 18, 64
#: Bits of a set's bitmap at least, by which pairs that can't be similar enough go before whole sets are joined.
BITS = 2048
_SPREAD = np.array([sum((b >> i & 1) << (8 * i) for i in range(8)) for b in range(256)], dtype=np.uint64)


def shingles(flat: pa.Array, starts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of each text's k-word shingles in a row (a shorter text: all its words), and where each text's start."""
    data, off = raw(flat)
    n = len(flat)
    first, last = off[:-1] + np.arange(n), off[1:] + np.arange(n)  # in the words joined by single spaces
    joined = np.full(len(data) + n, 32, dtype=np.uint8)
    joined[np.arange(len(data)) + np.repeat(np.arange(n), off[1:] - off[:-1])] = data
    size = np.diff(starts)
    count = np.where(size >= k, size - k + 1, np.minimum(size, 1))
    to = np.concatenate([[0], np.cumsum(count)])
    begin = np.repeat(starts[:-1] - to[:-1], count) + np.arange(to[-1])
    end = np.minimum(begin + k, np.repeat(starts[1:], count)) - 1
    b, digest = joined.tobytes(), xxhash.xxh64_intdigest
    h = np.fromiter((digest(b[i:j], SEED) for i, j in zip(first[begin].tolist(), last[end].tolist(), strict=True)), dtype=np.uint64, count=int(to[-1]))
    return h, to


def majority(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Per stretch of hashes the 64-bit word of bits that over half of them have; zero for an empty stretch."""
    size = np.diff(starts)
    out = np.zeros(len(size), dtype=np.uint64)
    if not len(h):
        return out
    parts = -(-size // 255)  # a byte counts to 255
    to = np.concatenate([[0], np.cumsum(parts)])
    cut = np.repeat(starts[:-1], parts) + 255 * (np.arange(to[-1]) - np.repeat(to[:-1], parts))
    lanes = np.add.reduceat(_SPREAD[h.view(np.uint8).reshape(-1, 8)], cut, axis=0).view(np.uint8).reshape(-1, 64)
    full = size > 0
    ones = np.add.reduceat(lanes.astype(np.int64), to[:-1][full], axis=0)
    out[full] = np.packbits(2 * ones > size[full][:, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(docs: DataFrame, *parts: tuple[int, int]) -> DataFrame:
    """(doc_id, fp array<long>): for each (shingle, n) of parts, n 64-bit words of the text's shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            flat, starts = words(texts(b, lower=True))
            made = []
            for k, n in parts:
                h, at = shingles(flat, starts, k)
                made += [majority(h if not i else mix(h + np.uint64(i)), at) for i in range(n)]
            fp = np.stack(made, axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * fp.shape[1], pa.int32()), pa.array(fp.ravel()))], names=["doc_id", "fp"])

    return only(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, fp array<long>")


def anchors(fp: np.ndarray) -> np.ndarray:
    """Anchors within 2 bits of each 64-bit fingerprint, a row each; and which of them there are."""
    syndrome = np.zeros(len(fp), dtype=np.int64)
    for i in range(1, 64):
        syndrome ^= np.where(fp >> np.uint64(i - 1) & np.uint64(1), i, 0)
    bit = np.append(np.uint64(0), np.uint64(1) << np.arange(63, dtype=np.uint64))  # of position i from 1 on; none for 0
    near = fp ^ bit[syndrome]
    ways, there = [near, near ^ np.uint64(1 << 63)], [np.ones(len(fp), dtype=bool)] * 2
    for i in range(1, 64):  # two bits whose positions add up to the syndrome lead to a word
        j = syndrome ^ i
        ways.append(fp ^ bit[i] ^ bit[j])
        there.append((j > i) & (syndrome > 0))
    return np.stack(ways, axis=1), np.stack(there, axis=1)


def replicated(nodes: DataFrame) -> DataFrame:
    """nodes (node, fp) -> (anchor, node, fp): a row for each anchor that a fingerprint goes to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2_000):
                b = whole.slice(at, 2_000)
                fp = b.column("fp").to_numpy(zero_copy_only=False).astype(np.int64)
                key, there = anchors(fp.view(np.uint64))
                row, way = np.nonzero(there)
                yield pa.RecordBatch.from_arrays([pa.array(key[row, way].view(np.int64)), b.column("node").take(pa.array(row)), pa.array(fp[row])], names=["anchor", "node", "fp"])

    return nodes.select("node", "fp").mapInArrow(run, "anchor long, node long, fp long")


def forests(anchor: np.ndarray, node: np.ndarray, fp: np.ndarray) -> np.ndarray:
    """Of rows in order of anchor the links (a, b) that connect what an anchor's members within 2 bits connect."""
    first = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
    size = np.diff(np.append(first, len(anchor)))
    found = [np.zeros((0, 2), dtype=np.int64)]
    for k in np.unique(size[size > 1]).tolist():
        groups, many = first[size == k], max(1, CELLS // (k * k))
        for at in range(0, len(groups), many):
            rows = groups[at : at + many, None] + np.arange(k)
            rows = np.take_along_axis(rows, np.argsort(node[rows], axis=1), axis=1)
            own = fp[rows]
            close = np.bitwise_count(own[:, :, None] ^ own[:, None, :]) <= NEAR
            label = np.broadcast_to(np.arange(k, dtype=np.int16), rows.shape)
            while True:
                least = np.where(close, label[:, None, :], np.int16(k)).min(2)
                if (least == label).all():
                    break
                label = least
            g, i = np.nonzero(label != np.arange(k))
            found.append(np.stack([node[rows[g, label[g, i]]], node[rows[g, i]]], axis=1))
    return np.concatenate(found)


def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (anchor, node, fp) in order of anchor -> links; held are a batch and the rows of its last anchor."""
    rest = [np.zeros(0, dtype=np.int64)] * 3

    def links(rows: list[np.ndarray]) -> pa.RecordBatch:
        pairs = forests(rows[0], rows[1], rows[2].view(np.uint64))
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    for b in batches:
        rows = [np.concatenate([r, c.to_numpy(zero_copy_only=False)]) for r, c in zip(rest, b.columns, strict=True)]
        if len(rows[0]):
            cut = int(np.searchsorted(rows[0], rows[0][-1]))
            rest = [r[cut:] for r in rows]
            if cut:
                yield links([r[:cut] for r in rows])
    if len(rest[0]):
        yield links(rest)


def links64(nodes: DataFrame) -> DataFrame:
    """nodes (node, fp long), distinct -> links (a, b) that connect what fingerprints at 2 or fewer differing bits connect."""
    at = replicated(nodes).repartition("anchor").sortWithinPartitions("anchor")
    return at.mapInArrow(compared, "a long, b long").distinct()


def same_document(rows: DataFrame) -> DataFrame:
    """rows (doc_id, node) -> links (a, b) between the nodes of each doc_id that has several."""
    own = rows.where("doc_id is not null").groupBy("doc_id", "node").agg(F.lit(1).alias("one"))
    several = rows.groupBy("doc_id").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("doc_id", "low")
    return own.join(several, "doc_id").where("node <> low").select(F.col("low").alias("a"), F.col("node").alias("b"))


def named(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """nodes (node, doc_id: its smallest) and components of nodes -> (node, component_id): the smallest doc_id of its component."""
    met = settle(nodes.join(found, "node", "left").select("node", "doc_id", F.coalesce("component", "node").alias("component")))
    names = met.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return met.join(names, "component").select("node", "component_id")


def components64(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) of each document (doc_id, text)."""
    rows = settle(fingerprints(docs, (shingle, 1)).select("doc_id", F.col("fp")[0].alias("node")))
    nodes = settle(rows.groupBy("node").agg(F.min("doc_id").alias("doc_id")))
    found = components(links64(nodes.select("node", F.col("node").alias("fp"))).unionByName(same_document(rows)))
    ids = settle(named(nodes, found))
    return rows.join(ids, "node").select("doc_id", F.lpad(F.lower(F.hex("node")), 16, "0").alias("fingerprint"), "component_id")


def sets(b: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct hashes of k-word shingles in a row (a shorter text: of all its words), and the text of each."""
    flat, starts = words(texts(b, lower=True))
    code, distinct = coded(flat)
    digest = xxhash.xxh64_intdigest
    own = np.array([digest(w, SEED) for w in distinct.to_pylist()], dtype=np.uint64)[code] if len(code) else np.zeros(0, dtype=np.uint64)
    size = np.diff(starts)
    count = np.where(size >= k, size - k + 1, np.minimum(size, 1))
    row = np.repeat(np.arange(len(size)), count)
    begin = starts[:-1][row] + np.arange(len(row)) - (np.cumsum(count) - count)[row]
    h = np.zeros(len(row), dtype=np.uint64)
    for i in range(k):
        inside = begin + i < starts[1:][row]
        h[inside] = mix(h[inside] + own[begin[inside] + i])
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], row[new]


def usage(docs: DataFrame, k: int) -> np.ndarray:
    """For each bucket of shingles, how many it has over all texts: the power of two below."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(BUCKETS, dtype=np.int64)
        for b in slices(batches):
            n += np.bincount((sets(b, k)[0] % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["bucket", "n"])

    rows = only(docs, text="string").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(BUCKETS, dtype=np.uint8)
    got = rows.select(F.col("bucket").cast("int"), F.floor(F.log2("n")).cast("byte").alias("n")).toArrow()  # one for each bucket at most
    out[got["bucket"].to_numpy()] = got["n"].to_numpy()
    return out


def bitmaps(h: np.ndarray, row: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps of sets in a row, as 64-bit words, by hashes modulo a power of two: four bits a shingle or more, and `BITS` at least; and where each set's words start."""
    length = np.maximum(BITS, 1 << np.ceil(np.log2(4 * np.maximum(size, 1))).astype(np.int64))
    ends = np.concatenate([[0], np.cumsum(length)])
    bits = np.zeros(ends[-1], dtype=bool)
    bits[ends[:-1][row] + (h % length[row].astype(np.uint64)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").view(np.int64), ends // 64


def digest(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A digest of each stretch's set of hashes, whatever their order."""
    return mix((sums(mix(h ^ np.uint64(1)).view(np.int64), starts) + np.diff(starts)).view(np.uint64)).view(np.int64)


def prefixes(docs: DataFrame, k: int, similarity: float) -> DataFrame:
    """(doc_id, node, fp, n, prefix, bits): digest and fingerprint of each text's shingle set, its size, its first shingles in the common order, and a bitmap of all."""
    shared = docs.sparkSession.sparkContext.broadcast(usage(docs, k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            h, row = sets(b, k)
            size = np.bincount(row, minlength=b.num_rows)
            starts = np.concatenate([[0], np.cumsum(size)])
            bits, cuts = bitmaps(h, row, size)
            keys = [digest(h, starts), majority(h, starts).view(np.int64)]
            h = h[np.lexsort((h, shared.value[(h % np.uint64(BUCKETS)).astype(np.int64)], row))]
            first = np.where(size > 0, size - np.ceil(similarity * size - 1e-9).astype(np.int64) + 1, 0)
            first = np.minimum(first, size)
            place = np.arange(len(h)) - starts[:-1][row]
            ends = np.concatenate([[0], np.cumsum(first)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(h[place < first[row]].view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *map(pa.array, keys), pa.array(size.astype(np.int64)), lists, pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(bits))], names=["doc_id", "node", "fp", "n", "prefix", "bits"])

    return only(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, node long, fp long, n long, prefix array<long>, bits array<long>")


def reached(n, m, i, j, similarity: float):
    """Whether sets of n and m shingles, whose first common one stands at places i and j, can have the similarity; columns or arrays."""
    least = F.least if isinstance(n, Column) else np.minimum
    return least(n - i, m - j) >= similarity / (1 + similarity) * (n + m) - 1e-6


def tiled(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Tiles' members -> pairs of different components that can have the similarity."""
    for b in batches:
        found = [np.zeros((0, 2), dtype=np.int64)]
        for members in b.column("members"):
            node, label, n, pos, side = (members.values.field(c).to_numpy(zero_copy_only=False) for c in ("node", "label", "n", "pos", "side"))
            x, y = np.flatnonzero(side != 1), np.flatnonzero(side != 0)  # 2: on both sides
            i, j = (z.ravel() for z in np.meshgrid(x, y))
            on = (label[i] != label[j]) & reached(n[i], n[j], pos[i], pos[j], similarity)
            pair = np.stack([node[i[on]], node[j[on]]], axis=1)
            found.append(np.unique(np.sort(pair, axis=1), axis=0))
        pairs = np.unique(np.concatenate(found), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def tiles(at: DataFrame, labels: DataFrame, similarity: float) -> DataFrame:
    """Shared shingles (token, node, n, pos, low) and components -> the pairs (a, b) that share one across components."""
    at = at.join(labels.toDF("node", "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    head = at.where("node = low.node").select("token", F.col("label").alias("head")).distinct()
    at = at.join(head, "token").withColumn("out", (F.col("label") != F.col("head")).cast("long"))
    many = at.groupBy("token").agg(F.sum("out").alias("outs"), F.count("*").alias("c")).where("outs > 0")
    parts = [F.ceil(c / TILE).cast("long") for c in (F.col("outs"), F.col("c") - F.col("outs"))]
    at = settle(at.join(many.select("token", parts[0].alias("q"), parts[1].alias("r")), "token"))
    own = F.pmod(F.xxhash64("node"), F.when(F.col("out") == 1, F.col("q")).otherwise(F.col("r")))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    place = lambda x, y, kind, side: F.struct(x.alias("x"), y.alias("y"), F.lit(kind).alias("kind"), side.alias("side"))
    o = F.col("own")
    among = F.transform(upto(F.col("q")), lambda i: place(F.least(o, i), F.greatest(o, i), 0, F.when(i == o, 2).when(o < i, 0).otherwise(1)))
    across = F.transform(upto(F.col("r")), lambda i: place(o, i, 1, F.lit(0)))
    inside = F.transform(upto(F.col("q")), lambda i: place(i, o, 1, F.lit(1)))
    spread = at.withColumn("own", own).withColumn("to", F.explode(F.when(F.col("out") == 1, F.concat(among, across)).otherwise(inside)))
    member = F.struct("node", "label", "n", "pos", F.col("to.side").alias("side"))
    grouped = spread.groupBy("token", "to.x", "to.y", "to.kind").agg(F.collect_list(member).alias("members"))
    return grouped.select("members").mapInArrow(lambda it: tiled(it, similarity), "a long, b long").distinct()


def alike(docs: DataFrame, pairs: DataFrame, nodes: DataFrame, k: int, similarity: float) -> DataFrame:
    """Of the pairs (a, b) of nodes (node, doc_id: a document that has it) those whose distinct shingles have the similarity. Sieves of bounded size hold back most other documents before anything of them is shuffled."""
    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = settle(wanted.join(nodes.select("node", "doc_id"), "node"))
    sc = docs.sparkSession.sparkContext
    by_doc, by_node = (sc.broadcast(sieve_of(wanted.select(c.alias("key")))) for c in (F.xxhash64("doc_id"), F.col("node")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(b.filter(pa.array(sifted(by_doc.value, b.column("key").to_numpy(zero_copy_only=False)))) for b in batches):
            h, row = sets(b, k)
            ends = np.searchsorted(row, np.arange(b.num_rows + 1))
            node = digest(h, ends)
            out = pa.RecordBatch.from_arrays([pa.array(node), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(h.view(np.int64)))], names=["node", "hashes"])
            yield out.filter(pa.array(sifted(by_node.value, node)))

    own = only(docs, doc_id="long", text="string").withColumn("key", F.xxhash64("doc_id")).mapInArrow(run, "node long, hashes array<long>").dropDuplicates(["node"])
    both = pairs.join(own.toDF("a", "x"), "a").join(own.toDF("b", "y"), "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.where(F.coalesce(F.try_divide(common, F.size("x") + F.size("y") - common) >= similarity, F.lit(True))).select("a", "b")


def possible(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """pairs (a, b) of nodes (node, n, bits) whose sizes and bitmaps allow the similarity.

    A bit of one that the other lacks is a shingle they don't share at least, so no pair that has the similarity is
    left out. The longer bitmap is folded to the length of the shorter.
    """
    own = nodes.select("node", "n", "bits")
    both = pairs.join(own.toDF("a", "_n", "_x"), "a").join(own.toDF("b", "_m", "_y"), "b")
    least = similarity / (1 + similarity) * (F.col("_n") + F.col("_m")) - 1e-6

    def halved(x: str, y: str) -> Column:
        half = F.expr(f"cast(size({x}) div 2 as int)")
        folded = F.zip_with(F.slice(x, F.lit(1), half), F.slice(x, half + 1, half), lambda p, q: p.bitwiseOR(q))
        return F.when(F.size(x) > F.size(y), folded).otherwise(F.col(x))

    both = both.where(F.least("_n", "_m") >= least)
    for _ in range(int(np.ceil(np.log2(1 / similarity)))):  # sizes within the similarity differ by no more doublings
        both = both.withColumns({"_x": halved("_x", "_y"), "_y": halved("_y", "_x")})
    lacks = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseAND(F.bitwise_not(q)))), F.lit(0), lambda s, v: s + v)
    common = F.least(F.col("_n") - lacks("_x", "_y"), F.col("_m") - lacks("_y", "_x"))
    return both.where(common >= least).select("a", "b").distinct()


def anchored(nodes: DataFrame) -> DataFrame:
    """nodes (node, fp), maybe several of one fp -> candidates (a, b): each node and the smallest that equal fingerprints and anchors connect it with."""
    heads = settle(nodes.groupBy("fp").agg(F.min("node").alias("head")))
    equal = nodes.join(heads, "fp").where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b"))
    found = components(equal.unionByName(links64(heads.select(F.col("head").alias("node"), "fp"))))
    return found.where("node <> component").select(F.col("component").alias("a"), F.col("node").alias("b"))


def postings(nodes: DataFrame) -> DataFrame:
    """nodes (node, n, prefix) -> (token, node, n, pos, low, c) of the prefixes' shingles that several nodes have; a sieve of bounded size holds back most others before they are shuffled as rows."""
    often = settle(nodes.select(F.explode("prefix").alias("key")).groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key"))
    sieve = nodes.sparkSession.sparkContext.broadcast(sieve_of(often))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("prefix")
            ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])
            token = lists.flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(b.num_rows), np.diff(ends))
            pos = np.arange(len(token)) - ends[:-1][row]
            may = sifted(sieve.value, token)
            take = pa.array(row[may])
            yield pa.RecordBatch.from_arrays([pa.array(token[may]), b.column("node").take(take), b.column("n").take(take), pa.array(pos[may].astype(np.int64))], names=["token", "node", "n", "pos"])

    at = nodes.select("node", "n", "prefix").mapInArrow(run, "token long, node long, n long, pos long")
    low = F.min(F.struct("node", "n", "pos")).alias("low")
    done = settle(at.join(at.groupBy("token").agg(low, F.count("*").alias("c")).where("c > 1"), "token"))
    sieve.destroy()
    return done


def near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, component_id) of each document (doc_id, text); the smallest doc_id of a component names it."""
    rows = settle(prefixes(docs, shingle, similarity))
    first = settle(rows.groupBy("node").agg(F.min("doc_id").alias("doc_id"), *(F.first(c).alias(c) for c in ("fp", "n", "prefix", "bits"))))  # equal sets have equal ones
    at = postings(first)
    near = at.where("node <> low.node").where(reached(F.col("n"), F.col("low.n"), F.col("pos"), F.col("low.pos"), similarity))
    near = near.select(F.col("low.node").alias("a"), F.col("node").alias("b")).unionByName(anchored(first.select("node", "fp")))
    pairs = settle(possible(near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), first, similarity))
    held = settle(alike(docs, pairs, first, shingle, similarity).unionByName(same_document(rows.select("doc_id", "node"))))
    more = tiles(at.where("c > 2").drop("c"), components(held), similarity)
    more = settle(possible(more.join(pairs, ["a", "b"], "left_anti"), first, similarity))
    found = components(held.unionByName(alike(docs, more, first, shingle, similarity)))
    ids = settle(named(first.select("node", "doc_id"), found))
    return rows.select("doc_id", "node").join(ids, "node").select("doc_id", "component_id")
