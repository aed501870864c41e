"""Fingerprints of row sets as hash trees, which are kept between runs.

Rows go to leaves by the first hexadecimal digits of sha256(key); a group (`by`) with more rows has more digits, so that a
leaf holds about `LEAF` rows whatever their number, and a tree depends on the group's own rows alone. A leaf's hash is of its
rows' `key:digest` in order, a node's of its children's `prefix:hash`. After changes only the leaves of changed keys and the
nodes over them are hashed again; two trees are compared from the top, and where a group's hashes agree nothing below is joined.
A group is never null.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfleet.operators.folds import held

LEAF, FANOUT, DEEPEST = 64, 16, 12


def _depth(n: Column) -> Column:
    return reduce(lambda d, k: d + (n > LEAF * FANOUT**k).cast("int"), range(1, DEEPEST), F.lit(1))


def _prefix(key: str, depth: Column) -> Column:
    return F.substring(F.sha2(F.col(key).cast("string"), 256), F.lit(1), depth)


def _hashed(items: Column) -> Column:
    return F.sha2(F.array_join(F.array_sort(items), "\n"), 256)


def _leaves(rows: DataFrame, by: list[str], key: str, digest: str) -> DataFrame:
    """rows (by, key, digest, depth), repeats included -> (by, level, prefix, n, hash, leaf). Repeats of a row meet in its leaf."""
    at = rows.select(*by, F.col("depth").alias("level"), _prefix(key, F.col("depth")).alias("prefix"), F.concat_ws(":", F.col(key).cast("string"), digest).alias("item"))
    return at.groupBy(*by, "level", "prefix").agg(F.collect_set("item").alias("items")).select(*by, "level", "prefix", F.size("items").cast("bigint").alias("n"), _hashed(F.col("items")).alias("hash"), F.lit(True).alias("leaf"))


def _above(nodes: DataFrame, by: list[str]) -> DataFrame:
    """The nodes over nodes of one level."""
    up = nodes.withColumns({"item": F.concat_ws(":", "prefix", "hash"), "level": F.col("level") - 1, "prefix": F.substring("prefix", F.lit(1), F.col("level") - 1)})
    return up.groupBy(*by, "level", "prefix").agg(F.sum("n").alias("n"), _hashed(F.collect_list("item")).alias("hash")).withColumn("leaf", F.lit(False))


def hash_tree(rows: DataFrame, by: list[str], key: str = "id", digest: str = "digest") -> DataFrame:
    """(by, level, prefix, n, hash, leaf): all nodes of each group's tree over its distinct rows; level 0 is the root.

    Depths are held before rows meet them: those of few groups are then broadcast, where a shuffle by group would put a
    group's rows into one task.
    """
    rows = rows.select(*by, key, digest)
    sizes = held(rows.distinct().groupBy(*by).agg(_depth(F.count("*")).alias("depth")))
    leaves = held(_leaves(rows.join(sizes, by), by, key, digest))
    out, level = leaves, None
    for k in range(leaves.agg(F.max("level")).first()[0] or 0, 0, -1):
        own = leaves.where(F.col("level") == k)
        level = held(_above(own if level is None else own.unionByName(level), by))
        out = out.unionByName(level)
    return out


def roots(tree: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, fingerprint) of each group."""
    return tree.where("level = 0").select(*by, "n", F.col("hash").alias("fingerprint"))


def refreshed(tree: DataFrame, rows: DataFrame, changed: DataFrame, by: list[str], key: str = "id", digest: str = "digest") -> DataFrame:
    """The tree of rows, from one of before and the keys (by, key) that came, went or changed.

    Leaves of these keys are hashed again, and the nodes over them; a group that is new, or whose number of rows asks
    for another depth, is built anew.
    """
    tree = held(tree)
    depths = held(tree.where("leaf").groupBy(*by).agg(F.max("level").alias("depth")))
    touched = held(changed.select(*by, key).join(depths, by).select(*by, F.col("depth").alias("level"), _prefix(key, F.col("depth")).alias("prefix")).distinct())
    near = rows.select(*by, key, digest).join(depths, by).withColumn("prefix", _prefix(key, F.col("depth")))
    near = near.join(touched.drop("level"), [*by, "prefix"], "left_semi")
    spot = [*by, "level", "prefix"]
    leaves = held(tree.where("leaf").join(touched, spot, "left_anti").unionByName(_leaves(near, by, key, digest)))
    grown = leaves.groupBy(*by).agg(_depth(F.sum("n")).alias("now"), F.max("level").alias("depth")).where("now <> depth").select(*by)
    fresh = changed.select(*by).distinct().join(depths.select(*by), by, "left_anti")
    anew = held(grown.unionByName(fresh))
    leaves = held(leaves.join(anew, by, "left_anti"))
    nodes, out, level = tree.where("not leaf").join(anew, by, "left_anti"), leaves, None
    for k in range(leaves.agg(F.max("level")).first()[0] or 0, 0, -1):
        own = leaves.where(F.col("level") == k)
        under = own if level is None else own.unionByName(level)
        up = touched.where(F.col("level") >= k).select(*by, F.lit(k - 1).alias("level"), F.substring("prefix", F.lit(1), F.lit(k - 1)).alias("prefix")).distinct()
        again = under.withColumn("_up", F.substring("prefix", F.lit(1), F.lit(k - 1))).join(up.drop("level").withColumnRenamed("prefix", "_up"), [*by, "_up"], "left_semi").drop("_up")
        level = held(nodes.where(F.col("level") == k - 1).join(up, spot, "left_anti").unionByName(_above(again, by)))
        out = out.unionByName(level)
    return out.unionByName(hash_tree(rows.join(anew, by, "left_semi"), by, key, digest))


def differing(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """(by, level, prefix) of leaves of either tree that the other lacks or holds with another hash; each level is joined only below nodes that differ."""
    spot = [*by, "level", "prefix"]
    out, parents = [], None
    top = a.unionByName(b).agg(F.max("level")).first()[0] or 0
    for k in range(top + 1):
        x, y = (t.where(F.col("level") == k).select(*spot, "hash", "leaf") for t in (a, b))
        if parents is not None:
            below = lambda t: t.withColumn("_up", F.substring("prefix", F.lit(1), F.lit(k - 1))).join(parents, [*by, "_up"], "left_semi").drop("_up")  # noqa: B023, E731
            x, y = below(x), below(y)
        met = x.join(y.select(*spot, F.col("hash").alias("_hash"), F.col("leaf").alias("_leaf")), spot, "full").where(~F.col("hash").eqNullSafe(F.col("_hash")))
        met = held(met)
        out.append(met.where(F.coalesce("leaf", F.lit(False)) | F.coalesce("_leaf", F.lit(False))).select(*spot))
        parents = met.select(*by, F.col("prefix").alias("_up"))
    return reduce(DataFrame.unionByName, out)


def increasing(rows: DataFrame, key: str, place: str) -> bool:
    """Whether key rises strictly in order of place; two values of each range of places reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, last, fine = None, None, True
        for b in batches:
            for k in b.column(0).to_pylist():
                first = k if first is None and last is None else first
                fine = fine and k is not None and (last is None or k > last)
                last = k if k is not None else last
        if first is not None or not fine:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((first, pa.int64()), (last, pa.int64()), (fine, pa.bool_()))], names=["first", "last", "fine"])

    ranges = rows.repartitionByRange(place).sortWithinPartitions(place).select(F.col(key).cast("bigint").alias(key))
    found = ranges.mapInArrow(run, "first long, last long, fine boolean").collect()
    if not all(r.fine for r in found):
        return False
    spans = sorted((r.first, r.last) for r in found)
    return [(r.first, r.last) for r in found] == spans and all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False))
