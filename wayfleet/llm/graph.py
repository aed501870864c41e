"""Connected components of a link table, by contraction rounds on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfleet.llm.common import settle


def components(links: DataFrame) -> DataFrame:
    """links (a long, b long) -> (node, component): the smallest node that a node reaches, for each linked node.

    A round points every node to its smallest neighbour (a minimum with map-side sums), follows the
    pointers to their roots by doubling, and keeps the links between different roots. Links of a node
    stay spread over tasks: they are only ever joined or reduced to a minimum. Null ends are left out.
    """
    rest = settle(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    found = None
    while not rest.isEmpty():
        ends = rest.unionByName(rest.select(F.col("b").alias("a"), F.col("a").alias("b")))
        roots = settle(ends.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("root")))
        while True:
            up = roots.select(F.col("node").alias("root"), F.col("root").alias("over"))
            roots = settle(roots.join(up, "root").select("node", F.col("over").alias("root"), (F.col("over") < F.col("root")).alias("moved")))
            moved = not roots.where("moved").isEmpty()
            roots = roots.select("node", "root")
            if not moved:
                break
        if found is None:
            found = roots
        else:
            up = roots.select(F.col("node").alias("root"), F.col("root").alias("over"))
            found = settle(found.join(up, "root", "left").select("node", F.coalesce("over", "root").alias("root")))
        a, b = roots.toDF("a", "ra"), roots.toDF("b", "rb")
        rest = rest.join(a, "a").join(b, "b").where("ra <> rb")
        rest = settle(rest.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    if found is None:
        found = rest
    return found.toDF("node", "component")
