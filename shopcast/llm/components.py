"""Connected components of a graph whose edges are a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopcast.sources import stage


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).collect()[0]
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges`` (columns u, v): root is the smallest node it reaches.

    Each round hangs larger neighbours under the smallest known one (large
    star), then smaller ones (small star), until nothing changes.  Rounds grow
    with the logarithm of the longest path.  Every round is written to the
    shared folder.  Nodes without an edge do not occur.
    """
    down = F.struct(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).alias("e")
    edges = stage(edges.where("u <> v").select(down).select("e.*").distinct(), "edges")
    before = _mark(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = stage(
            both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(),
            "edges",
        )
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stage(hung.unionByName(low.withColumnRenamed("m", "v")).distinct(), "edges")
        after = _mark(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
