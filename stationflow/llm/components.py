"""Connected components of a distributed graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import written


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row.n, row.h


def components(edges: DataFrame) -> DataFrame:
    """``node root`` for every node of undirected edges (``u``, ``v``); the root is the smallest node.

    Alternates large and small stars until nothing changes: every node links
    its larger, then its smaller neighbours to the least one. Rounds grow with
    the logarithm of the longest path; each is written to the shared folder.
    Self-loops are kept as single nodes. No neighbour list is gathered in a row.
    """
    loops = edges.where("u = v").select(F.col("u").alias("node"), F.col("v").alias("root"))
    e = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = _state(e)
    while before[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.where("u <> v").distinct(), "large")
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = written(
            small.union(down.select("u", F.col("m").alias("v")))
            .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "small",
        )
        after = _state(e)
        if after == before:
            break
        before = after
    out = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return out.union(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).union(loops).groupBy("node").agg(
        F.min("root").alias("root")
    )
