"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop_written, written


def components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """node, component (the smallest node reachable) for every node with a link to another.

    Each step keeps the number of links or lowers it and is a grouped minimum and a join; its result
    is written, so that lineage stays short.  Links with a null end and loops are left out.
    """
    edges = written(links.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).where("u > v").distinct(), "links")
    state = _state(edges)
    while state[0]:
        both = edges.union(edges.select("v", "u")).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        last, edges = edges, written(small.where("u > v").distinct(), "links")
        drop_written(last)
        before, state = state, _state(edges)
        if state == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _state(edges: DataFrame) -> tuple[int, int]:
    """How many links there are and a digest of them."""
    n, digest = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v") % 1_000_000_007), F.lit(0))).first()
    return n, digest
