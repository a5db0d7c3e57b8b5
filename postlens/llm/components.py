"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.session import stage


def nearest(edges: DataFrame) -> DataFrame:
    """Smallest of each node `u` and its neighbours `v`. Written out, so that the join with the edges
    of a hub is one of two plain shuffles, which Spark can split."""
    return stage(edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "nearest")


def state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
                 .first())


def components(links: DataFrame) -> DataFrame:
    """`node`, `component` (its smallest node) for each node of `links` (`u`, `v`).

    A large-star step joins each node's larger neighbours to its smallest one, a small-star step its
    smaller ones; after O(log² n) of them every node hangs on its smallest. Only edges move, reduced
    by partial minima before each shuffle; no component is ever held in one task.
    """
    edges = stage(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                  .where("u > v").distinct(), "edges")
    before = state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = stage(both.where("v > u").join(nearest(both), "u")
                      .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-star")
        small = large.join(nearest(large), "u")
        edges = stage(small.select("u", F.col("m").alias("v"))
                      .unionByName(small.select(F.col("v").alias("u"), F.col("m").alias("v")))
                      .where("u > v").distinct(), "small-star")
        after = state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")) \
        .unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))) \
        .distinct()
