"""Connected components of link tables, without ever holding a component in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash, unstash


def _settled(edges: DataFrame) -> bool:
    """Whether every node has one edge up at most, and none of those above has any."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("above")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("above")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("above").alias("above")).where("up > 1 or (up = 1 and above = 1)").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of (u, v), ``label`` the smallest node of its component.

    Large-star and small-star steps in turn: each hangs neighbours under the smallest node in
    reach, until every node hangs right under its component's smallest one. A step is one aggregation
    and one join on a node, which Spark can split where one node has most of the links. Each
    round is a written table. Loops and repeated links do no harm; without links the result is empty.
    """
    edges = stash(links.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    while not _settled(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        lowest = down.groupBy("u").agg(F.min("v").alias("m"))
        hung = down.join(lowest, "u")
        small = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(lowest.select("u", F.col("m").alias("v")))
        fresh = stash(small.where("u <> v").distinct(), "links")
        unstash(edges)
        edges = fresh
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
