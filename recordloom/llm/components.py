"""Connected components of a table of links, without a driver-side step."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, scratch_dir, stored


def components(links: DataFrame) -> DataFrame:
    """node, comp (the smallest node of its component), for links (a, b); by turns of large and small stars.

    A turn is two aggregations and joins; a hub's rows are split by the join, never gathered.
    """
    spark = links.sparkSession
    path = scratch_dir(spark)
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), path)
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: every edge points down, so a node's least neighbour takes the others and the node
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        new = scratch_dir(spark)
        edges = stored(small, new)
        discard(spark, path)
        path = new
        # what a turn leaves as it was is a forest of stars
        state = edges.agg(F.count("*"), F.sum(F.col("u").cast("decimal(20,0)")), F.sum(F.col("v").cast("decimal(20,0)"))).head()
        if state == before:
            break
        before = state
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp"))
