"""Connected components by alternating large and small stars; no task holds a component, the driver holds two sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trapline.session import cut


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): the least node of every node's component, for all nodes with an edge to another one."""
    links = edges.where(F.col(a) != F.col(b))
    stars = cut(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    state = _state(stars)
    while True:
        both = _both_ways(stars)
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut(large.where(F.col("u") != F.col("v")).distinct())
        floor = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(floor, "u").select(
            F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")
        ).select("e.u", "e.v")
        stars = cut(small.where(F.col("u") != F.col("v")).distinct())
        state, before = _state(stars), state
        if state == before:
            tops = stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(tops)
