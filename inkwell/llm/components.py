"""Connected components by alternating large-star and small-star steps, written to the shared folder in between."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import written


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Each node's larger (or not larger) neighbours are tied to the smallest node around it."""
    if large:
        near = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    # written, so that Spark can split the join below where one node has very many edges
    least = written(near.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "stars", True)
    joined = near.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node with an edge ``u``, ``v``; a component is named by its smallest node."""
    now = written(edges.select("u", "v").where("u <> v AND u IS NOT NULL AND v IS NOT NULL").distinct(), "edges", True)
    mark = _mark(now)
    while mark[0]:
        following = written(_star(_star(now, True), False), "edges", True)
        new = _mark(following)
        now, old, mark = following, mark, new
        if new == old:
            break
    named = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return named.union(now.select(F.col("v"), F.col("v")).distinct()).groupBy("node").agg(F.min("component").alias("component"))
