"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skillweave.llm.shared import Scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link each vertex's neighbours (larger ones, or itself and smaller ones) with the least vertex around it."""
    if large:
        near = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        near = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    both = near.join(least, "u")
    if large:
        out = both.filter(F.col("v") > F.col("u")).select(F.col("v").alias("b"), F.col("m").alias("a"))
    else:
        out = both.select(F.col("v").alias("b"), F.col("m").alias("a")).unionByName(least.select(F.col("u").alias("b"), F.col("m").alias("a")))
    return out.filter(F.col("a") != F.col("b")).distinct().select("a", "b")


def connected_components(edges: DataFrame) -> DataFrame:
    """vertex, component (the least vertex reachable) for every vertex of ``edges`` (a, b).

    Ends when a round changes nothing.  Every round is written to the shared folder, so lineage stays short.
    """
    scratch = Scratch(edges.sparkSession)
    now = scratch.write(edges.filter(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    mark = None
    while True:
        now = scratch.write(_star(_star(now, True), False), "edges")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == tuple(seen):
            break
        mark = tuple(seen)
    return now.select(F.col("b").alias("vertex"), F.col("a").alias("component")).unionByName(now.select(F.col("a").alias("vertex"), F.col("a").alias("component")).distinct())
