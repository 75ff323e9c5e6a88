"""Connected components of an edge table, by alternating large and small stars, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from municipia.llm.shared import Scratch


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Link each node's neighbours to the least of them and itself: the larger neighbours (large), or the smaller ones."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    hung = both.join(least, "a")
    if large:
        hung = hung.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        hung = hung.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return hung.where(F.col("a") > F.col("b")).distinct()


def components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """node, component (its least node) for every node of edges (a, b); ids of any ordered type.

    Each round writes its stars to the scratch folder, so a lost executor costs one round at most. Ends when a round changes
    nothing; the number of rounds grows with the logarithm of the number of nodes.
    """
    scratch = scratch or Scratch(edges.sparkSession)
    held = scratch.written(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    sign = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    before = sign(held)
    while before[0]:
        held = scratch.written(_stars(_stars(held, large=True), large=False))
        if (now := sign(held)) == before:
            break
        before = now
    return held.select(F.col("a").alias("node"), F.col("b").alias("component")).union(held.select("b", "b").distinct())
