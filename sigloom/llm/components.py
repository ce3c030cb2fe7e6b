"""Connected components of an edge table by alternating stars; every step is a group-by and a join.

A step keeps at most as many edges as there were, and their number of rounds grows with the logarithm of the longest
path. After each round the edges are written to the shared folder, so the plan stays short and a lost executor costs
one round at most. A node with many edges meets its minimum in a join that Spark can split, never in one group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """large: each node's larger neighbours go to the smallest of its neighbourhood; else its smaller ones and itself."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(a, b) long, a != b -> (node, root): each node of an edge with the smallest node that it reaches; roots too."""
    spark = edges.sparkSession

    def kept(df: DataFrame) -> tuple[DataFrame, tuple]:
        folder = B.scratch(spark, "edges")
        df.write.parquet(folder)
        df = spark.read.parquet(folder)
        return df, tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges, sign = kept(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        edges, now = kept(_stars(_stars(edges, True).where("a != b"), False))
        if now == sign:
            break
        sign = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
