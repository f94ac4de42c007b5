"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugework.llm.common import written

MAX_TURNS = 60


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b: long) -> (node, root): the smallest node of the component; nodes without edges are not listed.

    Both steps only join each node with its smallest neighbour, so the neighbours of a hub are never gathered in one
    task; every step is stored. The turns grow with the logarithm of the longest chain.
    """
    stars = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = _mark(stars)
    for _ in range(MAX_TURNS):
        if before[0] == 0:
            break
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = written(both.groupBy("u").agg(F.min("v").alias("w")).select(F.col("u").alias("n"), F.least("u", "w").alias("w")), "lowest")
        large = both.where("v > u").join(low, F.col("u") == F.col("n")).select(F.col("v").alias("u"), F.col("w").alias("v"))
        large = written(large.where("u <> v").distinct(), "large-star")
        down = written(large.groupBy("u").agg(F.min("v").alias("w")).withColumnRenamed("u", "n"), "lowest")
        moved = large.join(down, F.col("u") == F.col("n")).select(F.col("v").alias("u"), F.col("w").alias("v"))
        stars = written(moved.unionByName(down.select(F.col("n").alias("u"), F.col("w").alias("v"))).where("u <> v").distinct(), "small-star")
        after = _mark(stars)
        if after == before:
            return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        before = after
    if before[0]:
        raise RuntimeError(f"components did not settle in {MAX_TURNS} turns")
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).collect()[0]
    return row["n"], row["s"]
