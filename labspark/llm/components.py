"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labspark.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node of its component, for every node of ``edges`` (``a``, ``b``).

    Large star and small star in turn: each round joins every node to the smallest neighbour it knows, and stops when
    nothing changes, after about the logarithm of the longest path. A round is written to the shared folder, so a lost
    executor costs the round at most. A node with very many neighbours never has them in one task: minima are formed
    before the shuffle, and joins to a popular node are split by Spark.
    """
    both = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    current, before = stored(both, "edges"), None
    while True:
        # Large star: larger neighbours go to the smallest of the neighbourhood.
        around = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
        large = around.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
        # Small star: smaller neighbours and the node itself go to the smallest.
        lowest = large.groupBy("a").agg(F.min("b").alias("least"))
        moved = large.join(lowest, "a").where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
        current = stored(moved.unionByName(lowest.withColumnRenamed("least", "b")).distinct(), "edges")
        mark = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        current.select("b", "b").toDF("node", "root").distinct()
    )
