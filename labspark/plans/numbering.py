"""Running numbers and pages within groups of any size.

Numbering needs the order of a whole group, but no task needs the whole group. Rows are dealt out by ranges of group and
order, so each partition is one stretch, a slice, of that order; a large group lies in several slices and small groups
share one. A row's number is its place in the slice plus the rows of its group in the slices before. There is one way for
all groups, no group is counted beforehand, and the order may be of any type.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labspark.plans.hotgroups import settled

PAGE = "page"


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Add ``name``: 1, 2, ... within each group of ``keys`` in rising ``order``; nulls come first.

    The ranges come from a sample of the rows, so the dealt rows are checkpointed once: every later read, after a lost
    executor too, sees the same slices.
    """
    ranged = df.repartitionByRange(*keys, *order).withColumn("_slice", F.spark_partition_id())
    rows = settled(ranged)
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_rows"))
    begins = sums.select(
        *[F.col(k).alias(f"_key_{i}") for i, k in enumerate(keys)],
        F.col("_slice").alias("_of"),
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"),
    )
    same = F.col("_slice") == F.col("_of")
    for i, key in enumerate(keys):
        same = same & F.col(key).eqNullSafe(F.col(f"_key_{i}"))
    inside = F.row_number().over(Window.partitionBy(*keys, "_slice").orderBy(*order))
    return rows.join(begins, same).withColumn(name, F.col("_before") + inside).select(*df.columns, name)


def paged(df: DataFrame, keys: Sequence[str], order: Sequence[str], length: int) -> DataFrame:
    """Add ``page`` from 0 and ``position`` from 1: pages of ``length`` rows of a group, contiguous in its order."""
    placed = numbered(df, keys, order, "position")
    return placed.withColumn(PAGE, F.floor((F.col("position") - 1) / F.lit(length)).cast("bigint"))
