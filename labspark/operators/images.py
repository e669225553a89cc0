"""Machine images: types, retention per group, dependents and candidate checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labspark.functions.text import glob, name_type
from labspark.plans.hotgroups import micros
from labspark.plans.topn import first_n, mark_beyond_n, newest_n

DEFAULT_KEEP = 2


def with_image_group(df: DataFrame, name: str = "name", architecture: str = "architecture") -> DataFrame:
    """Add ``image_type``, read from the name, and ``group_key``, type and architecture together."""
    typed = df.withColumn("image_type", name_type(F.col(name)))
    return typed.withColumn("group_key", F.concat_ws("-", "image_type", architecture))


def of_type(df: DataFrame, wanted: str | None, column: str = "image_type") -> DataFrame:
    """Rows of one type, whatever its case; all rows when no type is wanted."""
    return df if wanted is None else df.where(F.lower(column) == wanted.lower())


def keep_newest(
    df: DataFrame, n: int = DEFAULT_KEEP, group: str = "group_key", at: str = "creation_date", tie: str = "id"
) -> DataFrame:
    """The newest ``n`` images per group."""
    return newest_n(df, [group], at, tie, n)


def mark_surplus(
    df: DataFrame, n: int = DEFAULT_KEEP, group: str = "group_key", at: str = "creation_date", tie: str = "id"
) -> DataFrame:
    """All images with ``surplus``: true beyond the newest ``n`` of the group."""
    return mark_beyond_n(df, [group], at, tie, n, "surplus")


def in_delete_order(surplus: DataFrame, at: str = "creation_date", tie: str = "id") -> DataFrame:
    """Oldest first. For the rows to delete; sorting all images would shuffle those that stay."""
    return surplus.orderBy(F.asc(at), F.asc(tie))


def dependents_in_row(removed: DataFrame, ids: str, name: str) -> DataFrame:
    """One row per id in the list column of each removed row."""
    return removed.select("*", F.explode(ids).alias(name))


def dependents_in_table(removed: DataFrame, key: str, children: DataFrame, parent: str) -> DataFrame:
    """The child rows of removed rows, kept whole whether or not another row shares them."""
    return children.join(removed.select(F.col(key).alias(parent)), parent, "left_semi")


def newest_per_group(df: DataFrame, keys: Sequence[str], at: str, tie: str) -> DataFrame:
    return first_n(df, keys, [F.desc(at), F.asc(tie)], 1)


def check_candidates(
    df: DataFrame,
    requests: Sequence[tuple[str, str]],
    name: str = "name",
    architecture: str = "architecture",
    at: str = "creation_date",
    tie: str = "id",
) -> DataFrame:
    """For each requested (pattern, architecture): counts, a status and the newest fitting image, from one scan.

    Status is ``none`` when no name matches, ``wrong_architecture`` when only other architectures do, ``several`` when
    more than one fits and ``one`` otherwise.
    """
    age_order = F.struct((-micros(df, at)).alias("age"), F.col(tie).alias("tie"))
    aggregates: list[Column] = []
    for i, (pattern, arch) in enumerate(requests):
        named = glob(F.col(name), pattern)
        fits = named & (F.col(architecture) == arch)
        aggregates += [
            F.count_if(named).alias(f"named_{i}"),
            F.count_if(fits).alias(f"fits_{i}"),
            F.min_by(F.when(fits, F.col(tie)), F.when(fits, age_order)).alias(f"pick_{i}"),
        ]
    answers = [
        F.struct(
            F.lit(pattern).alias("pattern"),
            F.lit(arch).alias("architecture"),
            F.col(f"named_{i}").alias("n_named"),
            F.col(f"fits_{i}").alias("n_fitting"),
            F.col(f"pick_{i}").alias("picked"),
        )
        for i, (pattern, arch) in enumerate(requests)
    ]
    status = (
        F.when(F.col("n_named") == 0, "none")
        .when(F.col("n_fitting") == 0, "wrong_architecture")
        .when(F.col("n_fitting") > 1, "several")
        .otherwise("one")
    )
    return df.agg(*aggregates).select(F.inline(F.array(*answers))).withColumn("status", status)
