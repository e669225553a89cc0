"""Catalogues and configuration: union, duplicates and overlays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_catalogues(main: DataFrame, *extras: DataFrame, origin: str = "origin") -> DataFrame:
    """Main rows and extra rows in one table; ``origin`` is 0 for main and counts the extras from 1.

    Columns that one side lacks are null there.
    """
    out = main.withColumn(origin, F.lit(0))
    for i, extra in enumerate(extras, 1):
        out = out.unionByName(extra.withColumn(origin, F.lit(i)), allowMissingColumns=True)
    return out


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys found more than once, with their count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") > 1)


def require_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows unchanged; fails when a key is found more than once."""
    found = duplicate_keys(df, keys).orderBy(*keys).limit(5).collect()
    if found:
        names = "; ".join(", ".join(str(row[k]) for k in keys) for row in found)
        raise ValueError(f"duplicate {', '.join(keys)}: {names}")
    return df


def overlay(base: DataFrame, patch: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Patch values over base values: unmatched base rows stay and new keys are added."""
    over = patch.select(*keys, F.col(value).alias("_patch"), F.lit(True).alias("_patched"))
    joined = base.join(over, list(keys), "full")
    return joined.select(*keys, F.when(F.col("_patched"), F.col("_patch")).otherwise(F.col(value)).alias(value))


def overlay_paths(
    base: DataFrame, patch: DataFrame, path: str = "path", value: str = "value", keys: Sequence[str] = ()
) -> DataFrame:
    """``overlay`` for flattened documents with dotted paths; ``keys`` tell documents apart when there are several.

    A patch value replaces the whole branch below its path, and a patched branch replaces a base value above it.
    """
    depth = F.size(F.split(path, "\\."))

    def above(df: DataFrame) -> DataFrame:
        ups = F.when(depth > 1, F.sequence(F.lit(1), depth - 1)).otherwise(F.array().cast("array<int>"))
        upper = F.explode(F.transform(ups, lambda n: F.array_join(F.slice(F.split(path, "\\."), 1, n), ".")))
        return df.select(*keys, F.col(path), upper.alias("_above"))

    patched = patch.select(*keys, F.col(path).alias("_above"))
    covered = above(base).join(patched, [*keys, "_above"], "left_semi").select(*keys, path)
    opened = above(patch).select(*keys, F.col("_above").alias(path))
    replaced = covered.unionByName(opened).distinct()
    return overlay(base.join(replaced, [*keys, path], "left_anti"), patch, [*keys, path], value)
