"""Prefix frequency over a key-value table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def prefix_frequency(df: DataFrame, value: str = "value", length: int = 3) -> DataFrame:
    """Count rows by the first ``length`` characters of ``value``; null values are left out."""
    return (
        df.where(F.col(value).isNotNull())
        .groupBy(F.substring(F.col(value), 1, length).alias("prefix"))
        .agg(F.count(F.lit(1)).alias("frequency"))
    )


def distinct_total(frequencies: DataFrame) -> DataFrame:
    """How many prefixes were found and how many rows they cover."""
    return frequencies.agg(
        F.count(F.lit(1)).alias("n_prefixes"), F.coalesce(F.sum("frequency"), F.lit(0)).alias("n_rows")
    )
