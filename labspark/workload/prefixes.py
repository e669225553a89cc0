"""Prefix frequency over the ``documents`` texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labspark.operators.prefix import distinct_total, prefix_frequency
from labspark.workload.registry import query, table

FREQUENCIES = "SELECT substring(text, 1, 3) AS prefix, count(*) AS frequency FROM documents WHERE text IS NOT NULL GROUP BY 1"


def key_values(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("text").alias("value"))


@query("prefix_frequency", FREQUENCIES)
def frequencies(spark: SparkSession, sf: str) -> DataFrame:
    return prefix_frequency(key_values(spark, sf))


@query(
    "prefix_distinct_total",
    f"SELECT count(*) AS n_prefixes, coalesce(sum(frequency), 0)::bigint AS n_rows FROM ({FREQUENCIES})",
)
def distinct(spark: SparkSession, sf: str) -> DataFrame:
    return distinct_total(prefix_frequency(key_values(spark, sf)))
