"""Exact deduplication by a tree merge of sorted digest runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labspark.llm.common import keep_rows, stored, text_of, unused

#: Runs that meet in one merge: 2 ** FAN_BITS.
FAN_BITS = 3
CLASS = ("digest", "check", "bytes")


def digest_runs(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """One sorted run of digests for each partition of ``docs``, stored in the shared folder.

    Columns: ``id``, ``row`` (tells repeated rows apart), ``run`` and the class of the text, which is its SHA-256 digest
    with its length and a second, unlike hash.
    """
    text = text_of(text_column)
    rows = docs.select(
        F.col(id_column).alias("id"),
        F.monotonically_increasing_id().alias("row"),
        F.spark_partition_id().alias("run"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
        F.xxhash64(text).alias("check"),
        F.octet_length(text).alias("bytes"),
    )
    return stored(rows.sortWithinPartitions(*CLASS), "digest-runs")


def preferred(keep: str) -> Column:
    """The best entry of a group of merged entries."""
    return (F.max if keep == "largest" else F.min)("best").alias("best")


def merged(runs: DataFrame, keep: str, run: Column) -> DataFrame:
    """Runs that share ``run`` merged to one: a row for each class, with its best identifier and its number of rows.

    Entries merge only when digest, second hash and length agree, at this level as at every other.
    """
    renamed = runs.withColumn("run", run)
    return renamed.groupBy("run", *CLASS).agg(preferred(keep), F.sum("rows").alias("rows"))


def exact_classes(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", keep: str = "smallest") -> DataFrame:
    """For each row of ``docs``: ``id``, ``digest``, ``keep_id``, ``group_size`` and ``kept``.

    Texts are equal when their bytes are; a null text is empty. Of each class the row with the ``smallest`` or
    ``largest`` identifier stays. A null identifier comes after all others. Of repeated rows, one stays. An empty table
    gives no rows.

    Every partition makes one sorted run. Runs merge in rounds, 2 ** FAN_BITS at a time, so a class never has more
    entries in a merge than runs that meet there, however many copies the documents hold. The root is not one task: each
    merge is dealt out by class. On the way back the winners are joined to the runs of the first level, one row for each
    class and run, and from there to the rows of that run alone.
    """
    rows = digest_runs(docs, id_column, text_column)
    # Nulls first for the largest, last for the smallest.
    rank = F.col("id").isNull() if keep == "smallest" else F.col("id").isNotNull()
    entry = F.struct(rank.alias("rank"), F.col("id"), F.col("row"))
    leaves = rows.groupBy("run", *CLASS).agg(
        (F.max if keep == "largest" else F.min)(entry).alias("best"), F.count(F.lit(1)).alias("rows")
    )
    level, width = leaves, 1 + (rows.agg(F.max("run")).first()[0] or 0)
    while width > 1:
        level = merged(level, keep, F.shiftright("run", FAN_BITS))
        width = -(-width // (1 << FAN_BITS))
    winners = level.select(*CLASS, "best", F.col("rows").alias("group_size"))
    # Down again: to the runs, then to the rows of each run.
    of_runs = leaves.select("run", *CLASS).join(winners, list(CLASS))
    found = rows.join(of_runs, ["run", *CLASS])
    return found.select(
        "id",
        "digest",
        F.col("best.id").alias("keep_id"),
        F.col("group_size").cast("bigint").alias("group_size"),
        (F.col("row") == F.col("best.row")).alias("kept"),
    )


def drop_exact_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", keep: str = "smallest") -> DataFrame:
    """The rows of ``docs`` that stay, with their columns."""
    classes = exact_classes(docs, id_column, text_column, keep)
    # Rows that share an identifier with a kept one, but not its text, must not come back with it.
    same = F.struct(F.col("id"), F.col("digest"))
    kept = classes.groupBy(same.alias("key")).agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("copies"))
    own = unused("_class", docs)
    marked = docs.withColumn(
        own, F.struct(F.col(id_column).alias("id"), F.unhex(F.sha2(text_of(text_column), 256)).alias("digest"))
    )
    return keep_rows(marked, kept.where("kept").select("key", "copies"), own).drop(own)
