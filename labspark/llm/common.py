"""What several operators here share."""

from __future__ import annotations

import functools
import os
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import labspark
from labspark.session import scratch_path

#: The tokenizer of the queries here.
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


#: Bytes of texts that a Python worker gets at once, at most, unless one text alone has more.
BATCH_BYTES = 8 << 20


def importable(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """``fn`` of a session, with this package on the path of Python workers that see the driver's folders.

    Workers on other machines get it as Spark distributes it, by ``--py-files`` or their own installation. The session's
    Arrow batches are limited to ``BATCH_BYTES``, as batches of some thousand long texts would fill a worker's memory.
    """

    @functools.wraps(fn)
    def wrapped(spark: SparkSession, *rest) -> DataFrame:
        environment = spark.sparkContext.environment
        root = os.path.dirname(os.path.dirname(os.path.abspath(labspark.__file__)))
        path = environment.get("PYTHONPATH", "")
        if root not in path.split(os.pathsep):
            environment["PYTHONPATH"] = os.pathsep.join(filter(None, (root, path)))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
        return fn(spark, *rest)

    return wrapped


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def text_of(column: str) -> Column:
    """A text; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written once to the shared folder and read back: later reads survive lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(name: str, *tables: DataFrame) -> str:
    """``name``, or a longer one, that no column of the tables has, in any case."""
    taken = {column.lower() for table in tables for column in table.columns}
    while name.lower() in taken:
        name += "_"
    return name


def keep_rows(docs: DataFrame, kept: DataFrame, key: str) -> DataFrame:
    """The rows of ``docs`` whose ``key`` is in ``kept``, one row for each key.

    ``kept`` has one row per key: the key and how many rows of ``docs`` have it. Rows of a repeated key go through a distinct
    on the key; all others only through the join. ``kept`` is stored first, so that what made it is planned and run once.
    """
    of, copies = (unused(name, docs) for name in ("_key", "_copies"))
    chosen = stored(kept.toDF(of, copies), "kept")
    joined = docs.join(chosen, F.col(key).eqNullSafe(F.col(of)), "inner")
    several = F.col(copies) > 1
    if not chosen.where(several).isEmpty():
        joined = joined.where(F.col(copies) == 1).unionByName(joined.where(several).dropDuplicates([of]))
    return joined.select(*docs.columns)
