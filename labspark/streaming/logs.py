"""The live log stream: tail, parse, enrich, store."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from labspark.operators.logs import enrich, parse_json
from labspark.sources.commits import numbers, publish
from labspark.streaming.batches import append, run, store_batch

BATCH_INTERVAL = "10 seconds"


def log_records(
    lines: DataFrame, schema: T.StructType, attributes: Mapping[str, Column | str], host: Column | None = None
) -> DataFrame:
    """Parsed and labelled lines; the same steps serve a batch of files and a stream."""
    return enrich(parse_json(lines, schema), attributes, host)


def run_logs(
    records: DataFrame,
    out: str,
    checkpoint: str,
    every: str | None = BATCH_INTERVAL,
    partition_by: Sequence[str] = (),
) -> StreamingQuery:
    """Store the records; ``partition_by`` can name the column of the daily index."""
    return append(records, out, checkpoint, every, partition_by)


def run_fan_out(
    stream: DataFrame, sinks: Mapping[str, tuple[Column, str]], checkpoint: str, commits: str, every: str | None = None
) -> StreamingQuery:
    """Write one stream to several tables: name to (which rows, where).

    The batch is read once and each table gets its rows in a folder of the batch. When all have theirs, the batch is named in
    the commit log ``commits``; until then ``committed_batches`` shows none of it. A batch that runs again replaces what it
    left half done, and leaves alone what is committed.
    """

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if batch_id in numbers(spark, commits):
            return
        rows = batch.persist()
        try:
            for keep, path in sinks.values():
                store_batch(rows.where(keep), path, batch_id)
            publish(spark, commits, batch_id, {name: f"{path}/batch={batch_id}" for name, (_, path) in sinks.items()})
        finally:
            rows.unpersist()

    return run(stream, on_batch, checkpoint, every)


def committed_batches(spark: SparkSession, path: str, schema: T.StructType, commits: str) -> DataFrame:
    """The rows of one table of a fan-out, of the batches that all its tables have."""
    folders = [f"{path}/batch={n}" for n in numbers(spark, commits)]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)
