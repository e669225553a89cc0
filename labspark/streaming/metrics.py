"""Metric streams: ingest, gauges on a time grid and counter increases."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from labspark.operators.metrics import RATE_ROWS, counter_increase, step_start
from labspark.plans.topn import first_n
from labspark.streaming.batches import Carried, append, run, store_batch


def sample_stream(
    spark: SparkSession, folder: str, schema: T.StructType, pattern: str = "*.parquet", files_per_batch: int = 1024
) -> DataFrame:
    """Samples as they arrive as files directly in a folder."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    return reader.option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def table_stream(spark: SparkSession, path: str, files_per_batch: int = 1024) -> DataFrame:
    """The rows of a stored table as a stream, whether the table is one file or a folder of part files.

    A table that does not exist is an error: a stream over it would wait, or end, without a row.
    """
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    status = at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at)
    schema = spark.read.parquet(path).schema
    if status.isDirectory():
        return sample_stream(spark, path, schema, "*", files_per_batch)
    return sample_stream(spark, at.getParent().toString(), schema, at.getName(), files_per_batch)


def ingest(
    stream: DataFrame, out: str, checkpoint: str, every: str | None = None, partition_by: Sequence[str] = ()
) -> StreamingQuery:
    """Store the samples as they are, for instance in folders by day."""
    return append(stream, out, checkpoint, every, partition_by)


def gauge_steps(
    stream: DataFrame,
    series: Sequence[str],
    step: timedelta,
    late: timedelta,
    ts: str = "ts",
    value: str = "value",
    tie: str | None = None,
) -> DataFrame:
    """The last sample per series and step, with Spark's own window state.

    Samples later than ``late`` behind the newest one are dropped. Start it in update mode: a step is emitted whenever
    it has changed.
    """
    order = F.struct("_ts", tie) if tie else F.col("_ts")
    timed = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark(
        "_ts", f"{int(late.total_seconds())} seconds"
    )
    steps = timed.groupBy(*series, F.window("_ts", f"{int(step.total_seconds())} seconds").alias("_window"))
    return steps.agg(F.max_by(value, order).alias(value)).select(
        *series, F.col("_window.start").alias("step"), value
    )


def run_gauge_steps(steps: DataFrame, out: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return (
        steps.writeStream.outputMode("update")
        .foreachBatch(lambda batch, batch_id: store_batch(batch, out, batch_id))
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


def counter_batch(
    batch: DataFrame,
    last: DataFrame,
    series: Sequence[str],
    ts: str,
    value: str,
    tie: str,
    target_rows: int = RATE_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """Increases of one batch, and the last sample of each series after it.

    ``last`` holds the last sample per series from before. Samples that are not newer than it are late and dropped.
    """
    columns = [*series, ts, value, tie]
    known = last.select(
        *[F.col(k).alias(f"_last_{i}") for i, k in enumerate(series)],
        F.col(ts).alias("_last_ts"),
        F.col(value).alias("_last_value"),
    )
    same = F.lit(True)
    for i, key in enumerate(series):
        same = same & F.col(key).eqNullSafe(F.col(f"_last_{i}"))
    fresh = batch.select(*columns).join(known, same, "left")
    fresh = fresh.where(F.col("_last_ts").isNull() | (F.col(ts) > F.col("_last_ts"))).select(*columns, "_last_value")
    increases = counter_increase(fresh, series, ts, value, tie, target_rows, "_last_value").drop("_last_value")
    both = fresh.select(*columns).unionByName(last.select(*columns))
    return increases, first_n(both, list(series), [F.desc(ts), F.desc(tie)], 1)


def run_counter_increase(
    stream: DataFrame,
    series: Sequence[str],
    out: str,
    state: str,
    checkpoint: str,
    ts: str = "ts",
    value: str = "value",
    tie: str = "sample_id",
    every: str | None = None,
    target_rows: int = RATE_ROWS,
) -> StreamingQuery:
    """Store the increase of every sample; the last sample per series is carried between batches.

    The batch operator does the work, so a hot series is cut inside a batch as it is in a batch job.
    """
    columns = [*series, ts, value, tie]
    carried = Carried(state, T.StructType([stream.schema[c] for c in columns]))

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select(*columns).persist()
        try:
            last = carried.before(batch.sparkSession, batch_id)
            increases, newest = counter_batch(rows, last, series, ts, value, tie, target_rows)
            store_batch(increases, out, batch_id)
            carried.after(newest, batch_id)
        finally:
            rows.unpersist()

    return run(stream, on_batch, checkpoint, every)


def step_rates(increases: DataFrame, series: Sequence[str], step: timedelta, ts: str = "ts") -> DataFrame:
    """Increase per second in each time step, from stored increases."""
    total = increases.withColumn("step", step_start(ts, step)).groupBy(*series, "step").agg(F.sum("increase").alias("_sum"))
    return total.select(*series, "step", (F.col("_sum") / F.lit(step.total_seconds())).alias("rate"))
