"""What every stream needs: per-batch output that a retry replaces, and rows carried between batches."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from labspark.plans.topn import first_n

BatchFunction = Callable[[DataFrame, int], None]


def run(stream: DataFrame, on_batch: BatchFunction, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Start the stream: one batch per interval, or, without one, everything there is and then stop.

    With the checkpoint kept, each record is delivered once over any number of runs.
    """
    writer = stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return writer.trigger(**trigger).start()


def append(
    stream: DataFrame, path: str, checkpoint: str, every: str | None = None, partition_by: Sequence[str] = ()
) -> StreamingQuery:
    """Store the rows as they are with Spark's own file sink, which keeps a log of the finished batches."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return writer.partitionBy(*partition_by).trigger(**trigger).start()


def appended(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of finished batches."""
    return spark.read.schema(schema).parquet(path)


def store_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Write the rows of one batch to its own folder; a batch that is run again replaces its rows."""
    df.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def stored(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All stored batches with their ``batch`` number; no rows before the first one."""
    full = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
    try:
        return spark.read.schema(full).parquet(path)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], full)


def newest_update(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of rows that were emitted again and again as they grew, the last per key."""
    return first_n(rows, keys, [F.desc("batch")], 1).drop("batch")


class Carried:
    """Rows handed from each batch to the next, as tables in the shared folder.

    Batch n reads what batch n - 1 wrote and writes a table of its own, so running it again reads the same rows. Three
    tables are used in turn.
    """

    def __init__(self, path: str, schema: T.StructType) -> None:
        self.path = path
        self.schema = schema

    def _slot(self, batch_id: int) -> str:
        return f"{self.path}/slot={batch_id % 3}"

    def before(self, spark: SparkSession, batch_id: int) -> DataFrame:
        if batch_id == 0:
            return spark.createDataFrame([], self.schema)
        return spark.read.schema(self.schema).parquet(self._slot(batch_id - 1))

    def after(self, df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(self._slot(batch_id))
