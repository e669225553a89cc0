"""Tables: connector scans, reload, column defaults, daily indexes and keyed documents."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labspark.operators.logs import daily_index, newest_document


def scan(spark: SparkSession, source: str, path: str | None = None, **options: str) -> DataFrame:
    """Read through any connector Spark knows by name, such as one with keyspace and table options."""
    return spark.read.format(source).options(**options).load(path)


def reload(df: DataFrame, path: str | None, source: str = "parquet", **options: str) -> DataFrame:
    """Replace what the table holds with these rows, then read the stored rows back.

    Whoever counts or reuses the result reads the stored rows and does not run the query again. Files are read with the
    schema just written, other connectors with the one they report.
    """
    df.write.format(source).options(**options).mode("overwrite").save(path)
    reader = df.sparkSession.read.format(source).options(**options)
    return reader.schema(df.schema).load(path) if path else reader.load()


def fill_defaults(df: DataFrame, defaults: Mapping[str, Column]) -> DataFrame:
    """Give absent or null columns their default, in the order listed; a default may use columns filled before it."""
    for name, default in defaults.items():
        given = F.col(name) if name in df.columns else F.lit(None)
        df = df.withColumn(name, F.coalesce(given, default))
    return df


def write_daily_index(df: DataFrame, path: str, ts: str = "ts", prefix: str = "logs-otel-") -> None:
    """Append rows to one folder per day.

    Rows are gathered by day to avoid many small files; a day that is too large for one task is spread by Spark.
    """
    indexed = df.withColumn("index", daily_index(F.col(ts), prefix))
    indexed.hint("rebalance", "index").write.partitionBy("index").mode("append").parquet(path)


def read_daily_index(
    spark: SparkSession, path: str, index: str | None = None, since: str | None = None
) -> DataFrame:
    """The stored rows, of one index or of all from ``since`` on; other folders are not read."""
    rows = spark.read.parquet(path)
    if index is not None:
        rows = rows.where(F.col("index") == index)
    return rows if since is None else rows.where(F.col("index") >= since)


def expire_daily_index(spark: SparkSession, path: str, since: str) -> int:
    """Delete the folders of indexes before ``since``; how many went. Readers see whole indexes only, before and after."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = root.getFileSystem(spark._jsc.hadoopConfiguration())
    folders = [status.getPath() for status in store.listStatus(root) if status.isDirectory()]
    old = [folder for folder in folders if folder.getName().startswith("index=") and folder.getName() < f"index={since}"]
    return sum(store.delete(folder, True) for folder in old)


def put_documents(stored: DataFrame, new: DataFrame, key: Sequence[str], at: str, tie: str) -> DataFrame:
    """Stored and new documents with one row per key, the last written."""
    return newest_document(stored.unionByName(new), key, at, tie)


def get_document(df: DataFrame, key: str, value: object) -> DataFrame:
    return df.where(F.col(key) == F.lit(value))
