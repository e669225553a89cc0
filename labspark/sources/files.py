"""Files: log lines with their origin, folder listings and step logs."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labspark.operators.manifest import relative_path
from labspark.plans.topn import first_n

FILE_SYSTEM = "^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?/"
STEP_LOG = r"([^/]+)/steps/([^/]+)/(stdout|stderr)\.gz$"


def _with_origin(lines: DataFrame) -> DataFrame:
    return lines.select(
        F.col("value").alias("body"),
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_name").alias("file_name"),
        F.col("_metadata.file_modification_time").alias("file_time"),
    )


def log_lines(spark: SparkSession, folder: str, pattern: str = "*.log") -> DataFrame:
    """Lines of all matching files, each with the path, name and time of its file."""
    return _with_origin(spark.read.option("pathGlobFilter", pattern).text(folder))


def log_stream(
    spark: SparkSession,
    folder: str,
    pattern: str = "*.log",
    since: datetime | None = None,
    files_per_batch: int = 1024,
) -> DataFrame:
    """The same as a stream. ``since`` leaves out files last written before the stream was started."""
    lines = (
        spark.readStream.option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch).text(folder)
    )
    tagged = _with_origin(lines)
    return tagged if since is None else tagged.where(F.col("file_time") >= F.lit(since))


def manifest(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """All files below a folder: path, relative path, size and time. File contents are not read."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    ).load(folder)
    root = folder.rstrip("/")
    # Listed paths carry the file system's name; drop it when the folder was given without one.
    path = F.regexp_replace("path", FILE_SYSTEM, "/") if root.startswith("/") else F.col("path")
    return files.select(
        "path",
        relative_path(path, root).alias("relative_path"),
        F.col("length").alias("size"),
        F.col("modificationTime").alias("modified"),
    ).where(F.col("relative_path").isNotNull())


def plain_path(path: Column) -> Column:
    """A listed path without its URI encoding; a plus sign stays."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def step_logs(
    spark: SparkSession, folder: str, layout: str = STEP_LOG, logs: Sequence[str] = ("stdout", "stderr")
) -> DataFrame:
    """Lines of gzipped step logs below a folder with cluster, step and log name taken from the path.

    Only files of the ``logs`` named are read: the condition is on the path alone, so Spark leaves other files out before
    it opens them. A file that vanishes while the job runs is skipped. Spark reads a gzipped file in one task and in order,
    so ``line_order`` rises with the lines of a file.
    """
    reader = spark.read.option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true")
    listed = plain_path(F.col("_metadata.file_path"))
    wanted = F.regexp_extract(listed, layout, 3).isin(*logs)
    lines = reader.option("pathGlobFilter", "*.gz").text(folder).where(wanted).select(
        F.col("value").alias("line"),
        listed.alias("_path"),
        F.monotonically_increasing_id().alias("line_order"),
    )
    parts = [F.regexp_extract("_path", layout, i) for i in (1, 2, 3)]
    return lines.select(parts[0].alias("cluster_id"), parts[1].alias("step_id"), parts[2].alias("log"), "line_order", "line")


def step_log_tail(logs: DataFrame, n: int = 100, log: str = "stderr") -> DataFrame:
    """The last ``n`` lines of each step's log."""
    return first_n(logs.where(F.col("log") == log), ["cluster_id", "step_id", "log"], [F.desc("line_order")], n, spread="line_order")
