"""Session defaults and the shared folder that sinks, state and tests write to."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}

_local_dirs: dict[str, str] = {}


SHUFFLE_PARTITION_BYTES = 128 << 20


def session(
    app: str = "labspark", master: str | None = None, shuffle_bytes: int | None = None, **conf: str
) -> SparkSession:
    """A session with the defaults above; keyword names use ``__`` for dots.

    ``shuffle_bytes``, the size of the largest shuffle to expect, sets the number of shuffle partitions so that one fits
    well into a task's memory. Spark joins partitions that turn out small.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    if shuffle_bytes is not None:
        partitions = max(200, -(-shuffle_bytes // SHUFFLE_PARTITION_BYTES))
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, named by ``spark.checkpoint.dir``.

    Only a local master, where driver and executors share one machine, may fall back to a temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return _local_dirs.setdefault(context.applicationId, tempfile.mkdtemp(prefix="labspark-"))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder. What is written there goes when the driver ends."""
    folder = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


def visible_to_workers(spark: SparkSession) -> None:
    """Let Python workers that see the driver's folders import this package.

    Workers on other machines get it as Spark distributes it, by ``--py-files`` or their own installation.
    """
    environment = spark.sparkContext.environment
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = environment.get("PYTHONPATH", "")
    if root not in path.split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, (root, path)))
