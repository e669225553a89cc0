"""File manifests: content hashes, change detection, directory totals and digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The targets that a backup always checks.
BACKUP_TARGETS = (
    "KUBECONFIG",
    "K8S_MANIFESTS",
    "CASSANDRA_PATCH",
    "CASSANDRA_CONFIG",
    "CASSANDRA_VERSIONS",
    "ENVIRONMENT_SCRIPT",
    "SETUP_INSTANCE_SCRIPT",
)

BUCKET_DIGITS = 3


def content_hash(content: Column) -> Column:
    """SHA-256 of the content in lower-case hex; null when there is no content."""
    return F.sha2(content.cast("binary"), 256)


def relative_path(path: Column, prefix: str) -> Column:
    """The path below ``prefix``; null for paths that are not below it."""
    root = prefix.rstrip("/") + "/"
    below = F.substring(path, F.lit(len(root) + 1), F.length(path))
    return F.when(path.startswith(root) & (path != root), below)


def changed_since(current: DataFrame, stored: DataFrame, key: str = "target", hashed: str = "hash") -> DataFrame:
    """Add ``action``: ``absent`` without a current hash, ``skip`` when equal to the stored hash, else ``upload``."""
    known = stored.select(key, F.col(hashed).alias("_stored"))
    action = (
        F.when(F.col(hashed).isNull(), "absent")
        .when(F.col(hashed).eqNullSafe(F.col("_stored")), "skip")
        .otherwise("upload")
    )
    return current.join(known, key, "left").select(*current.columns, action.alias("action"))


def all_targets(current: DataFrame, targets: DataFrame, key: str = "target") -> DataFrame:
    """A row for each of ``targets``: those without a row of ``current`` have nulls, and so are absent."""
    return targets.select(key).distinct().join(current, key, "left")


def updated_hashes(changes: DataFrame, key: str = "target", hashed: str = "hash") -> DataFrame:
    """The hashes to store: those of uploaded rows."""
    return changes.where(F.col("action") == "upload").select(key, hashed)


def backup_summary(changes: DataFrame, *by: str) -> DataFrame:
    """Counts of checked, uploaded and skipped targets; absent targets count as checked.

    Targets without any row are added beforehand, by ``all_targets``.
    """
    return changes.groupBy(*by).agg(
        F.count(F.lit(1)).alias("checked"),
        F.count_if(F.col("action") == "upload").alias("uploaded"),
        F.count_if(F.col("action") == "skip").alias("skipped"),
    )


def directory_totals(df: DataFrame, directory: str, size: str) -> DataFrame:
    return df.groupBy(directory).agg(
        F.count(F.lit(1)).alias("n_files"), F.coalesce(F.sum(size), F.lit(0)).alias("n_bytes")
    )


def directory_digest(df: DataFrame, directory: str, path: str, hashed: str = "hash") -> DataFrame:
    """One digest per directory of any size, and its number of files.

    Files fall into 4096 buckets by the first three hex digits of the SHA-256 of their path. A bucket's digest is SHA-256
    over path and hash of its files in path order; the directory's is SHA-256 over name and digest of its buckets in
    order. Any change of a path or a hash changes it.
    """
    bucket = F.substring(F.sha2(F.col(path), 256), 1, BUCKET_DIGITS)
    parts = df.withColumn("_bucket", bucket).groupBy(directory, "_bucket").agg(
        F.sha2(_entries(path, hashed), 256).alias("_digest"), F.count(F.lit(1)).alias("_files")
    )
    of_buckets = F.expr("listagg(concat(_bucket, _digest), '') WITHIN GROUP (ORDER BY _bucket)")
    return parts.groupBy(directory).agg(F.sha2(of_buckets, 256).alias("digest"), F.sum("_files").alias("n_files"))


def small_directory_digest(df: DataFrame, directory: str, path: str, hashed: str = "hash") -> DataFrame:
    """SHA-256 over path and hash of a directory's files in path order, without separators.

    The text to digest is formed in one task: for directories known to be small, such as a cluster's manifests.
    """
    return df.groupBy(directory).agg(
        F.sha2(_entries(path, hashed), 256).alias("digest"), F.count(F.lit(1)).alias("n_files")
    )


def _entries(path: str, hashed: str) -> Column:
    return F.expr(f"listagg(concat(`{path}`, coalesce(`{hashed}`, '')), '') WITHIN GROUP (ORDER BY `{path}`)")
