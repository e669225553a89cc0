"""Hash trees over directories: what changed between two stored states, without reading what did not.

A directory's files fall into leaves by the first hex digits of the SHA-256 of their path. A leaf's digest is SHA-256 over path
and hash of its files in path order, that of a branch over name and digest of its children, one more digit each. Two trees are
compared from the roots: only below unequal branches the next level is looked at, and only files of unequal leaves are read.

A stored tree has a folder for each level and one for the files, by the first digit of their leaf and in the order of leaves, so
that a scan skips the others.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labspark.plans.hotgroups import sized

DIGITS = 3
PART_DIGITS = 1

FILES = "directory string, path string, hash string, leaf string, part string"
NODES = "directory string, prefix string, digest string, n_files bigint"


def tree_files(df: DataFrame, directory: str, path: str, hashed: str = "hash", digits: int = DIGITS) -> DataFrame:
    """Files with the leaf of their directory that they fall into. A null hash stands for a file without content."""
    leaf = F.substring(F.sha2(F.col(path), 256), 1, digits)
    files = df.select(
        F.col(directory).cast("string").alias("directory"), F.col(path).alias("path"), F.col(hashed).alias("hash"), leaf.alias("leaf")
    )
    return files.withColumn("part", F.substring("leaf", 1, PART_DIGITS))


def _text(name: str) -> Column:
    """A text that can't run into the next one: its length comes first; null differs from empty."""
    return F.coalesce(F.concat(F.length(name).cast("string"), F.lit(":"), F.col(name)), F.lit("-"))


def leaf_digests(files: DataFrame) -> DataFrame:
    """The lowest level: a digest for each leaf that has files."""
    entries = files.select("directory", "leaf", "path", F.concat(_text("path"), _text("hash")).alias("_entry"))
    joined = F.expr("listagg(_entry, '') WITHIN GROUP (ORDER BY _entry)")
    return entries.groupBy("directory", F.col("leaf").alias("prefix")).agg(
        F.sha2(joined, 256).alias("digest"), F.count(F.lit(1)).alias("n_files")
    )


def parent_digests(nodes: DataFrame) -> DataFrame:
    """The level above: at most sixteen children to a branch."""
    joined = F.expr("listagg(concat(prefix, digest), '') WITHIN GROUP (ORDER BY prefix)")
    above = F.expr("substring(prefix, 1, length(prefix) - 1)")
    return nodes.groupBy("directory", above.alias("_above")).agg(
        F.sha2(joined, 256).alias("digest"), F.sum("n_files").alias("n_files")
    ).withColumnRenamed("_above", "prefix").select("directory", "prefix", "digest", "n_files")


def write_tree(df: DataFrame, folder: str, directory: str, path: str, hashed: str = "hash", digits: int = DIGITS) -> None:
    """Store files and all levels. Each level is made from the stored one below it, so the files are read once for it.

    Files are dealt by ranges of leaf, so a directory with most of the files is many tasks' work, and each stored file
    holds a range of leaves. ``folder`` must be new.
    """
    if digits < PART_DIGITS:
        raise ValueError("a leaf has at least a digit")
    spark = df.sparkSession
    files = tree_files(df, directory, path, hashed, digits)
    dealt = files.repartitionByRange("leaf", "directory", "path").sortWithinPartitions("part", "leaf", "directory")
    dealt.write.partitionBy("part").parquet(f"{folder}/files")
    level = leaf_digests(read_files(spark, folder))
    for depth in range(digits, -1, -1):
        level.sortWithinPartitions("prefix", "directory").write.parquet(f"{folder}/level={depth}")
        level = parent_digests(read_level(spark, folder, depth))


def read_files(spark: SparkSession, folder: str, leaves: Sequence[str] | None = None) -> DataFrame:
    """A tree's files, or those of the ``leaves`` alone: folders of other parts are not read, other leaves skipped by the scan."""
    files = spark.read.schema(FILES).parquet(f"{folder}/files")
    if leaves is None:
        return files
    parts = sorted({leaf[:PART_DIGITS] for leaf in leaves})
    return files.where(F.col("part").isin(parts) & F.col("leaf").isin(list(leaves)))


def read_level(spark: SparkSession, folder: str, depth: int) -> DataFrame:
    return spark.read.schema(NODES).parquet(f"{folder}/level={depth}")


def _unequal(old: DataFrame, new: DataFrame) -> DataFrame:
    """Nodes of two levels that differ or that only one side has; one row for each."""
    same = F.col("old.directory").eqNullSafe(F.col("new.directory")) & (F.col("old.prefix") == F.col("new.prefix"))
    both = old.select("directory", "prefix", "digest").alias("old").join(new.select("directory", "prefix", "digest").alias("new"), same, "full")
    changed = both.where(~F.col("old.digest").eqNullSafe(F.col("new.digest")))
    # A side that has no such node has a null digest, which no node has.
    here = F.col("new.digest").isNotNull()
    return changed.select(
        F.when(here, F.col("new.directory")).otherwise(F.col("old.directory")).alias("directory"),
        F.when(here, F.col("new.prefix")).otherwise(F.col("old.prefix")).alias("prefix"),
    )


def _below(nodes: DataFrame, branches: DataFrame) -> DataFrame:
    """The children of the branches."""
    named = branches.select(F.col("directory").alias("_directory"), F.col("prefix").alias("_prefix"))
    above = F.expr("substring(prefix, 1, length(prefix) - 1)")
    return nodes.join(named, nodes["directory"].eqNullSafe(F.col("_directory")) & (above == F.col("_prefix")), "left_semi")


def changed_leaves(spark: SparkSession, old: str, new: str, digits: int = DIGITS) -> DataFrame:
    """Directory and prefix of the leaves that differ, by descending from the roots into unequal branches."""
    branches = _unequal(read_level(spark, old, 0), read_level(spark, new, 0))
    for depth in range(1, digits + 1):
        branches = _unequal(_below(read_level(spark, old, depth), branches), _below(read_level(spark, new, depth), branches))
    return branches


def tree_diff(spark: SparkSession, old: str, new: str, digits: int = DIGITS) -> DataFrame:
    """Files that were added, removed or changed: directory, path, ``change``, ``old_hash`` and ``new_hash``.

    A path occurs once in a directory. The prefixes of unequal leaves reach the driver, at most 16 to the power of ``digits``
    whatever the number of directories and files, and prune the scan of the files; a join then keeps the unequal leaves.
    """
    unequal = sized(changed_leaves(spark, old, new, digits))
    prefixes = sorted(row[0] for row in unequal.select("prefix").distinct().collect())
    named = unequal.select(F.col("directory").alias("_directory"), F.col("prefix").alias("_leaf"))
    sides = {side: read_files(spark, folder, prefixes) for side, folder in (("old", old), ("new", new))}
    found = [
        rows.join(named, rows["directory"].eqNullSafe(F.col("_directory")) & (rows["leaf"] == F.col("_leaf")), "left_semi").select(
            "directory", "path", F.lit(side).alias("_side"), "hash"
        )
        for side, rows in sides.items()
    ]
    # Both sides of a file meet by one aggregation: a count tells which sides have it, null hashes included.
    both = found[0].unionByName(found[1]).groupBy("directory", "path").agg(
        *[F.count_if(F.col("_side") == side).alias(f"_in_{side}") for side in ("old", "new")],
        *[F.max(F.when(F.col("_side") == side, F.col("hash"))).alias(f"{side}_hash") for side in ("old", "new")],
    )
    change = (
        F.when(F.col("_in_old") == 0, "added")
        .when(F.col("_in_new") == 0, "removed")
        .when(~F.col("old_hash").eqNullSafe(F.col("new_hash")), "changed")
    )
    return both.withColumn("change", change).where("change IS NOT NULL").select("directory", "path", "change", "old_hash", "new_hash")
