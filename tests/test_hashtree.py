"""Hash trees: diffs equal those of whole lists, and what did not change is not read."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from labspark.operators import hashtree as H
from labspark.operators.manifest import changed_since

SCHEMA = "dir string, path string, hash string"


def state(seed=4, n=300):
    draw = random.Random(seed)
    return {(draw.choice(["big", "big", "a", None]), f"p{i}"): draw.choice([None, "", f"h{i}"]) for i in range(n)}


def frame(spark, files):
    return spark.createDataFrame([(d, p, h) for (d, p), h in files.items()], SCHEMA)


def write(spark, files, folder, digits=3):
    H.write_tree(frame(spark, files), folder, "dir", "path", digits=digits)
    return folder


def later(files):
    """Files changed, gone and new, among them a changed null, a directory of its own and one that goes."""
    new = dict(files)
    for i, name in enumerate(sorted(files, key=str)):
        if i % 40 == 3:
            new[name] = "other"
        elif i % 40 == 11:
            del new[name]
        elif i % 40 == 17:
            new[(name[0], name[1] + "+")] = None
    new[("fresh", "q")] = "h"
    return new


@pytest.mark.parametrize("digits", [2, 3])
def test_diff_equals_that_of_whole_lists(spark, tmp_path, digits):
    old, new = state(), later(state())
    folders = write(spark, old, str(tmp_path / "old"), digits), write(spark, new, str(tmp_path / "new"), digits)
    found = {(r["directory"], r["path"]): (r["change"], r["old_hash"], r["new_hash"]) for r in H.tree_diff(spark, *folders, digits).collect()}
    want = {}
    for name in set(old) | set(new):
        if name not in old:
            want[name] = ("added", None, new[name])
        elif name not in new:
            want[name] = ("removed", old[name], None)
        elif old[name] != new[name]:
            want[name] = ("changed", old[name], new[name])
    assert found == want
    assert H.tree_diff(spark, folders[0], folders[0], digits).collect() == []


def test_uploads_are_those_of_the_incremental_diff(spark, tmp_path):
    """For files with content the changed and new paths are what the row by row comparison uploads."""
    old = {name: h or "x" for name, h in state().items()}
    new = {name: h or "y" for name, h in later(old).items()}
    found = H.tree_diff(spark, write(spark, old, str(tmp_path / "old")), write(spark, new, str(tmp_path / "new")))
    uploads = changed_since(frame(spark, new).withColumnRenamed("path", "target"), frame(spark, old).withColumnRenamed("path", "target"))
    want = {r["target"] for r in uploads.where(F.col("action") == "upload").collect()}
    assert {r["path"] for r in found.where("change <> 'removed'").collect()} == want


def test_unchanged_files_are_not_read(spark, tmp_path):
    old = state(n=2000)
    new = {**old, ("big", "one more"): "h"}
    folders = write(spark, old, str(tmp_path / "old")), write(spark, new, str(tmp_path / "new"))
    leaves = H.changed_leaves(spark, *folders).collect()
    assert len(leaves) == 1
    pruned = H.read_files(spark, folders[1], [leaves[0]["prefix"]])
    # One folder of 16, and of it the rows of one leaf.
    assert {name.rsplit("part=", 1)[1][:1] for name in pruned.select(F.col("_metadata.file_path")).distinct().toPandas()["file_path"]} == {leaves[0]["prefix"][:1]}
    assert pruned.count() <= 5
    plan = pruned._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan and "PushedFilters: [IsNotNull(leaf)" in plan
    assert [r["path"] for r in H.tree_diff(spark, *folders).collect()] == ["one more"]


def test_empty_trees_and_entries_that_run_together(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    H.write_tree(empty, str(tmp_path / "none"), "dir", "path")
    one = write(spark, {("a", "p"): "h"}, str(tmp_path / "one"))
    assert H.tree_diff(spark, str(tmp_path / "none"), str(tmp_path / "none")).collect() == []
    assert [r["change"] for r in H.tree_diff(spark, str(tmp_path / "none"), one).collect()] == ["added"]
    assert [r["change"] for r in H.tree_diff(spark, one, str(tmp_path / "none")).collect()] == ["removed"]
    texts = [("p", "q"), ("pq", ""), ("p", None), ("", "pq")]
    digests = [
        H.leaf_digests(H.tree_files(spark.createDataFrame([("a", *t)], SCHEMA), "dir", "path").withColumn("leaf", F.lit("0"))).first()["digest"]
        for t in texts
    ]
    assert len(set(digests)) == len(texts)
    with pytest.raises(ValueError):
        H.write_tree(empty, str(tmp_path / "x"), "dir", "path", digits=0)
