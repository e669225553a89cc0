from __future__ import annotations

from types import SimpleNamespace

import pytest

from labspark.session import scratch_path, shared_dir


def fake(checkpoint, master):
    conf = SimpleNamespace(get=lambda key, default=None: checkpoint or default)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, applicationId=f"app-{master}"))


def test_the_shared_folder_is_the_one_the_cluster_names():
    assert shared_dir(fake("hdfs:///shared/", "yarn")) == "hdfs:///shared"
    assert shared_dir(fake("/data/x", "local[2]")) == "/data/x"


def test_only_a_local_master_may_use_a_temporary_folder():
    local = fake(None, "local[2]")
    assert shared_dir(local) == shared_dir(local)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(fake(None, "yarn"))


def test_scratch_paths_are_never_the_same(spark):
    assert scratch_path(spark, "a") != scratch_path(spark, "a")
