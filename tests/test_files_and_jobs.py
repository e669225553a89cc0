from __future__ import annotations

import gzip
import hashlib
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from labspark.functions import labels as LB
from labspark.functions import status as ST
from labspark.functions import text as TX
from labspark.operators import catalogue as C
from labspark.operators import jobs as J
from labspark.operators import manifest as M
from labspark.sources import files, state, tables

KUBE = "apiVersion: v1\nclusters: []"
PATCH = "cassandra:\n  jvm_options: -Xmx4G"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def summary(spark, current, stored):
    now = spark.createDataFrame(current, "target string, hash string")
    before = spark.createDataFrame(stored, "target string, hash string")
    changes = M.changed_since(now, before)
    row = M.backup_summary(changes).first()
    return (row["checked"], row["uploaded"], row["skipped"]), {r[0]: r[1] for r in M.updated_hashes(changes).collect()}


def test_backup_first_run_unchanged_and_one_changed(spark):
    absent = [(t, None) for t in M.BACKUP_TARGETS if t not in ("KUBECONFIG", "CASSANDRA_PATCH")]
    kube, patch = ("KUBECONFIG", sha(KUBE)), ("CASSANDRA_PATCH", sha(PATCH))
    assert summary(spark, [*absent, kube, patch], []) == ((7, 2, 0), dict([kube, patch]))
    assert summary(spark, [*absent, kube, ("CASSANDRA_PATCH", None)], [kube]) == ((7, 0, 1), {})
    counts, fresh = summary(spark, [*absent, kube, patch], [kube, ("CASSANDRA_PATCH", "old")])
    assert (counts, fresh) == ((7, 1, 1), dict([patch]))


def test_content_hash(spark):
    df = spark.createDataFrame([(KUBE,), (None,)], "content string")
    assert [r[0] for r in df.select(M.content_hash(F.col("content"))).collect()] == [sha(KUBE), None]


def digests(spark, rows, digest=M.directory_digest):
    df = spark.createDataFrame(rows, "dir string, path string, hash string")
    return {r["dir"]: r["digest"] for r in digest(df, "dir", "path").collect()}


def test_small_directory_digest_follows_path_order(spark):
    rows = [("k8s", "b/2.yaml", sha("two")), ("k8s", "a.yaml", sha("one")), ("k8s", "b/1.yaml", None)]
    want = sha("a.yaml" + sha("one") + "b/1.yaml" + "b/2.yaml" + sha("two"))
    assert digests(spark, rows, M.small_directory_digest) == {"k8s": want}
    assert digests(spark, list(reversed(rows)), M.small_directory_digest) == {"k8s": want}


def test_directory_digest_is_one_function_for_every_size(spark):
    def plain(rows):
        buckets = {}
        for _, path, hashed in sorted(rows):
            buckets.setdefault(sha(path)[:3], []).append(path + (hashed or ""))
        return sha("".join(name + sha("".join(files)) for name, files in sorted(buckets.items())))

    big = [("big", f"f{i}", sha(str(i))) for i in range(300)] + [("big", "none", None)]
    small = [("small", "x", sha("x"))]
    found = digests(spark, big + small)
    assert found == {"big": plain(big), "small": plain(small)} == digests(spark, (big + small)[::-1])
    changed = [("big", "f7", sha("other")) if r[1] == "f7" else r for r in big]
    assert digests(spark, changed)["big"] != found["big"]


def test_every_target_is_checked(spark):
    targets = spark.createDataFrame([(t,) for t in M.BACKUP_TARGETS], "target string")
    current = spark.createDataFrame([(M.BACKUP_TARGETS[0], sha("a"))], "target string, hash string")
    none = spark.createDataFrame([], "target string, hash string")
    summary = M.backup_summary(M.changed_since(M.all_targets(current, targets), none)).first()
    assert tuple(summary) == (len(M.BACKUP_TARGETS), 1, 0)


def test_relative_paths_need_the_whole_prefix(spark):
    df = spark.createDataFrame([("k8s/a",), ("k8s-old/a",), ("k8s/",), ("k8s",)], "path string")
    assert [r[0] for r in df.select(M.relative_path(F.col("path"), "k8s")).collect()] == ["a", None, None, None]


def test_manifest_lists_files_below_the_folder(spark, tmp_path):
    (tmp_path / "sub dir").mkdir()
    (tmp_path / "a.txt").write_text("12345")
    (tmp_path / "sub dir" / "b.txt").write_text("1")
    rows = {r["relative_path"]: r["size"] for r in files.manifest(spark, str(tmp_path)).collect()}
    assert rows == {"a.txt": 5, "sub dir/b.txt": 1}


@pytest.mark.parametrize("path", ["file:/a/b", "file:///a/b", "hdfs://node:8020/a/b", "s3a://bucket/a/b", "/a/b"])
def test_file_system_names_are_dropped(spark, path):
    df = spark.createDataFrame([(path,)], "path string")
    assert df.select(F.regexp_replace("path", files.FILE_SYSTEM, "/")).first()[0] == "/a/b"


def test_step_logs_and_their_tail(spark, tmp_path):
    for step, name, n in [("s-1", "stderr", 150), ("s-1", "stdout", 3), ("s-2", "stderr", 2)]:
        folder = tmp_path / "c-1" / "steps" / step
        folder.mkdir(parents=True, exist_ok=True)
        with gzip.open(folder / f"{name}.gz", "wt") as out:
            out.writelines(f"line {i}\n" for i in range(n))
    (tmp_path / "c-1" / "steps" / "s-2" / "notes.txt").write_text("not a log")
    logs = files.step_logs(spark, str(tmp_path))
    counts = {(r["step_id"], r["log"]): r["count"] for r in logs.groupBy("step_id", "log").count().collect()}
    assert counts == {("s-1", "stderr"): 150, ("s-1", "stdout"): 3, ("s-2", "stderr"): 2}
    tail = files.step_log_tail(logs).where("step_id = 's-1'").orderBy("line_order").collect()
    assert [r["line"] for r in tail] == [f"line {i}" for i in range(50, 150)]


def test_log_lines_carry_their_file(spark, tmp_path):
    (tmp_path / "a.log").write_text('{"k": 1}\n{"k": 2}\n')
    (tmp_path / "b.txt").write_text("no\n")
    rows = files.log_lines(spark, str(tmp_path)).collect()
    assert [(r["body"], r["file_name"]) for r in rows] == [('{"k": 1}', "a.log"), ('{"k": 2}', "a.log")]


def test_reload_replaces_and_reruns_equal(spark, tmp_path):
    path = str(tmp_path / "t")
    first = spark.createDataFrame([("a", 1), ("b", 2)], "prefix string, frequency bigint")
    assert tables.reload(first, path).count() == 2
    again = tables.reload(first.where("frequency = 2"), path)
    assert [tuple(r) for r in again.collect()] == [("b", 2)]


def test_defaults_may_use_each_other(spark):
    df = spark.createDataFrame([(1, None), (2, datetime(2020, 1, 2, 3))], "id int, updated_at timestamp")
    filled = tables.fill_defaults(
        df, {"updated_at": F.lit(datetime(2024, 5, 6)), "updated_at_date": F.to_date("updated_at")}
    )
    assert [str(r["updated_at_date"]) for r in filled.orderBy("id").collect()] == ["2024-05-06", "2020-01-02"]


def test_daily_index_and_documents(spark, tmp_path):
    rows = [(1, datetime(2024, 1, 1, 23)), (2, datetime(2024, 1, 2)), (3, datetime(2024, 1, 2, 5))]
    df = spark.createDataFrame(rows, "id int, ts timestamp")
    tables.write_daily_index(df, str(tmp_path))
    day = tables.read_daily_index(spark, str(tmp_path), "logs-otel-2024.01.02")
    assert sorted(r["id"] for r in day.collect()) == [2, 3]
    old = spark.createDataFrame([("d", 1, "old"), ("e", 1, "kept")], "id string, version int, body string")
    new = spark.createDataFrame([("d", 2, "new")], "id string, version int, body string")
    merged = tables.put_documents(old, new, ["id"], "version", "body")
    assert merged.count() == 2
    assert tables.get_document(merged, "id", "d").first()["body"] == "new"


def test_connector_scan(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    assert tables.scan(spark, "csv", str(tmp_path), header="true").columns == ["x", "y"]


@pytest.mark.parametrize(
    ("body", "expected"),
    [
        ('{"name":"a","clusterId":"c","versions":null}', None),
        ('{"name":"a","initConfig":{"cassandraInstances":5,"region":"eu"},"unknownField":{"x":1}}', (5, 0, "r3.2xlarge", 1, "eu")),
    ],
)
def test_state_documents_are_read_leniently(spark, body, expected):
    row = state.parse_state(spark.createDataFrame([(body,)], "body string")).first()
    init = row["initConfig"]
    found = init and (
        init["cassandraInstances"], init["stressInstances"], init["instanceType"], init["controlInstances"], init["region"]
    )
    assert found == expected
    assert (row["infrastructureStatus"], row["hosts"], row["backupHashes"]) == ("UNKNOWN", {}, {})


def test_parts_of_state_documents_have_their_defaults(spark):
    body = '{"emrCluster":{"clusterId":"j"},"openSearchDomain":{"domainName":"d","state":"Active"},"infrastructure":{"vpcId":"v"}}'
    row = state.parse_state(spark.createDataFrame([(body,)], "body string")).first()
    assert (row["emrCluster"]["clusterId"], row["emrCluster"]["state"]) == ("j", "STARTING")
    assert (row["openSearchDomain"]["state"], row["infrastructure"]["subnetIds"]) == ("Active", [])
    bare = state.parse_state(spark.createDataFrame([("{}",)], "body string")).first()
    assert (bare["emrCluster"], bare["openSearchDomain"], bare["infrastructure"]) == (None, None, None)


def test_old_indexes_are_deleted(spark, tmp_path):
    df = spark.createDataFrame([(i, datetime(2024, 1, i)) for i in range(1, 9)], "id int, ts timestamp_ntz")
    tables.write_daily_index(df, str(tmp_path))
    assert tables.expire_daily_index(spark, str(tmp_path), "logs-otel-2024.01.06") == 5
    assert sorted(r["id"] for r in tables.read_daily_index(spark, str(tmp_path)).collect()) == [6, 7, 8]
    assert tables.expire_daily_index(spark, str(tmp_path), "logs-otel-2024.01.06") == 0


def test_step_logs_leave_other_files_unread(spark, tmp_path):
    folder = tmp_path / "j 1+2" / "steps" / "s-1"
    folder.mkdir(parents=True)
    (folder / "stderr.gz").write_bytes(gzip.compress(b"stderr 1\nstderr 2\n"))
    # Reading this one would fail.
    (folder / "stdout.gz").write_bytes(b"not compressed")
    (tmp_path / "other.txt").write_text("no log")
    logs = files.step_logs(spark, str(tmp_path), logs=["stderr"])
    assert {(r["cluster_id"], r["log"], r["line"]) for r in logs.collect()} == {("j 1+2", "stderr", f"stderr {i}") for i in (1, 2)}


def test_state_hosts(spark):
    body = '{"clusterId":"c","hosts":{"Cassandra":[{"alias":"db0","publicIp":"1"},{"alias":"db1","publicIp":"2"}]}}'
    rows = state.state_hosts(state.parse_state(spark.createDataFrame([(body,)], "body string"))).collect()
    assert sorted((r["cluster_id"], r["server_type"], r["alias"], r["instanceId"]) for r in rows) == [
        ("c", "Cassandra", "db0", None),
        ("c", "Cassandra", "db1", None),
    ]


def test_catalogue(spark):
    main = spark.createDataFrame([("4.0", "11")], "version string, java string")
    extra = spark.createDataFrame([("5.0", "17", "u")], "version string, java string, url string")
    joined = C.join_catalogues(main, extra)
    assert [tuple(r) for r in joined.orderBy("origin").collect()] == [("4.0", "11", 0, None), ("5.0", "17", 1, "u")]
    assert C.require_unique(joined, ["version"]) is joined
    with pytest.raises(ValueError, match="duplicate version: 4.0"):
        C.require_unique(C.join_catalogues(main, main), ["version"])


def test_overlay_of_nested_settings(spark):
    schema = "path string, value string"
    base = spark.createDataFrame([("a", "1"), ("b.c", "2"), ("b.d", "3"), ("e.f.g", "4"), ("h", "5")], schema)
    patch = spark.createDataFrame([("a", "9"), ("b.c", None), ("e", "flat"), ("h.i", "deep"), ("new", "x")], schema)
    found = {r["path"]: r["value"] for r in C.overlay_paths(base, patch).collect()}
    assert found == {"a": "9", "b.c": None, "b.d": "3", "e": "flat", "h.i": "deep", "new": "x"}


def test_jobs(spark):
    now = datetime(2024, 1, 1, 12)
    rows = [
        ("stress-test-1", None, None, 1, 1, now - timedelta(minutes=5)),
        ("stress-another-2", 1, None, None, None, now - timedelta(minutes=2)),
        ("other", 0, 1, 1, 2, now),
        ("idle", 0, 0, 0, 1, None),
    ]
    df = spark.createDataFrame(
        rows, "name string, succeeded int, failed int, active int, completions int, created timestamp"
    )
    found = {r["name"]: (r["status"], r["completed"], r["age_seconds"]) for r in J.job_overview(df, F.lit(now)).collect()}
    assert found == {
        "stress-test-1": ("Running", "0/1", 300),
        "stress-another-2": ("Completed", "1/1", 120),
        "other": ("Failed", "0/2", 0),
        "idle": ("Pending", "0/1", None),
    }
    by_activity = ST.job_status_by_activity(F.col("succeeded"), F.col("failed"), F.col("active"))
    assert [r[0] for r in df.select(by_activity).collect()] == ["Running", "Completed", "Running", "Unknown"]
    assert J.named(df, "stress-").count() == 2
    assert J.named(df, None).count() == 4
    assert [r["name"] for r in J.oldest_first(df).collect()] == ["stress-test-1", "stress-another-2", "other", "idle"]


def test_recent_steps(spark):
    rows = [("s1", None), ("s2", datetime(2024, 1, 1)), ("s3", datetime(2024, 1, 3)), ("s0", None)]
    df = spark.createDataFrame(rows, "step_id string, start_time timestamp")
    assert [r["step_id"] for r in J.most_recent(df, 3).collect()] == ["s3", "s2", "s0"]
    assert J.most_recent(df.where("false"), 3).count() == 0


def test_pods(spark):
    schema = "name string, containers array<struct<ready: boolean, restart_count: int>>"
    df = spark.createDataFrame(
        [("a", [(True, 1), (False, None), (None, 4)]), ("b", []), ("c", None)], schema
    )
    assert [(r["ready"], r["restarts"]) for r in J.pod_readiness(df).orderBy("name").collect()] == [
        ("1/3", 5),
        ("0/1", 0),
        ("0/1", 0),
    ]
    assert [r["ready"] for r in J.pod_readiness(df, floor=F.lit(4)).orderBy("name").collect()] == ["1/4", "0/4", "0/4"]
    rows = spark.createDataFrame([("a", True, 1), ("a", False, None)], "pod string, ready boolean, restart_count int")
    assert tuple(J.pod_readiness_by_rows(rows, "pod").first()) == ("a", "1/2", 1)


def test_labels(spark):
    df = spark.createDataFrame(
        [({"node-role.kubernetes.io/master": "", "zone": "a"}, [("Ready", "True")]), ({"zone": "a"}, [("Ready", "False")]), (None, None)],
        "labels map<string,string>, conditions array<struct<type: string, status: string>>",
    )
    rows = df.select(LB.roles(F.col("labels")), LB.node_ready(F.col("conditions"))).collect()
    assert [tuple(r) for r in rows] == [(["master"], "Ready"), (["<none>"], "NotReady"), (["<none>"], "NotReady")]
    tags = spark.createDataFrame(
        [([("a", "1"), ("a", "2"), ("b", None)],), ([],), (None,), ([("c", "1"), ("d", "2")],)],
        "tags array<struct<key: string, value: string>>",
    )
    maps = tags.select(LB.tags_to_map(F.col("tags")).alias("m"), LB.has_any_tag(F.col("tags"), [("a", "2")]).alias("h")).collect()
    assert [(r["m"], r["h"]) for r in maps] == [({"a": "2", "b": None}, True), ({}, False), (None, False), ({"c": "1", "d": "2"}, False)]


def test_main_associations(spark):
    df = spark.createDataFrame(
        [(1, [(True,), (False,)]), (2, [(False,), (None,)]), (3, []), (4, None)], "id int, items array<struct<main: boolean>>"
    )
    assert sorted(r["id"] for r in df.where(LB.none_of(F.col("items"), "main")).collect()) == [2, 3, 4]


def test_names_and_globs(spark):
    df = spark.createDataFrame([("lab-images-cassandra-amd64-2024",), ("malformed-name",), ("a_b%c.yaml",)], "name string")
    name = F.col("name")
    assert [r[0] for r in df.select(TX.name_type(name)).collect()] == ["cassandra", "unknown", "unknown"]
    assert [r[0] for r in df.select(TX.glob(name, "*images*amd64-*")).collect()] == [True, False, False]
    assert [r[0] for r in df.select(TX.glob(name, "a_b%c*")).collect()] == [False, False, True]
    assert [r[0] for r in df.select(TX.glob(name, "a-b*")).collect()] == [False, False, False]
    paths = spark.createDataFrame([("x/a.log",), ("x/a.tmp",), ("axlog",), ("y.d/data1",)], "path string")
    path = F.col("path")
    assert [r[0] for r in paths.select(TX.wanted_file(path, ["*.log", "data*"])).collect()] == [True, False, False, True]
    assert [r[0] for r in paths.select(TX.wanted_file(path, (), ["*.tmp"])).collect()] == [True, False, True, True]
    assert [r[0] for r in paths.select(TX.wanted_file(path, ["*"], ["a*"])).collect()] == [False, False, False, True]
    arch = spark.createDataFrame([("x86_64",), ("arm64",)], "a string")
    assert [r[0] for r in arch.select(TX.normalise_arch(F.col("a"))).collect()] == ["amd64", "arm64"]
