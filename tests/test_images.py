from __future__ import annotations

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from labspark.operators import images as I

SCHEMA = "id string, name string, architecture string, creation_date timestamp, snapshot_ids array<string>"


def image(i, kind, arch, day, snapshots=()):
    name = f"lab-images-{kind}-{arch}-202401{day}"
    return (f"ami-{i}", name, arch, datetime(2024, 1, int(day)), list(snapshots))


def images(spark, rows):
    return I.with_image_group(spark.createDataFrame(rows, SCHEMA))


def split(df, n):
    marked = I.mark_surplus(df, n)
    deleted = [r["id"] for r in I.in_delete_order(marked.where("surplus")).collect()]
    kept = sorted(r["id"] for r in marked.where("NOT surplus").collect())
    assert kept == sorted(r["id"] for r in I.keep_newest(df, n).collect())
    return deleted, kept


def test_keeps_newest_per_architecture(spark):
    rows = [image(1, "cassandra", "amd64", "03"), image(2, "cassandra", "amd64", "02"), image(3, "cassandra", "amd64", "01")]
    rows += [image(4, "cassandra", "arm64", "03"), image(5, "cassandra", "arm64", "02")]
    assert split(images(spark, rows), 2) == (["ami-3"], ["ami-1", "ami-2", "ami-4", "ami-5"])


def test_keeps_newest_per_type(spark):
    rows = [image(1, "cassandra", "amd64", "03"), image(2, "cassandra", "amd64", "02")]
    rows += [image(3, "base", "amd64", "03"), image(4, "base", "amd64", "02")]
    deleted, kept = split(images(spark, rows), 1)
    assert (sorted(deleted), kept) == (["ami-2", "ami-4"], ["ami-1", "ami-3"])


def test_malformed_names_form_their_own_group(spark):
    bad = ("ami-2", "malformed-name", "amd64", datetime(2024, 1, 2), [])
    df = images(spark, [image(1, "cassandra", "amd64", "03"), bad, image(3, "cassandra", "amd64", "01")])
    assert df.where("id = 'ami-2'").first()["group_key"] == "unknown-amd64"
    assert split(df, 1) == (["ami-3"], ["ami-1", "ami-2"])


def test_short_groups_empty_input_and_none_kept(spark):
    rows = [image(1, "a", "x", "01"), image(2, "b", "x", "01"), image(3, "c", "x", "01")]
    assert split(images(spark, rows), 1)[0] == []
    assert split(images(spark, rows), 9)[0] == []
    assert split(images(spark, []), 2) == ([], [])
    assert I.mark_surplus(images(spark, rows), 0).where("surplus").count() == 3


def test_equal_dates_keep_the_lower_id(spark):
    rows = [image(2, "a", "x", "01"), image(1, "a", "x", "01")]
    assert split(images(spark, rows), 1) == (["ami-2"], ["ami-1"])


def test_absent_dates_and_groups_are_oldest_and_together(spark):
    rows = [("a", "g", None), ("b", "g", datetime(2024, 1, 1)), ("c", None, None), ("d", None, None)]
    df = spark.createDataFrame(rows, "id string, group_key string, creation_date timestamp")
    assert split(df, 1) == (["a", "d"], ["b", "c"])


def test_surplus_against_brute_force(spark):
    draw = random.Random(3)
    rows = [(i, draw.choice("aaab"), datetime(2024, 1, draw.randrange(1, 9))) for i in range(300)]
    df = spark.createDataFrame(rows, "id bigint, group_key string, creation_date timestamp")
    want = set()
    for group in "ab":
        mine = sorted((r for r in rows if r[1] == group), key=lambda r: (-r[2].timestamp(), r[0]))
        want |= {r[0] for r in mine[7:]}
    assert {r["id"] for r in I.mark_surplus(df, 7).where("surplus").collect()} == want


def test_dependents_of_removed_images(spark):
    df = images(spark, [image(1, "a", "x", "03", ["snap-1"]), image(2, "a", "x", "02", ["snap-2", "snap-3"])])
    removed = I.mark_surplus(df, 1).where("surplus")
    found = I.dependents_in_row(removed, "snapshot_ids", "snapshot").collect()
    assert sorted(r["snapshot"] for r in found) == ["snap-2", "snap-3"]
    children = df.select("id", F.explode("snapshot_ids").alias("snapshot"))
    rows = I.dependents_in_table(removed, "id", children, "id").collect()
    assert sorted(r["snapshot"] for r in rows) == ["snap-2", "snap-3"]


def test_type_filter_ignores_case(spark):
    df = images(spark, [image(1, "Base", "x", "01"), image(2, "cassandra", "x", "01")])
    assert [r["id"] for r in I.of_type(df, "bASE").collect()] == ["ami-1"]
    assert I.of_type(df, None).count() == 2


@pytest.mark.parametrize(
    ("request_", "status", "picked"),
    [
        (("lab-*", "arm64"), "one", "ami-3"),
        (("lab-*", "amd64"), "several", "ami-1"),
        (("lab-*", "riscv"), "wrong_architecture", None),
        (("other*", "amd64"), "none", None),
    ],
)
def test_candidate_status(spark, request_, status, picked):
    rows = [image(2, "a", "amd64", "02"), image(1, "a", "amd64", "02"), image(3, "a", "arm64", "01")]
    row = I.check_candidates(images(spark, rows), [request_]).first()
    assert (row["status"], row["picked"]) == (status, picked)


def test_kept_rows_are_cut_before_the_shuffle(spark):
    df = images(spark, [image(1, "a", "x", "01")])
    plan = I.keep_newest(df, 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
