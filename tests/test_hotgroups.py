from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from labspark.plans import hotgroups as H
from labspark.operators.metrics import counter_increase
from labspark.plans.numbering import numbered
from labspark.plans import topn

SCHEMA = "g string, at timestamp, id bigint"


def rows(n=500, seed=2):
    draw = random.Random(seed)
    start = datetime(2024, 1, 1)
    out = []
    for i in range(n):
        group = draw.choice(["hot", "hot", "hot", None, None, f"c{i % 40}"])
        out.append((group, start + timedelta(seconds=draw.choice([draw.randrange(10_000), draw.randrange(20)])), i))
    return out


@pytest.mark.parametrize("target", [10, 40])
def test_slices_are_small_ordered_and_whole(spark, target):
    data = rows()
    cold, hot = H.split_hot(spark.createDataFrame(data, SCHEMA), ["g"], "at", target)
    sliced = hot.collect()
    ids = [r["id"] for r in cold.collect()] + [r["id"] for r in sliced]
    assert sorted(ids) == list(range(len(data)))
    assert {r["g"] for r in sliced} == {"hot", None}
    per_slice = {}
    for r in sliced:
        per_slice.setdefault((r["g"], r["_slice"]), []).append(r["at"])
    assert all(len(v) <= target or len(set(v)) == 1 for v in per_slice.values())
    for group in ("hot", None):
        ends = [(min(v), max(v)) for (g, _), v in sorted(((k, v) for k, v in per_slice.items() if k[0] == group), key=lambda x: x[0][1])]
        assert all(a[1] < b[0] for a, b in zip(ends, ends[1:]))


def test_nothing_is_added_without_hot_groups(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    cold, hot = H.split_hot(df, ["g"], "at")
    assert cold is df
    assert hot is None


def test_an_instant_is_cut_along_the_tie_only(spark):
    df = spark.createDataFrame([("g", datetime(2024, 1, 1), i) for i in range(50)], SCHEMA)
    cold, hot = H.split_hot(df, ["g"], "at", 10)
    assert (cold.count(), hot) == (50, None)
    cold, hot = H.split_hot(df, ["g"], "at", 10, tie="id")
    assert cold.count() == 0
    slices = [r["_slice"] for r in hot.orderBy("id").collect()]
    assert len(slices) == 50
    assert slices == sorted(slices)
    assert max(slices.count(s) for s in slices) <= 10


@pytest.mark.parametrize("null_safe", [False, True])
@pytest.mark.parametrize("max_rows", [5, 1_000_000])
def test_join_unique_equals_a_left_join(spark, null_safe, max_rows):
    data = rows()
    left = spark.createDataFrame(data, SCHEMA)
    right = spark.createDataFrame([("hot", 1), (None, 2), ("c3", 3), ("unused", 4)], "g string, v int")
    want = {"hot": 1, "c3": 3, None: 2 if null_safe else None}
    joined = H.join_unique(left, right, ["g"], max_rows, null_safe)
    assert joined.columns == ["g", "at", "id", "v"]
    assert sorted((r["id"], r["v"]) for r in joined.collect()) == sorted((i, want.get(g)) for g, _, i in data)


@pytest.mark.parametrize("n", [3, 60])
def test_first_n_with_and_without_spreading(spark, n, monkeypatch):
    monkeypatch.setattr(topn, "EARLY_CUT", 10)
    data = rows()
    found = topn.newest_n(spark.createDataFrame(data, SCHEMA), ["g"], "at", "id", n).collect()
    want = []
    for group in {r[0] for r in data}:
        mine = sorted((r for r in data if r[0] == group), key=lambda r: (-r[1].timestamp(), r[2]))
        want += [r[2] for r in mine[:n]]
    assert sorted(r["id"] for r in found) == sorted(want)


@pytest.mark.parametrize("kind", ["string", "date", "int", "double", "timestamp"])
def test_numbering_along_any_kind_of_order(spark, kind):
    draw = random.Random(4)
    values = {
        "string": lambda: draw.choice(["", "é", "zz", None]) if draw.random() < 0.2 else "".join(draw.choices("aéz0", k=5)),
        "date": lambda: (datetime(2024, 1, 1) + timedelta(days=draw.randrange(50))).date(),
        "int": lambda: draw.choice([None, draw.randrange(-20, 20)]),
        "double": lambda: draw.uniform(-1, 1),
        "timestamp": lambda: draw.choice([None, datetime(2024, 1, 1) + timedelta(hours=draw.randrange(9))]),
    }[kind]
    data = [("g", values(), i) for i in range(200)]
    df = spark.createDataFrame(data, f"g string, at {kind}, id int")
    found = numbered(df, ["g"], ["at", "id"], "n").collect()
    key = (lambda v: v.encode()) if kind == "string" else (lambda v: v)
    nulls = sorted(r[2] for r in data if r[1] is None)
    rest = [r[2] for r in sorted((r for r in data if r[1] is not None), key=lambda r: (key(r[1]), r[2]))]
    assert [r["id"] for r in sorted(found, key=lambda r: r["n"])] == nulls + rest
    assert [r["n"] for r in sorted(found, key=lambda r: r["n"])] == list(range(1, 201))


def test_a_long_list_of_hot_groups_is_a_table(spark, monkeypatch):
    data = [(f"g{g}", datetime(2024, 1, 1) + timedelta(seconds=i), g * 100 + i) for g in range(12) for i in range(60)]
    df = spark.createDataFrame(data, SCHEMA)
    want = {r["id"]: r["increase"] for r in counter_increase(df, ["g"], "at", "id").collect()}
    monkeypatch.setattr(H, "LISTED_GROUPS", 1)
    cold, hot = H.split_hot(df, ["g"], "at", 20)
    # Every group is hot, and every one is cut, however many there are.
    assert cold.count() == 0
    assert hot.groupBy("g", H.SLICE).count().agg(F.max("count")).first()[0] <= 20
    found = {r["id"]: r["increase"] for r in counter_increase(df, ["g"], "at", "id", target_rows=20).collect()}
    assert found == want


def test_micros_do_not_depend_on_the_time_zone(spark):
    df = spark.createDataFrame([(datetime(2024, 3, 31, 2, 30, 0, 123456),)], "ts timestamp_ntz")
    expected = df.select(H.micros(df, "ts")).first()[0]
    assert expected == 1711852200123456
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
        assert df.select(H.micros(df, "ts")).first()[0] == expected
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert df.select(F.lit(1)).count() == 1


@pytest.mark.parametrize("partitions", ["1", "8", "40"])
def test_numbers_do_not_depend_on_group_size(spark, partitions):
    """Many large groups, text orders that share a long prefix, null groups and ties: one way for all."""
    rows = [(f"g{i % 30}" if i % 3 else "hot", f"2024-01-01T00:00:{i * 7 % 1000:06d}", i) for i in range(3000)]
    rows += [(None, None, 3000), (None, "a", 3001), ("alone", None, 3002)]
    df = spark.createDataFrame(rows, "g string, at string, id long")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        found = {r["id"]: r["n"] for r in numbered(df, ["g"], ["at", "id"], "n").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    want = {}
    for group in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == group), key=lambda r: (r[1] is not None, r[1] or "", r[2]))
        want |= {r[2]: i + 1 for i, r in enumerate(mine)}
    assert found == want
