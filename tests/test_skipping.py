"""Searches with a skipping index against the same searches without one."""

from __future__ import annotations

import datetime
import random

import pytest
from pyspark.sql import functions as F

from labspark.sources import skipping as S

SCHEMA = "id bigint, day string, level string, at timestamp_ntz, body string, extra double"
START = datetime.datetime(2024, 1, 1)


def lines(n=600, seed=3):
    draw = random.Random(seed)
    out = []
    for i in range(n):
        day = i * 12 // n
        body = draw.choice([None, "", " ".join(f"w{draw.randrange(40 * day, 40 * day + 60)}" for _ in range(9)), "Fail-Over, x"])
        if i % 50 == 1:
            body = " ".join(f"w{40 * day + k}" for k in range(60))
        level = draw.choice(["Error", "Info", None])
        out.append((i, f"d{day}", level, START + datetime.timedelta(hours=2 * day, minutes=draw.randrange(60)), body, 0.5))
    return out


def write(spark, rows, store, mode="append"):
    spark.createDataFrame(rows, SCHEMA).repartition("day").write.partitionBy("day").mode(mode).parquet(store)


def files_of(df):
    return {name.rsplit("/", 2)[1] + "/" + name.rsplit("/", 1)[1] for name in df.inputFiles()}


@pytest.fixture
def store(spark, tmp_path):
    write(spark, lines(), str(tmp_path / "store"))
    return str(tmp_path / "store")


def has(body, word):
    import re

    return body is not None and word.lower() in [w.lower() for w in re.findall("[A-Za-z0-9_]+", body)]


@pytest.mark.parametrize(
    "wanted",
    [
        {"has": ["w5"]},
        {"has": ["W130", "w131"]},
        {"has": ["fail", "OVER"], "equal": {"level": "Error"}},
        {"has": ["nothing"]},
        {"equal": {"day": "d3", "level": "Info"}},
        {"between": {"at": (START + datetime.timedelta(hours=6), START + datetime.timedelta(hours=9))}},
        {"between": {"extra": (0.0, 0.4)}},
        {"has": ["w200"], "between": {"at": (START, START + datetime.timedelta(hours=11))}},
        {},
    ],
)
def test_rows_are_those_of_a_whole_scan(spark, store, tmp_path, wanted):
    index = str(tmp_path / "index")
    assert S.index_files(spark, store, index, "body", ["level", "day"], ["at", "extra"]) == 12
    found = S.search_store(spark, store, index, "body", **wanted)
    want = set()
    for row in lines():
        named = dict(zip(("id", "day", "level", "at", "body", "extra"), row))
        good = all(has(named["body"], w) for w in wanted.get("has", []))
        good &= all(named[k] == v for k, v in wanted.get("equal", {}).items())
        good &= all(lo <= named[k] <= hi for k, (lo, hi) in wanted.get("between", {}).items())
        if good:
            want.add((row[0], row[1]))
    assert {(r["id"], r["day"]) for r in found.collect()} == want
    assert found.columns == spark.read.parquet(store).columns


def test_files_that_cannot_match_are_not_read(spark, store, tmp_path):
    index = str(tmp_path / "index")
    S.index_files(spark, store, index, "body", ["level", "day"], ["at"])
    everything = files_of(spark.read.parquet(store))
    assert len(everything) == 12
    # Words w0 to w39 are in the first file alone, w40 to w59 in the first two.
    assert len(files_of(S.search_store(spark, store, index, "body", ["w5"]))) == 1
    assert len(files_of(S.search_store(spark, store, index, "body", ["w45"]))) == 2
    assert S.search_store(spark, store, index, "body", ["nothing"]).inputFiles() == []
    assert len(S.search_store(spark, store, index, equal={"day": "d7"}).inputFiles()) == 1
    late = {"at": (START + datetime.timedelta(hours=20), START + datetime.timedelta(days=9))}
    assert len(S.search_store(spark, store, index, between=late).inputFiles()) == 2
    assert S.search_store(spark, store, index, between={"at": (START - datetime.timedelta(days=2), START - datetime.timedelta(days=1))}).count() == 0


def test_new_changed_and_deleted_files(spark, store, tmp_path):
    index = str(tmp_path / "index")
    # Without an index every file is read.
    assert len(S.search_store(spark, store, index, "body", ["w5"]).inputFiles()) == 12
    S.index_files(spark, store, index, "body", ["day"])
    write(spark, [(1000, "d0", "Error", START, "w5 w9999", 1.0)], store)
    found = S.search_store(spark, store, index, "body", ["w9999"])
    assert [r["id"] for r in found.collect()] == [1000]
    assert len(found.inputFiles()) == 1
    # The next run takes the new file alone; its entry then rules it out.
    assert S.index_files(spark, store, index, "body", ["day"]) == 1
    assert S.index_files(spark, store, index, "body", ["day"]) == 0
    assert S.search_store(spark, store, index, "body", ["w777777"]).inputFiles() == []
    with pytest.raises(ValueError):
        S.index_files(spark, store, index, "body", [])
    # A run that was not committed is not seen.
    spark.createDataFrame([(1,)], "file bigint").write.parquet(f"{index}/run=broken/files")
    assert [r["id"] for r in S.search_store(spark, store, index, "body", ["w9999"]).collect()] == [1000]
    # Files written anew have other numbers, so the old entries say nothing of them.
    write(spark, [(7, "d0", "Info", START, "fresh", 1.0)], store, "overwrite")
    assert [r["id"] for r in S.search_store(spark, store, index, "body", ["fresh"]).collect()] == [7]
    assert S.search_store(spark, store, index, "body", ["w9999"]).count() == 0
    S.index_files(spark, store, index, "body", ["day"])
    assert S.compact_index(spark, store, index) == 1
    assert [r["id"] for r in S.search_store(spark, store, index, "body", ["fresh"]).collect()] == [7]
    assert S.search_store(spark, store, index, "body", ["w5"]).inputFiles() == []


def test_filters_of_many_tokens_miss_nothing_and_seldom_err(spark, tmp_path):
    """Filters of one bitmap and of several: every token of a file is found in it, few others are."""
    store, index = str(tmp_path / "store"), str(tmp_path / "index")
    sizes = {"d0": 30, "d1": 2_000, "d2": 30_000}
    for day, n in sizes.items():
        body = F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.concat(F.lit(day), i.cast("string"))))
        spark.range(1).select("id", F.lit(day).alias("day"), body.alias("body")).write.partitionBy("day").mode("append").parquet(store)
    S.index_files(spark, store, index, "body")
    run = S._state(spark, index)[1]["runs"]
    bits = S._rows(spark, index, run, "bits").cache()
    assert {r["level"]: r["n"] for r in bits.groupBy("level").agg(F.count(F.lit(1)).alias("n")).collect()} == {0: 2, 4: 16}
    draw = random.Random(1)
    token = [f"{day}{draw.randrange(n)}" for day, n in sizes.items() for _ in range(5)] + [f"no{i}" for i in range(12)]
    numbers = list(spark.range(1).select(*[S._token("word", F.lit(t)).alias(f"t{i}") for i, t in enumerate(token)]).first())
    files = {t: S._holding(bits, [n]).count() for t, n in zip(token, numbers)}
    assert all(files[t] >= 1 for t in token if not t.startswith("no"))
    assert sum(files[t] for t in token if t.startswith("no")) <= 3
    bits.unpersist()
    pushed = S._holding(S._rows(spark, index, run, "bits"), numbers[:1])._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(low" in pushed and "GreaterThanOrEqual(hi" in pushed


def test_words_and_types(spark, store, tmp_path):
    df = spark.createDataFrame([("Ab_c x-AB_C ÉtÉ 9",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(S.words(F.col("t"))).collect()] == [["ab_c", "x", "t", "9"], [], []]
    with pytest.raises(ValueError):
        S.has_word(F.col("t"), "two words")
    with pytest.raises(TypeError):
        S.index_files(spark, store, str(tmp_path / "i"), None, ["extra"])
