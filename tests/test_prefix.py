from __future__ import annotations

import pytest

from labspark.jobs import prefix_count
from labspark.operators.prefix import distinct_total, prefix_frequency

ROWS = [("1", "abcdef"), ("2", "abcxyz"), ("3", "ab"), ("4", None), ("5", ""), ("6", "éèê-"), ("7", "éèêx")]
WANT = {"abc": 2, "ab": 1, "": 1, "éèê": 2}


def key_values(spark):
    return spark.createDataFrame(ROWS, "key string, value string")


def test_prefixes_are_counted_without_nulls(spark):
    counts = prefix_frequency(key_values(spark))
    assert {r["prefix"]: r["frequency"] for r in counts.collect()} == WANT
    assert tuple(distinct_total(counts).first()) == (4, 6)
    assert tuple(distinct_total(counts.where("false")).first()) == (0, 0)


def test_counts_are_combined_before_the_one_shuffle(spark):
    plan = prefix_frequency(key_values(spark))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    assert "partial_count" in plan


def test_the_job_reloads_its_table(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    key_values(spark).write.parquet(source)
    for _ in range(2):
        assert prefix_count.run(spark, {"path": source}, {"format": "json", "path": target}) == 4
    assert spark.read.json(target).count() == 4


def test_job_options():
    assert prefix_count._options(["format=x", "a=b=c"]) == {"format": "x", "a": "b=c"}
    with pytest.raises(SystemExit):
        prefix_count._options(["oops"])
