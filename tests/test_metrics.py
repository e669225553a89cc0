from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from labspark.operators import metrics as M

START = datetime(2024, 1, 1)
SCHEMA = "metric string, host string, sample_id bigint, ts timestamp_ntz, value double"


def samples(spark, rows, host="h"):
    data = [("m", host, i, START + timedelta(seconds=t), float(v)) for i, (t, v) in enumerate(rows)]
    return spark.createDataFrame(data, SCHEMA)


def by_second(rows, column):
    return {(r["ts"] - START).total_seconds(): r[column] for r in rows}


def test_increase_handles_a_reset_and_a_single_sample(spark):
    df = samples(spark, [(0, 50), (10, 60), (20, 5), (30, 15)])
    found = by_second(M.counter_increase(df, ["metric", "host"]).collect(), "increase")
    assert found == {0: 0.0, 10: 10.0, 20: 5.0, 30: 10.0}
    assert [r["increase"] for r in M.counter_increase(samples(spark, [(0, 7)]), ["host"]).collect()] == [0.0]


@pytest.mark.parametrize("target_rows", [1_000_000, 3])
def test_increase_goes_on_from_an_earlier_value(spark, target_rows):
    df = samples(spark, [(t, t) for t in range(10, 110, 10)]).withColumn("was", F.lit(4.0))
    found = by_second(M.counter_increase(df, ["host"], target_rows=target_rows, before="was").collect(), "increase")
    assert found == {10: 6.0, **{t: 10.0 for t in range(20, 110, 10)}}


@pytest.mark.parametrize("target_rows", [1_000_000, 4])
def test_rate_of_a_steady_counter_is_one(spark, target_rows):
    df = samples(spark, [(t, t) for t in range(0, 121, 10)])
    rates = M.counter_rate(df, ["metric", "host"], timedelta(seconds=60), target_rows=target_rows)
    found = by_second(rates.collect(), "rate")
    assert len(found) == 13
    assert found[60] == pytest.approx(1.0)
    assert found[120] == pytest.approx(1.0)
    assert found[0] == 0.0
    assert found[30] == pytest.approx(0.5)


def plain_rates(rows, window):
    """Brute force over (series, t, id, value)."""
    out = {}
    for series in {r[0] for r in rows}:
        mine = sorted((r[1:] for r in rows if r[0] == series), key=lambda r: (r[0], r[1]))
        grown = []
        for i, (t, i_d, v) in enumerate(mine):
            before = mine[i - 1][2] if i else None
            grown.append((t, i_d, 0.0 if before is None else v if v < before else v - before))
        for t, i_d, inc in grown:
            out[i_d] = (inc, sum(g for u, _, g in grown if t - window < u <= t) / window)
    return out


@pytest.mark.parametrize("target_rows", [1_000_000, 100, 13, 3])
def test_hot_series_are_cut_without_changing_any_value(spark, target_rows):
    draw = random.Random(5)
    rows = []
    for i in range(400):
        series = "hot" if i % 3 else f"cold{i % 7}" if i % 2 else None
        burst = draw.choice([draw.randrange(0, 3000), draw.randrange(1000, 1040)])
        rows.append((series, burst, i, float(draw.randrange(0, 500))))
    df = spark.createDataFrame(
        [("m", s, i, START + timedelta(seconds=t), v) for s, t, i, v in rows], SCHEMA
    )
    want = plain_rates(rows, 60)
    got = M.counter_rate(
        df, ["metric", "host"], timedelta(seconds=60), tie="sample_id", target_rows=target_rows
    ).collect()
    assert len(got) == len(rows)
    for r in got:
        inc, rate = want[r["sample_id"]]
        assert r["increase"] == pytest.approx(inc), r
        assert r["rate"] == pytest.approx(rate), r


def test_busy_percent_averages_cpus(spark):
    first = [("idle", "h", "0", START + timedelta(seconds=t), 0.4 * t) for t in range(0, 121, 10)]
    second = [("idle", "h", "1", START + timedelta(seconds=t), 0.6 * t) for t in range(0, 121, 10)]
    df = spark.createDataFrame(first + second, "metric string, host string, cpu string, ts timestamp_ntz, value double")
    window = timedelta(seconds=60)
    busy = M.busy_percent(df.where(F.col("ts") >= F.lit(START)), "host", ["host", "cpu"], window, timedelta(seconds=1))
    last = busy.orderBy(F.desc("step")).first()
    assert last["busy_pct"] == pytest.approx(50.0)


def test_last_sample_of_a_step_wins(spark):
    df = samples(spark, [(0, 1), (4, 2), (9, 3)])
    rows = M.last_per_step(df, ["host"], timedelta(seconds=10)).collect()
    assert [(r["step"], r["value"]) for r in rows] == [(START, 3.0)]


def test_relative_range_has_an_open_left_end(spark):
    df = samples(spark, [(0, 1), (30, 2), (60, 3)])
    kept = M.relative_range(df, timedelta(seconds=60)).collect()
    assert sorted(by_second(kept, "value")) == [30, 60]


def test_relative_range_skips_older_folders(spark, tmp_path):
    rows = [("m", "h", i, START + timedelta(hours=9 * i), 1.0) for i in range(12)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("day", F.to_date("ts"))
    df.write.partitionBy("day").parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    recent = M.relative_range(stored, timedelta(hours=20), as_of=F.lit(START + timedelta(hours=100)).cast("timestamp_ntz"), day="day")
    assert sorted(r["sample_id"] for r in recent.collect()) == [9, 10, 11]
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan


def test_select_and_promote_labels(spark):
    df = spark.createDataFrame(
        [("m", {"state": "idle", "host_name": "a"}), ("m", {"state": "user"}), ("n", {"state": "idle"})],
        "metric string, labels map<string,string>",
    )
    rows = M.promote_labels(M.select_metric(df, "m", {"state": "idle"}), ["host_name"]).collect()
    assert [r["host_name"] for r in rows] == ["a"]


def test_panel_and_load_columns(spark):
    df = spark.createDataFrame(
        [("r", "a", START, 1.0), ("w", "a", START, 2.0), ("x", "a", START, 3.0)],
        "metric string, host string, ts timestamp_ntz, value double",
    )
    panel = M.panel_targets(df, {"r": "read", "w": "write"}, "host")
    assert sorted(r["legend"] for r in panel.collect()) == ["a read", "a write"]
    wide = M.side_by_side(df, ["host"], {"r": "one", "w": "five", "none": "fifteen"}).first()
    assert (wide["one"], wide["five"], wide["fifteen"]) == (1.0, 2.0, None)


@pytest.mark.parametrize("target_rows", [20, 5])
def test_many_samples_of_one_instant(spark, target_rows):
    draw = random.Random(13)
    rows = [("hot" if i % 3 else None, draw.choice([7, 7, 7, 30, draw.randrange(0, 300)]), i, float(draw.randrange(90))) for i in range(300)]
    df = spark.createDataFrame([("m", s, i, START + timedelta(seconds=t), v) for s, t, i, v in rows], SCHEMA)
    want = plain_rates(rows, 60)
    got = M.counter_rate(df, ["metric", "host"], timedelta(seconds=60), tie="sample_id", target_rows=target_rows).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["increase"], r["rate"]) == pytest.approx(want[r["sample_id"]])


def test_a_dense_series_takes_the_linear_way(spark, monkeypatch):
    monkeypatch.setattr(M, "DENSE_ROWS", 50)
    monkeypatch.setattr(M, "DENSE_PER_WINDOW", 10)
    draw = random.Random(9)
    rows = [("dense" if i % 2 else "flood", draw.randrange(0, 90) if i % 2 else 7, i, draw.random() * 9) for i in range(200)]
    df = spark.createDataFrame([("m", s, i, START + timedelta(seconds=t), v) for s, t, i, v in rows], SCHEMA)
    want = plain_rates(rows, 60)
    got = M.counter_rate(df, ["metric", "host"], timedelta(seconds=60), tie="sample_id").collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["rate"] == pytest.approx(want[r["sample_id"]][1])
