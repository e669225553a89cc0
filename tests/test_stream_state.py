"""Keyed stream state: trailing rates of samples in any order, runs that end, and what the state holds."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import types as T

from labspark.operators import metrics as M
from labspark.streaming import metrics as SM
from labspark.streaming import state as SK
from labspark.streaming.batches import appended

START = datetime(2024, 3, 30)
SCHEMA = "metric string, host string, sample_id bigint, ts timestamp_ntz, value double"
SERIES = ["metric", "host"]
WINDOW = timedelta(seconds=60)


def put(spark, rows, folder, schema=SCHEMA):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def sample(i, host, seconds, value):
    return ("m", host, i, START + timedelta(seconds=seconds), None if value is None else float(value))


class Rates:
    """A stream of trailing rates that is run again after each arrival."""

    def __init__(self, spark, folder, late, idle=None):
        self.spark, self.late, self.idle = spark, late, idle
        self.source, self.out, self.checkpoint = (f"{folder}/{n}" for n in ("in", "out", "checkpoint"))

    def run(self, rows):
        put(self.spark, rows, self.source)
        stream = SM.sample_stream(self.spark, self.source, T.StructType.fromDDL(SCHEMA))
        rates = SK.trailing_rates(stream, SERIES, WINDOW, self.late, idle=self.idle)
        query = SK.run_trailing_rates(rates, self.out, self.checkpoint)
        query.awaitTermination()
        self.schema = rates.schema
        return [p.stateOperators[0] for p in query.recentProgress]

    def found(self):
        return {r["sample_id"]: (r["host"], r["ts"], r["increase"], r["rate"]) for r in appended(self.spark, self.out, self.schema).collect()}

    def series(self):
        return {r["key"]["host"] for r in SK.state_rows(self.spark, self.checkpoint, "series").collect()}


def close_to(found, want):
    assert found.keys() == want.keys()
    for i, (host, ts, increase, rate) in want.items():
        assert found[i][:2] == (host, ts)
        assert found[i][2:] == pytest.approx((increase, rate))


def batch(spark, rows):
    rates = M.counter_rate(spark.createDataFrame([r for r in rows if r[4] is not None], SCHEMA), SERIES, WINDOW, tie="sample_id")
    return {r["sample_id"]: (r["host"], r["ts"], r["increase"], r["rate"]) for r in rates.collect()}


def test_rates_of_samples_in_any_order_equal_the_batch_operator(spark, tmp_path):
    """Four arrivals with samples up to 200 s late, ties and resets, each read by a stream that starts anew."""
    rng = random.Random(1)
    rows = [sample(i, rng.choice("abc") if i % 9 else None, rng.randrange(0, 1600) // 4 * 4, rng.randrange(50)) for i in range(400)]
    stream = Rates(spark, str(tmp_path), timedelta(seconds=601))
    arrival = {r[2]: min(3, (r[3] - START) // timedelta(seconds=400) + rng.randrange(2)) for r in rows}
    for n in range(4):
        part = [r for r in rows if arrival[r[2]] == n]
        rng.shuffle(part)
        stream.run(part)
    assert 0 < len(stream.found()) < len(rows)
    stream.run([sample(-1, None, 9999, None)])
    close_to(stream.found(), batch(spark, rows))


def test_samples_behind_the_watermark_are_dropped(spark, tmp_path):
    rows = [sample(i, "a", 10 * i, 3 * i % 17) for i in range(30)]
    stream = Rates(spark, str(tmp_path), timedelta(seconds=20))
    stream.run(rows)
    stream.run([sample(99, "a", 5, 1000), sample(98, "a", 299, 5)])
    stream.run([sample(-1, None, 9999, None)])
    close_to(stream.found(), batch(spark, [*rows, sample(98, "a", 299, 5)]))


def test_a_batch_costs_what_it_touches_and_idle_series_leave(spark, tmp_path):
    stream = Rates(spark, str(tmp_path), timedelta(seconds=1), idle=timedelta(seconds=500))
    first = [sample(i, f"h{i % 50}", i % 7, i) for i in range(200)]
    stream.run(first)
    progress = stream.run([sample(1000 + i, "h1", 10 + i, i) for i in range(20)])
    assert progress[0].numRowsTotal >= 50
    # The rows of one series came; the other series' timers go with the watermark, their states are not written by the batch.
    assert progress[0].numRowsUpdated <= 4
    assert stream.series() == {f"h{i}" for i in range(50)}
    stream.run([sample(2000, "h1", 400, 1), sample(2001, "late", 560, 1)])
    stream.run([sample(2002, "h1", 700, 2)])
    stream.run([sample(2003, "other", 710, 2)])
    assert stream.series() == {"h1", "late", "other"}
    back = sample(3000, "h5", 720, 7)
    stream.run([back])
    stream.run([sample(-1, None, 730, None)])
    assert stream.found()[3000][2:] == (0.0, 0.0)


def test_state_calls_are_shared_by_the_series_of_a_bucket(spark, tmp_path):
    """Many series with few samples each: the state's rows do not grow with the series."""
    rows = [sample(2 * i + j, f"h{i}", 100 * j + i % 50, i + j) for i in range(3000) for j in range(2)]
    stream = Rates(spark, str(tmp_path), timedelta(seconds=1))
    progress = stream.run(rows)
    assert 0 < progress[0].numRowsUpdated <= SK.BUCKETS
    stream.run([sample(-1, None, 9999, None)])
    close_to(stream.found(), batch(spark, rows))


def test_series_of_one_bucket_stay_apart(spark, tmp_path):
    """Null and large whole numbers and odd texts in keys, sizes far apart, series that leave from between others."""
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    schema, keys = "host bigint, rack string, sample_id bigint, ts timestamp_ntz, value double", ["host", "rack"]
    names = [(None, None), (None, ""), ((1 << 60) + 1, "null"), (1 << 60, 'a"\n,\\b'), (-1, "\u00e9 x")]

    def row(i, name, seconds, value):
        return (*name, i, START + timedelta(seconds=seconds), value)

    def run(rows):
        put(spark, rows, source, schema)
        stream = SM.sample_stream(spark, source, T.StructType.fromDDL(schema))
        rates = SK.trailing_rates(stream, keys, WINDOW, timedelta(seconds=1), idle=timedelta(seconds=100), buckets=1)
        SK.run_trailing_rates(rates, out, checkpoint).awaitTermination()
        states = SK.state_rows(spark, checkpoint, "series").collect()
        return rates.schema, {(r["key"].get("host"), r["key"].get("rack")): r["value"]["waiting"] for r in states}

    large = 1 << 60
    first = [row(large + 5 * i + k, name, 3 * i + k, 10.0 ** (15 - 6 * k) * (i % 7 + 1)) for i in range(20) for k, name in enumerate(names)]
    _, states = run([*first, row(None, (None, None), 60, None)])
    assert len(states) == 5 and states[None, None] == 0 and states["-1", names[4][1]] == 1
    second = [row(large + 200 + i, names[3], 70 + i, 1e-3 * i) for i in range(70)]
    run(second)
    _, states = run([row(None, (None, None), 165, None)])
    assert states == {(str(1 << 60), names[3][1]): 0}
    third = [row(large + 300 + 10 * k + i, names[k], 170 + i, float(i)) for i in range(3) for k in (1, 3)]
    _, states = run(third)
    assert states == {(None, ""): 1, (str(1 << 60), names[3][1]): 1}
    types, _ = run([row(None, (None, None), 250, None)])
    samples = spark.createDataFrame([*first, *second], schema)
    want = M.counter_rate(samples, keys, WINDOW, tie="sample_id").collect()
    found = {r["sample_id"]: r for r in appended(spark, out, types).collect()}
    assert len(found) == len(first) + len(second) + len(third)
    for r in want:
        f = found[r["sample_id"]]
        assert (f["host"], f["rack"], f["ts"]) == (r["host"], r["rack"], r["ts"])
        assert (f["increase"], f["rate"]) == pytest.approx((r["increase"], r["rate"]))
    # One had left before and came back, one went on.
    assert [[found[large + 300 + 10 * k + i]["rate"] for i in range(3)] for k in (1, 3)] == [
        pytest.approx([0.0, 1 / 60, 2 / 60]),
        pytest.approx([29e-3 / 60, 1 / 60 + 28e-3 / 60, 2 / 60 + 27e-3 / 60]),
    ]


EVENTS = "run_id string, seq bigint, event_type string, message string, ts timestamp"


def test_closed_runs_leave_the_state(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))

    def run(rows):
        put(spark, [(r, s, k, m, START + timedelta(seconds=t)) for r, s, k, m, t in rows], source, EVENTS)
        stream = SM.sample_stream(spark, source, T.StructType.fromDDL(EVENTS))
        shown = SK.routed_events(stream, timedelta(seconds=5), every=10, remember=timedelta(seconds=60))
        SK.run_routed_events(shown, out, checkpoint).awaitTermination()
        states = SK.state_rows(spark, checkpoint, "run").collect()
        return shown.schema, {r["key"]["run_id"]: tuple(r["value"]) for r in states}

    frames = [("r", i, "frame", None, i) for i in range(15)]
    _, states = run([*frames, ("s", 0, "message", "hi", 3), ("s", 1, "frame", None, 4)])
    assert states == {"r": (15, False), "s": (1, False)}
    more = [("r", i, "frame", None, i) for i in range(15, 22)]
    _, states = run([*more, ("r", 22, "close", None, 22), ("r", 23, "error", "after", 23)])
    assert states["r"] == (22, True)
    _, states = run([("r", 24, "error", "late", 30), ("s", 2, "error", "\x1b[1mx\r\ny ", 30)])
    assert states["r"] == (22, True)
    _, states = run([("s", 3, "frame", None, 200)])
    assert states == {"s": (2, False)}
    schema, states = run([("r", 0, "message", "again", 210)])
    rows = sorted((r["run_id"], r["seq"], r["event_type"], r["message"]) for r in appended(spark, out, schema).collect())
    assert rows == [
        ("r", 0, "message", "again"),
        ("r", 9, "message", "Docker container activity: 10 frames processed"),
        ("r", 19, "message", "Docker container activity: 20 frames processed"),
        ("s", 0, "message", "hi"),
        ("s", 2, "error", "ERROR: x y"),
    ]


def test_settings_are_put_back(spark):
    key = next(iter(SK.STORE))
    before = spark.conf.get(key, None)
    with SK.keyed_store(spark):
        assert spark.conf.get(key) == SK.STORE[key]
    assert spark.conf.get(key, None) == before
