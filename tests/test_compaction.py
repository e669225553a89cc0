"""Stores of update-mode streams: closed days, open steps, readers in between, retention."""

from __future__ import annotations

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import types as T

from labspark.operators import metrics as M
from labspark.sources.commits import commit, latest, numbers, publish
from labspark.streaming import compaction as SC
from labspark.streaming import metrics as SM
from labspark.streaming.batches import store_batch

START = datetime(2024, 3, 30, 12)
SCHEMA = "metric string, host string, sample_id bigint, ts timestamp_ntz, value double"
STEPS = T.StructType().add("metric", "string").add("host", "string").add("step", "timestamp").add("value", "double")
KEYS = ["metric", "host", "step"]
HOUR = timedelta(hours=1)


def sample(i, host, hours, value):
    return ("m", host, i, START + timedelta(hours=hours), float(value))


def as_rows(df):
    return sorted((r["host"], r["step"].isoformat(), r["value"]) for r in df.collect())


def test_a_compacted_store_has_each_step_once(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    rows = [sample(i, "ab"[i % 2], i / 4, i * 7 % 31) for i in range(400)]
    for n in range(5):
        spark.createDataFrame(rows[n * 80 : (n + 1) * 80], SCHEMA).write.mode("append").parquet(source)
        steps = SM.gauge_steps(SM.sample_stream(spark, source, T.StructType.fromDDL(SCHEMA)), ["metric", "host"], HOUR, 3 * HOUR, tie="sample_id")
        run = SM.run_gauge_steps(steps, out, checkpoint)
        run.awaitTermination()
        want = as_rows(M.last_per_step(spark.createDataFrame(rows[: (n + 1) * 80], SCHEMA), ["metric", "host"], HOUR, tie="sample_id"))
        assert as_rows(SC.read_steps(spark, out, steps.schema, KEYS)) == want
        if n % 2 == 0:
            SC.compact_steps(spark, out, steps.schema, KEYS, SC.watermark_of(run), HOUR)
            assert as_rows(SC.read_steps(spark, out, steps.schema, KEYS)) == want
    _, state = latest(spark, f"{out}/_log")
    assert state["days"] == ["2024-03-30", "2024-03-31", "2024-04-01", "2024-04-02"]
    for _ in range(2):
        SC.compact_steps(spark, out, steps.schema, KEYS, START + timedelta(days=99), HOUR)
    assert SC.stored_rows(spark, out) == len(want)
    assert as_rows(SC.read_steps(spark, out, steps.schema, KEYS)) == want


def revision(spark, store, batch, *rows):
    store_batch(spark.createDataFrame([("m", h, START + timedelta(hours=t), float(v)) for h, t, v in rows], STEPS), store, batch)


def test_readers_never_see_half_a_compaction(spark, tmp_path, monkeypatch):
    """One that dies before its commit changes nothing, and the next one replaces what it left."""
    store = str(tmp_path)
    revision(spark, store, 0, ("a", 0, 1), ("a", 30, 2))
    revision(spark, store, 1, ("a", 0, 3), ("b", 60, 4))
    before = as_rows(SC.read_steps(spark, store, STEPS, KEYS))
    assert [r[2] for r in before] == [3.0, 2.0, 4.0]
    real = SC.publish

    def dies(*args):
        raise RuntimeError("driver gone")

    monkeypatch.setattr(SC, "publish", dies)
    with pytest.raises(RuntimeError, match="driver gone"):
        SC.compact_steps(spark, store, STEPS, KEYS, START + timedelta(hours=40), HOUR)
    assert as_rows(SC.read_steps(spark, store, STEPS, KEYS)) == before
    monkeypatch.setattr(SC, "publish", lambda *args: False)
    assert SC.compact_steps(spark, store, STEPS, KEYS, START + timedelta(hours=40), HOUR) == -1
    monkeypatch.setattr(SC, "publish", real)
    old = SC.read_steps(spark, store, STEPS, KEYS)
    assert SC.compact_steps(spark, store, STEPS, KEYS, START + timedelta(hours=40), HOUR) == 0
    assert as_rows(SC.read_steps(spark, store, STEPS, KEYS)) == before
    # A reader that looked before the commit still finds its files.
    assert as_rows(old) == before
    revision(spark, store, 2, ("b", 60, 5))
    SC.compact_steps(spark, store, STEPS, KEYS, START + timedelta(hours=41), HOUR)
    assert [r[2] for r in as_rows(SC.read_steps(spark, store, STEPS, KEYS))] == [3.0, 2.0, 5.0]
    assert len(SC.versions(spark, store)) == 2


def test_a_batch_can_be_left_for_later(spark, tmp_path):
    store = str(tmp_path)
    revision(spark, store, 0, ("a", 0, 1))
    revision(spark, store, 1, ("a", 0, 2))
    SC.compact_steps(spark, store, STEPS, KEYS, START, HOUR, upto=0)
    assert as_rows(SC.read_steps(spark, store, STEPS, KEYS))[0][2] == 2.0


def test_retention(spark, tmp_path):
    store = str(tmp_path)
    revision(spark, store, 0, *[("a", 24 * d, d) for d in range(6)])
    SC.compact_steps(spark, store, STEPS, KEYS, START + timedelta(days=4), HOUR)
    assert SC.expire_days(spark, store, date(2024, 4, 1)) == 2
    assert [r[2] for r in as_rows(SC.read_steps(spark, store, STEPS, KEYS))] == [2.0, 3.0, 4.0, 5.0]
    assert SC.expire_days(spark, store, date(2024, 4, 1)) == 0
    revision(spark, store, 1, ("a", 24 * 5, 50))
    SC.compact_steps(spark, store, STEPS, KEYS, START + timedelta(days=4), HOUR)
    SC.compact_steps(spark, store, STEPS, KEYS, START + timedelta(days=4), HOUR)
    assert SC.stored_rows(spark, store) == 4 + 2
    assert [r[2] for r in as_rows(SC.read_steps(spark, store, STEPS, KEYS))] == [2.0, 3.0, 4.0, 50.0]


def test_an_empty_store(spark, tmp_path):
    store = str(tmp_path / "none")
    assert SC.read_steps(spark, store, STEPS, KEYS).count() == 0
    assert SC.compact_steps(spark, store, STEPS, KEYS, START, HOUR) == 0
    assert SC.read_steps(spark, store, STEPS, KEYS).count() == 0


def test_commits_have_one_writer_each(spark, tmp_path):
    log = str(tmp_path / "log")
    assert latest(spark, log) is None
    assert publish(spark, log, 3, {"a": 1}) and not publish(spark, log, 3, {"a": 2})
    assert publish(spark, log, 12, {"b": [1, "x"]})
    assert numbers(spark, log) == [3, 12]
    assert latest(spark, log) == (12, {"b": [1, "x"]}) and commit(spark, log, 3) == {"a": 1}
