from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labspark.operators import metrics as M
from labspark.operators.logs import daily_index
from labspark.sources import files
from labspark.sources.tables import read_daily_index
from labspark.streaming import events as SE
from labspark.streaming import logs as SL
from labspark.streaming import metrics as SM
from labspark.streaming.batches import appended, newest_update, store_batch, stored
from labspark.workload import QUERIES

START = datetime(2024, 1, 1)
SCHEMA = "metric string, host string, sample_id bigint, ts timestamp_ntz, value double"
SERIES = ["metric", "host"]


def put(spark, rows, folder, schema=SCHEMA):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def sample(i, host, seconds, value):
    return ("m", host, i, START + timedelta(seconds=seconds), float(value))


@pytest.mark.parametrize("target_rows", [1_000_000, 4])
def test_counter_stream_equals_batch_over_several_runs(spark, tmp_path, target_rows):
    source, out, state, checkpoint = (str(tmp_path / n) for n in ("in", "out", "state", "checkpoint"))
    rows = [sample(i, "a" if i % 3 else "b", i * 10, (i * 37) % 50) for i in range(60)]
    schema = T.StructType.fromDDL(SCHEMA)
    for start in (0, 25, 31):
        put(spark, rows[start : {0: 25, 25: 31, 31: 60}[start]], source)
        stream = SM.sample_stream(spark, source, schema, files_per_batch=1)
        SM.run_counter_increase(stream, SERIES, out, state, checkpoint, target_rows=target_rows).awaitTermination()
    late = sample(99, "a", 5, 1000)
    put(spark, [late], source)
    stream = SM.sample_stream(spark, source, schema)
    SM.run_counter_increase(stream, SERIES, out, state, checkpoint).awaitTermination()
    full = T.StructType([*schema.fields, T.StructField("increase", T.DoubleType())])
    got = {r["sample_id"]: r["increase"] for r in stored(spark, out, full).collect()}
    want = M.counter_increase(spark.createDataFrame(rows, SCHEMA), SERIES, tie="sample_id").collect()
    assert got == {r["sample_id"]: r["increase"] for r in want}
    rates = SM.step_rates(stored(spark, out, full), SERIES, timedelta(seconds=100)).agg(F.sum("rate")).first()[0]
    assert rates == pytest.approx(sum(got.values()) / 100)


def test_gauge_stream_equals_batch_and_drops_late_rows(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    rows = [sample(i, "a" if i % 2 else "b", i * 7, i) for i in range(40)]
    schema = T.StructType.fromDDL(SCHEMA)

    def run():
        steps = SM.gauge_steps(
            SM.sample_stream(spark, source, schema), SERIES, timedelta(seconds=30), timedelta(seconds=60), tie="sample_id"
        )
        SM.run_gauge_steps(steps, out, checkpoint).awaitTermination()
        return steps.schema

    put(spark, rows[:25], source)
    run()
    put(spark, rows[25:], source)
    run()
    put(spark, [sample(99, "a", 1, 777), sample(100, "z", 300, 1)], source)
    found = newest_update(stored(spark, out, run()), [*SERIES, "step"])
    want = M.last_per_step(
        spark.createDataFrame([*rows, sample(100, "z", 300, 1)], SCHEMA), SERIES, timedelta(seconds=30), tie="sample_id"
    )
    as_rows = lambda df: sorted((r["host"], str(r["step"]), r["value"]) for r in df.collect())
    assert as_rows(found) == as_rows(want)


def test_each_log_line_is_delivered_once(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    schema = T.StructType([T.StructField("level", T.StringType())])

    def drain():
        lines = files.log_stream(spark, str(source))
        records = SL.log_records(lines, schema, {"database": "clickhouse", "component": "server"}, F.lit("db0"))
        SL.run_logs(records, out, checkpoint, every=None).awaitTermination()
        return appended(spark, out, records.schema)

    (source / "a.log").write_text('{"level": "Error"}\nnot json\n')
    first = drain()
    assert sorted((r["parsed"]["level"] or "", r["malformed"]) for r in first.collect()) == [("", True), ("Error", False)]
    assert {(r["host_name"], r["component"], r["file_name"]) for r in first.collect()} == {("db0", "server", "a.log")}
    (source / "b.log").write_text('{"level": "Warning"}\n')
    lines = ["not json", '{"level": "Error"}', '{"level": "Warning"}']
    assert sorted(r["body"] for r in drain().collect()) == sorted(lines)
    assert sorted(r["body"] for r in drain().collect()) == sorted(lines)


def test_a_daily_index_can_be_fed_by_a_stream(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    put(spark, [sample(i, "h", i * 40_000, i) for i in range(6)], source)
    stream = SM.sample_stream(spark, source, T.StructType.fromDDL(SCHEMA)).withColumn("index", daily_index(F.col("ts")))
    SL.run_logs(stream, out, str(tmp_path / "checkpoint"), every=None, partition_by=["index"]).awaitTermination()
    day = read_daily_index(spark, out, since="logs-otel-2024.01.02")
    assert sorted(r["sample_id"] for r in day.collect()) == [3, 4, 5]


def test_old_files_are_left_out_when_starting_at_the_end(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.log").write_text("old\n")
    lines = files.log_stream(spark, str(source), since=datetime(2999, 1, 1))
    out = str(tmp_path / "out")
    SL.run_logs(lines, out, str(tmp_path / "checkpoint"), every=None).awaitTermination()
    assert appended(spark, out, lines.schema).count() == 0


def test_event_stream_carries_counts_between_runs(spark, tmp_path):
    source, out, state, checkpoint = (str(tmp_path / n) for n in ("in", "out", "state", "checkpoint"))
    schema = "run_id string, seq bigint, event_type string, message string"

    def run():
        stream = SM.sample_stream(spark, source, T.StructType.fromDDL(schema))
        SE.run_event_route(stream, out, state, checkpoint, target_rows=30).awaitTermination()

    put(spark, [("r", i, "frame", None) for i in range(150)] + [("s", 0, "message", "hi")], source, schema)
    run()
    put(spark, [("r", i, "frame", None) for i in range(150, 220)] + [("r", 220, "close", None)], source, schema)
    run()
    put(spark, [("r", 221, "error", "late"), ("s", 1, "error", "x")], source, schema)
    run()
    rows = stored(spark, out, T.StructType.fromDDL(schema)).collect()
    assert sorted((r["run_id"], r["seq"], r["message"]) for r in rows) == [
        ("r", 99, "Docker container activity: 100 frames processed"),
        ("r", 199, "Docker container activity: 200 frames processed"),
        ("s", 0, "hi"),
        ("s", 1, "ERROR: x"),
    ]


def test_a_batch_that_runs_again_leaves_no_doubles(spark, tmp_path):
    df = spark.createDataFrame([(1,), (2,)], "id int")
    for _ in range(2):
        store_batch(df, str(tmp_path / "out"), 0)
    store_batch(df, str(tmp_path / "out"), 1)
    assert stored(spark, str(tmp_path / "out"), df.schema).count() == 4
    assert stored(spark, str(tmp_path / "none"), df.schema).count() == 0


def test_fan_out(spark, tmp_path):
    source, commits = str(tmp_path / "in"), str(tmp_path / "commits")
    put(spark, [sample(i, "h", i, i) for i in range(10)], source)
    stream = SM.sample_stream(spark, source, T.StructType.fromDDL(SCHEMA))
    sinks = {"all": (F.lit(True), str(tmp_path / "all")), "high": (F.col("value") > 6, str(tmp_path / "high"))}
    SL.run_fan_out(stream, sinks, str(tmp_path / "checkpoint"), commits).awaitTermination()
    assert [SL.committed_batches(spark, path, stream.schema, commits).count() for _, path in sinks.values()] == [10, 3]


def test_a_failure_between_two_sinks_shows_no_half_batch(spark, tmp_path, monkeypatch):
    source, commits, checkpoint = (str(tmp_path / n) for n in ("in", "commits", "checkpoint"))
    schema = T.StructType.fromDDL(SCHEMA)
    sinks = {"all": (F.lit(True), str(tmp_path / "all")), "high": (F.col("value") > 6, str(tmp_path / "high"))}
    real = SL.store_batch

    def run():
        SL.run_fan_out(SM.sample_stream(spark, source, schema), sinks, checkpoint, commits).awaitTermination()

    def counts():
        return [SL.committed_batches(spark, path, schema, commits).count() for _, path in sinks.values()]

    def dies(df, path, batch_id):
        if path.endswith("high"):
            raise RuntimeError("sink gone")
        real(df, path, batch_id)

    assert counts() == [0, 0]
    put(spark, [sample(i, "h", i, i) for i in range(10)], source)
    run()
    put(spark, [sample(i, "h", i, i) for i in range(10, 15)], source)
    monkeypatch.setattr(SL, "store_batch", dies)
    with pytest.raises(Exception, match="sink gone"):
        run()
    assert stored(spark, sinks["all"][1], schema).count() == 15
    assert counts() == [10, 3]
    monkeypatch.setattr(SL, "store_batch", real)
    run()
    assert counts() == [15, 8]
    # Committed, but not in the stream's own log: the batch runs again and changes nothing.
    (tmp_path / "checkpoint" / "commits" / "1").unlink()
    (tmp_path / "checkpoint" / "commits" / ".1.crc").unlink(missing_ok=True)
    monkeypatch.setattr(SL, "store_batch", dies)
    run()
    assert counts() == [15, 8]


def test_a_stream_that_dies_after_writing_goes_on_without_doubles(spark, tmp_path, monkeypatch):
    source, out, state, checkpoint = (str(tmp_path / n) for n in ("in", "out", "state", "checkpoint"))
    schema = T.StructType.fromDDL(SCHEMA)
    rows = [sample(i, "a", i * 10, (i * 37) % 50) for i in range(30)]
    real = SM.Carried.after

    def run():
        stream = SM.sample_stream(spark, source, schema)
        SM.run_counter_increase(stream, SERIES, out, state, checkpoint).awaitTermination()

    def dies(self, df, batch_id):
        real(self, df, batch_id)
        raise RuntimeError("executor gone")

    put(spark, rows[:10], source)
    run()
    put(spark, rows[10:], source)
    monkeypatch.setattr(SM.Carried, "after", dies)
    with pytest.raises(Exception, match="executor gone"):
        run()
    monkeypatch.setattr(SM.Carried, "after", real)
    run()
    full = T.StructType([*schema.fields, T.StructField("increase", T.DoubleType())])
    got = [(r["sample_id"], r["increase"]) for r in stored(spark, out, full).collect()]
    want = M.counter_increase(spark.createDataFrame(rows, SCHEMA), SERIES, tie="sample_id").collect()
    assert sorted(got) == sorted((r["sample_id"], r["increase"]) for r in want)


STREAM_QUERIES = ["metric_ingest_stream", "stream_gauge_step", "stream_counter_rate", "stream_event_route", "stream_fanout"]


@pytest.mark.parametrize("name", STREAM_QUERIES)
def test_a_table_may_be_a_folder(spark, sf, tmp_path, name):
    """The same rows from one file and from a folder of part files."""
    spark.read.parquet(f"{sf}/events.parquet").repartition(5).write.parquet(f"{tmp_path}/events.parquet")
    one, many = (sorted(map(str, QUERIES[name](spark, place).collect())) for place in (sf, str(tmp_path)))
    assert one == many and one


def test_a_missing_table_fails(spark, tmp_path):
    with pytest.raises(Exception, match="does not exist"):
        SM.table_stream(spark, f"{tmp_path}/none.parquet")
