"""Streams over the test tables: each runs over all there is and the stored rows are read back."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from datetime import timedelta

import pandas as pd
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labspark.session import scratch_path, visible_to_workers
from labspark.sources import files
from labspark.sources.tail import tail
from labspark.streaming import events as SE
from labspark.streaming import compaction as SC
from labspark.streaming import logs as SL
from labspark.streaming import metrics as SM
from labspark.streaming import state as SK
from labspark.streaming.batches import appended, newest_update, stored
from labspark.workload.logs import BODY, PARSED, log_records
from labspark.workload.metrics import INCREASES, SAMPLES, SERIES
from labspark.workload.registry import ORACLES, query

DAY = timedelta(days=1)
SAMPLE_SCHEMA = T.StructType(
    [
        T.StructField("metric", T.StringType()),
        T.StructField("host", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("sample_id", T.LongType()),
    ]
)


def sample_stream(spark: SparkSession, sf: str) -> DataFrame:
    return named_samples(SM.table_stream(spark, f"{sf}/events.parquet"))


def named_samples(rows: DataFrame) -> DataFrame:
    return rows.select(
        F.col("event_type").alias("metric"),
        F.col("user_id").alias("host"),
        "ts",
        "value",
        F.col("event_id").alias("sample_id"),
    )


def arriving_samples(spark: SparkSession, sf: str, parts: int = 4) -> Iterator[DataFrame]:
    """The same samples as a table that grows: before each stream given, the next part, an equal span of time, is added."""
    path = scratch_path(spark, "arriving")
    rows = spark.read.parquet(f"{sf}/events.parquet")
    first, last = rows.agg(F.min("ts"), F.max("ts")).first()
    for i in range(parts):
        start, end = (first + (last - first) * k / parts for k in (i, i + 1))
        part = rows.where((F.col("ts") >= F.lit(start)) & ((F.col("ts") < F.lit(end)) | F.lit(i + 1 == parts)))
        part.write.mode("append").parquet(path)
        yield named_samples(SM.table_stream(spark, path))


@query(
    "metric_ingest_stream",
    f"SELECT metric, host, ts, value, sample_id FROM ({SAMPLES})",
)
def metric_ingest_stream(spark: SparkSession, sf: str) -> DataFrame:
    base = scratch_path(spark, "ingest")
    SM.ingest(sample_stream(spark, sf), f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return appended(spark, f"{base}/out", SAMPLE_SCHEMA)


@query(
    "stream_gauge_step",
    f"""SELECT metric, host, date_trunc('day', ts)::timestamp AS step, arg_max(value, (ts, sample_id)) AS value
        FROM ({SAMPLES}) GROUP BY 1, 2, 3""",
)
def stream_gauge_step(spark: SparkSession, sf: str) -> DataFrame:
    base = scratch_path(spark, "gauge")
    steps = SM.gauge_steps(sample_stream(spark, sf), SERIES, DAY, DAY, tie="sample_id")
    SM.run_gauge_steps(steps, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    rows = stored(spark, f"{base}/out", steps.schema)
    newest = newest_update(rows, [*SERIES, "step"])
    return newest.select(*SERIES, F.col("step").cast("timestamp_ntz").alias("step"), "value")


@query(
    "stream_counter_rate",
    f"""SELECT metric, host, date_trunc('day', ts)::timestamp AS step, round(sum(increase) / 86400.0, 9) AS rate
        FROM ({INCREASES}) GROUP BY 1, 2, 3""",
)
def stream_counter_rate(spark: SparkSession, sf: str) -> DataFrame:
    return counter_rates(spark, [sample_stream(spark, sf)])


@query("stream_counter_batches", ORACLES["stream_counter_rate"])
def stream_counter_batches(spark: SparkSession, sf: str) -> DataFrame:
    """The stream started anew for each part that has arrived: last values are carried from run to run."""
    return counter_rates(spark, arriving_samples(spark, sf))


def counter_rates(spark: SparkSession, streams: Iterable[DataFrame]) -> DataFrame:
    base = scratch_path(spark, "counter")
    for samples in streams:
        run = SM.run_counter_increase(samples, SERIES, f"{base}/out", f"{base}/state", f"{base}/checkpoint")
        run.awaitTermination()
    schema = T.StructType([*SAMPLE_SCHEMA.fields, T.StructField("increase", T.DoubleType())])
    rates = SM.step_rates(stored(spark, f"{base}/out", schema), SERIES, DAY)
    return rates.select(*SERIES, "step", F.round("rate", 9).alias("rate"))


def run_events(samples: DataFrame) -> DataFrame:
    """Samples as the output of five runs."""
    kind = (
        F.when(F.col("metric") == "error", "error").when(F.col("metric") == "purchase", "message").otherwise("frame")
    )
    return samples.select(
        F.concat(F.lit("run"), F.col("host") % 5).alias("run_id"),
        F.col("sample_id").alias("seq"),
        kind.alias("event_type"),
        "ts",
        F.concat("metric", F.lit("\r\n  "), F.col("sample_id").cast("string"), F.lit("\x1b[0m")).alias("message"),
    )


@query(
    "stream_event_route",
    """WITH e AS (SELECT 'run' || (user_id % 5) AS run_id, event_id AS seq,
                  CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'message' ELSE 'frame' END AS event_type,
                  event_type || ' ' || event_id AS message FROM events),
       f AS (SELECT run_id, seq, row_number() OVER (PARTITION BY run_id ORDER BY seq) AS n FROM e WHERE event_type = 'frame')
       SELECT run_id, seq, event_type, CASE event_type WHEN 'error' THEN 'ERROR: ' ELSE '' END || message AS message
       FROM e WHERE event_type <> 'frame'
       UNION ALL SELECT run_id, seq, 'message', 'Docker container activity: ' || n || ' frames processed' FROM f
       WHERE n % 100 = 0""",
)
def stream_event_route(spark: SparkSession, sf: str) -> DataFrame:
    base = scratch_path(spark, "route")
    events = run_events(sample_stream(spark, sf))
    SE.run_event_route(events, f"{base}/out", f"{base}/state", f"{base}/checkpoint").awaitTermination()
    schema = T.StructType.fromDDL("run_id string, seq bigint, event_type string, message string")
    return stored(spark, f"{base}/out", schema).drop("batch")


@query(
    "stream_logs",
    f"""SELECT event_id, component, 'clickhouse' AS database, NOT json_valid(body) AS malformed, k FROM (
          SELECT *, event_id AS id FROM {PARSED})""",
)
def stream_logs(spark: SparkSession, sf: str) -> DataFrame:
    base = scratch_path(spark, "log-stream")
    lines = log_records(spark, sf)
    tagged = lines.select("component", F.concat_ws("|", F.col("event_id").cast("string"), "body").alias("value"))
    tagged.hint("rebalance", "component").write.partitionBy("component").text(f"{base}/in")
    raw = files.log_stream(spark, f"{base}/in", "part-*").select(
        F.substring_index("body", "|", 1).cast("bigint").alias("event_id"),
        F.regexp_replace("body", "^[0-9]+\\|", "").alias("body"),
        F.regexp_extract("file_path", "component=([^/]+)/", 1).alias("component"),
    )
    records = SL.log_records(raw, BODY, {"database": "clickhouse"})
    SL.run_logs(records, f"{base}/out", f"{base}/checkpoint", every=None).awaitTermination()
    return appended(spark, f"{base}/out", records.schema).select(
        "event_id", "component", "database", "malformed", "parsed.k"
    )


@query(
    "stream_fanout",
    """SELECT 'console' AS sink, count(*) AS n_rows, sum(event_id)::bigint AS id_sum FROM events
       UNION ALL SELECT 'errors', count(*), sum(event_id)::bigint FROM events WHERE event_type = 'error'
       UNION ALL SELECT 'rest', count(*), sum(event_id)::bigint FROM events WHERE event_type <> 'error'""",
)
def stream_fanout(spark: SparkSession, sf: str) -> DataFrame:
    base = scratch_path(spark, "fanout")
    is_error = F.col("metric") == "error"
    sinks = {
        "console": (F.lit(True), f"{base}/console"),
        "errors": (is_error, f"{base}/errors"),
        "rest": (~is_error, f"{base}/rest"),
    }
    SL.run_fan_out(sample_stream(spark, sf), sinks, f"{base}/checkpoint", f"{base}/commits").awaitTermination()
    parts = [
        SL.committed_batches(spark, path, SAMPLE_SCHEMA, f"{base}/commits").select(F.lit(name).alias("sink"), "sample_id")
        for name, (_, path) in sinks.items()
    ]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rows.groupBy("sink").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("sample_id").alias("id_sum"))


def shuffled_samples(spark: SparkSession, sf: str, parts: int = 4) -> tuple[timedelta, Iterator[DataFrame]]:
    """A growing table again, but samples come in any order: with the part of their time or, by a hash, with the next one.

    Last comes a row that is no sample and lies far ahead. Also how late a sample can be.
    """
    path = scratch_path(spark, "shuffled")
    rows = spark.read.parquet(f"{sf}/events.parquet")
    first, last = rows.agg(F.min("ts"), F.max("ts")).first()
    length = (last - first) / parts + timedelta(seconds=1)
    of_time = sum((F.col("ts") >= F.lit(first + i * length)).cast("int") for i in range(1, parts))
    arrival = F.least(of_time + F.pmod(F.xxhash64("event_id"), F.lit(2)), F.lit(parts - 1))
    placed = rows.withColumn("_arrival", arrival)

    def streams() -> Iterator[DataFrame]:
        for i in range(parts):
            part = placed.where(F.col("_arrival") == i).drop("_arrival")
            part.orderBy(F.xxhash64("event_id")).write.mode("append").parquet(path)
            yield named_samples(SM.table_stream(spark, path))
        ahead = [F.lit(last + 3 * length) if c == "ts" else F.lit(None) for c in rows.columns]
        spark.range(1).select(*[a.cast(f.dataType).alias(f.name) for a, f in zip(ahead, rows.schema)]).write.mode("append").parquet(path)
        yield named_samples(SM.table_stream(spark, path))

    return length, streams()


@query("stream_trailing_rate", ORACLES["counter_rate"])
def stream_trailing_rate(spark: SparkSession, sf: str) -> DataFrame:
    """The trailing rate of late samples over several runs, each with the state of the one before."""
    base = scratch_path(spark, "trailing")
    late, streams = shuffled_samples(spark, sf)
    for samples in streams:
        rates = SK.trailing_rates(samples, SERIES, DAY, late)
        SK.run_trailing_rates(rates, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    rows = appended(spark, f"{base}/out", rates.schema)
    return rows.select("sample_id", "metric", "host", "ts", F.round("rate", 9).alias("rate"))


@query("stream_keyed_route", ORACLES["stream_event_route"])
def stream_keyed_route(spark: SparkSession, sf: str) -> DataFrame:
    """The same messages with the runs' counts in a keyed store, over a table that grows."""
    base = scratch_path(spark, "keyed-route")
    for samples in arriving_samples(spark, sf):
        shown = SK.routed_events(run_events(samples), timedelta(hours=1))
        SK.run_routed_events(shown, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return appended(spark, f"{base}/out", shown.schema)


LINES_PER_FILE = 20_000


def grow_files(lines: DataFrame, folder: str, part: int) -> int:
    """Write the lines of the parts up to ``part`` to their files, and the first half of the line that comes next.

    A task that runs again writes the same bytes. How many lines are whole.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = pyarrow.fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        name, file, whole, cut = None, None, 0, False
        for batch in batches:
            for row_file, row_part, value in zip(batch["file"], batch["part"], batch["value"]):
                if row_file != name:
                    if file is not None:
                        file.close()
                    name, file, cut = row_file, store.open_output_stream(f"{root}/{row_file}"), False
                data = value.encode()
                if row_part <= part:
                    file.write(data + b"\n")
                    whole += 1
                elif not cut:
                    file.write(data[: len(data) // 2])
                    cut = True
        if file is not None:
            file.close()
        yield pd.DataFrame({"whole": [whole]})

    visible_to_workers(lines.sparkSession)
    sorted_lines = lines.where(F.col("part") <= part + 1).repartition("file").sortWithinPartitions("file", "part", "event_id")
    return sorted_lines.mapInPandas(write, "whole long").agg(F.sum("whole")).first()[0] or 0


@query(
    "stream_log_tail",
    f"""WITH lines AS (SELECT event_id, component, NOT json_valid(body) AS malformed, k, event_id % 3 AS part
                       FROM (SELECT *, event_id AS id FROM {PARSED}))
        SELECT 'beginning' AS start_at, event_id, component, malformed, k FROM lines
        UNION ALL SELECT 'end', event_id, component, malformed, k FROM lines WHERE part > 0""",
)
def stream_log_tail(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of files that grow between three runs; a second stream starts where the files end at first."""
    base, parts = scratch_path(spark, "log-tail"), 3
    records = log_records(spark, sf)
    shards = records.count() // LINES_PER_FILE + 1
    file = F.format_string("%s-%d.log", "component", F.pmod(F.col("event_id"), F.lit(shards)))
    value = F.concat_ws("|", F.col("event_id").cast("string"), "body")
    lines = records.select(file.alias("file"), (F.col("event_id") % parts).alias("part"), "event_id", value.alias("value"))
    tails = {}
    for part in range(parts):
        grow_files(lines, f"{base}/in", part)
        for start_at in ("beginning", "end"):
            raw = tail(spark, f"{base}/in", start_at=start_at)
            named = raw.select(
                F.substring_index("body", "|", 1).cast("bigint").alias("event_id"),
                F.regexp_replace("body", "^[0-9]+\\|", "").alias("body"),
                F.regexp_extract("file_name", "^(.*)-[0-9]+[.]log$", 1).alias("component"),
            )
            found = SL.log_records(named, BODY, {})
            SL.run_logs(found, f"{base}/{start_at}", f"{base}/checkpoint-{start_at}", every=None).awaitTermination()
            tails[start_at] = found.schema
    sides = [
        appended(spark, f"{base}/{name}", schema).select(F.lit(name).alias("start_at"), "event_id", "component", "malformed", "parsed.k")
        for name, schema in tails.items()
    ]
    return sides[0].unionByName(sides[1])


@query("stream_gauge_compacted", ORACLES["stream_gauge_step"])
def stream_gauge_compacted(spark: SparkSession, sf: str) -> DataFrame:
    """Gauge steps of a table that grows, the store compacted behind the watermark after each arrival."""
    base = scratch_path(spark, "compacted")
    for samples in arriving_samples(spark, sf):
        steps = SM.gauge_steps(samples, SERIES, DAY, DAY, tie="sample_id")
        run = SM.run_gauge_steps(steps, f"{base}/out", f"{base}/checkpoint")
        run.awaitTermination()
        SC.compact_steps(spark, f"{base}/out", steps.schema, [*SERIES, "step"], SC.watermark_of(run), DAY)
    rows = SC.read_steps(spark, f"{base}/out", steps.schema, [*SERIES, "step"])
    return rows.select(*SERIES, F.col("step").cast("timestamp_ntz").alias("step"), "value")
