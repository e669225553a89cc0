"""Metric operators over ``events``: event types are metrics, users are hosts."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labspark.functions.labels import merge_labels
from labspark.operators import metrics as M
from labspark.session import scratch_path
from labspark.sources import rollups
from labspark.workload.registry import query, table

DAY = timedelta(days=1)
SERIES = ["metric", "host"]


def samples(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("event_type").alias("metric"),
        F.col("user_id").alias("host"),
        "ts",
        "value",
        F.col("event_id").alias("sample_id"),
    )


SAMPLES = "SELECT event_type AS metric, user_id AS host, ts, value, event_id AS sample_id FROM events"

INCREASES = f"""
SELECT *, CASE WHEN prev IS NULL THEN 0.0 WHEN value < prev THEN value ELSE value - prev END AS increase
FROM (SELECT *, lag(value) OVER (PARTITION BY metric, host ORDER BY ts, sample_id) AS prev FROM ({SAMPLES}))"""

RATES = f"""
SELECT *, sum(increase) OVER (PARTITION BY metric, host ORDER BY ts
    RANGE BETWEEN INTERVAL '86399.999999 seconds' PRECEDING AND CURRENT ROW) / 86400.0 AS rate
FROM ({INCREASES})"""


@query(
    "metric_select",
    "SELECT event_id AS sample_id, ts, value, user_id::varchar AS host_name FROM events WHERE event_type = 'error'",
)
def metric_select(spark: SparkSession, sf: str) -> DataFrame:
    labels = F.create_map(F.lit("state"), F.col("event_type"), F.lit("host_name"), F.col("user_id").cast("string"))
    labelled = table(spark, sf, "events").select(
        F.lit("events_total").alias("metric"), labels.alias("labels"), F.col("event_id").alias("sample_id"), "ts", "value"
    )
    found = M.promote_labels(M.select_metric(labelled, "events_total", {"state": "error"}), ["host_name"])
    return found.select("sample_id", "ts", "value", "host_name")


@query(
    "relative_range",
    """SELECT event_id AS sample_id, event_type AS metric, ts, value FROM events
       WHERE ts > (SELECT max(ts) - INTERVAL 1 DAY FROM events)""",
)
def relative_range(spark: SparkSession, sf: str) -> DataFrame:
    return M.relative_range(samples(spark, sf), DAY).select("sample_id", "metric", "ts", "value")


@query(
    "retention_split",
    """SELECT ts < (SELECT max(ts) - INTERVAL 7 DAY FROM events) AS expired, event_type AS metric,
              count(*) AS n_samples, min(ts) AS first_ts, max(ts) AS last_ts
       FROM events GROUP BY 1, 2""",
)
def retention_split(spark: SparkSession, sf: str) -> DataFrame:
    return (
        M.retention_split(samples(spark, sf), timedelta(days=7))
        .groupBy("expired", "metric")
        .agg(F.count(F.lit(1)).alias("n_samples"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    )


@query(
    "counter_increase",
    f"SELECT sample_id, metric, host, ts, round(increase, 6) AS increase FROM ({INCREASES})",
)
def counter_increase(spark: SparkSession, sf: str) -> DataFrame:
    grown = M.counter_increase(samples(spark, sf), SERIES, tie="sample_id")
    return grown.select("sample_id", "metric", "host", "ts", F.round("increase", 6).alias("increase"))


@query(
    "counter_rate",
    f"SELECT sample_id, metric, host, ts, round(rate, 9) AS rate FROM ({RATES})",
)
def counter_rate(spark: SparkSession, sf: str) -> DataFrame:
    rates = M.counter_rate(samples(spark, sf), SERIES, DAY, tie="sample_id")
    return rates.select("sample_id", "metric", "host", "ts", F.round("rate", 9).alias("rate"))


@query(
    "cpu_busy_pct",
    f"""SELECT date_trunc('day', ts)::timestamp AS step, host, round(100.0 - avg(rate) * 100.0, 9) AS busy_pct
        FROM ({RATES}) WHERE metric IN ('view', 'click') GROUP BY 1, 2""",
)
def cpu_busy_pct(spark: SparkSession, sf: str) -> DataFrame:
    idle = samples(spark, sf).where(F.col("metric").isin("view", "click"))
    busy = M.busy_percent(idle, "host", SERIES, DAY, DAY, tie="sample_id")
    return busy.select("step", "host", F.round("busy_pct", 9).alias("busy_pct"))


@query(
    "gauge_last_per_step",
    f"""SELECT metric, host, date_trunc('day', ts)::timestamp AS step, arg_max(value, (ts, sample_id)) AS value
        FROM ({SAMPLES}) GROUP BY 1, 2, 3""",
)
def gauge_last_per_step(spark: SparkSession, sf: str) -> DataFrame:
    return M.last_per_step(samples(spark, sf), SERIES, DAY, tie="sample_id")


@query(
    "series_mean_max",
    f"""SELECT metric, host, round(avg(value), 9) AS mean, max(value) AS "max" FROM ({SAMPLES}) GROUP BY 1, 2""",
)
def series_mean_max(spark: SparkSession, sf: str) -> DataFrame:
    stats = M.series_mean_max(samples(spark, sf), SERIES)
    return stats.select("metric", "host", F.round("mean", 9).alias("mean"), "max")


@query(
    "multi_target_panel",
    f"""SELECT sample_id, ts, host || ' ' || CASE metric WHEN 'click' THEN 'read' ELSE 'write' END AS legend,
               round(rate, 9) AS rate
        FROM ({RATES}) WHERE metric IN ('click', 'purchase')""",
)
def multi_target_panel(spark: SparkSession, sf: str) -> DataFrame:
    panel = M.panel_targets(samples(spark, sf), {"click": "read", "purchase": "write"}, "host")
    rates = M.counter_rate(panel, SERIES, DAY, tie="sample_id")
    return rates.select("sample_id", "ts", "legend", F.round("rate", 9).alias("rate"))


@query(
    "load_pivot",
    f"""SELECT host, date_trunc('day', ts)::timestamp AS step,
               arg_max(value, (ts, sample_id)) FILTER (metric = 'click') AS load_1m,
               arg_max(value, (ts, sample_id)) FILTER (metric = 'view') AS load_5m,
               arg_max(value, (ts, sample_id)) FILTER (metric = 'signup') AS load_15m
        FROM ({SAMPLES}) WHERE metric IN ('click', 'view', 'signup') GROUP BY 1, 2""",
)
def load_pivot(spark: SparkSession, sf: str) -> DataFrame:
    stepped = samples(spark, sf).withColumn("step", M.step_start("ts", DAY))
    return M.side_by_side(
        stepped,
        ["host", "step"],
        {"click": "load_1m", "view": "load_5m", "signup": "load_15m"},
        tie="sample_id",
    )


HOUR = timedelta(hours=1)


def rolled_up(spark: SparkSession, sf: str) -> str:
    """A store of hourly and daily partials, filled by three arrivals whose times overlap and folded after the second."""
    path = scratch_path(spark, "rollup")
    rows = samples(spark, sf)
    for batch in range(3):
        arrival = rows.where(F.pmod("sample_id", F.lit(3)) == batch)
        rollups.add_samples(arrival, path, batch, SERIES, [HOUR, DAY], tie="sample_id")
        if batch == 1:
            rollups.fold(spark, path, SERIES)
    return path


@query(
    "rollup_mean_max",
    f"""SELECT metric, host, round(avg(value), 9) AS mean, max(value) AS "max" FROM ({SAMPLES}) GROUP BY 1, 2""",
)
def rollup_mean_max(spark: SparkSession, sf: str) -> DataFrame:
    daily = rollups.read_rollup(spark, rolled_up(spark, sf), DAY, SERIES)
    return rollups.mean_max(daily, SERIES).select("metric", "host", F.round("mean", 9).alias("mean"), "max")


RANGE = (datetime(2024, 1, 3, 5), datetime(2024, 1, 20, 17))


@query(
    "rollup_range",
    f"""SELECT metric, host, round(avg(value), 9) AS mean, max(value) AS "max" FROM ({SAMPLES})
        WHERE ts >= TIMESTAMP '{RANGE[0]}' AND ts < TIMESTAMP '{RANGE[1]}' GROUP BY 1, 2""",
)
def rollup_range(spark: SparkSession, sf: str) -> DataFrame:
    """Whole days from the daily steps, the hours at both ends from the hourly ones."""
    mixed = rollups.read_range(spark, rolled_up(spark, sf), *RANGE)
    return rollups.mean_max(mixed, SERIES).select("metric", "host", F.round("mean", 9).alias("mean"), "max")


@query(
    "rollup_load_pivot",
    f"""SELECT host, date_trunc('day', ts)::timestamp AS step,
               arg_max(value, (ts, sample_id)) FILTER (metric = 'click') AS load_1m,
               arg_max(value, (ts, sample_id)) FILTER (metric = 'view') AS load_5m,
               arg_max(value, (ts, sample_id)) FILTER (metric = 'signup') AS load_15m
        FROM ({SAMPLES}) WHERE metric IN ('click', 'view', 'signup') GROUP BY 1, 2""",
)
def rollup_load_pivot(spark: SparkSession, sf: str) -> DataFrame:
    daily = rollups.read_rollup(spark, rolled_up(spark, sf), DAY, SERIES)
    return rollups.last_values(daily, ["host", "step"], {"click": "load_1m", "view": "load_5m", "signup": "load_15m"})


@query(
    "label_merge",
    """SELECT event_id AS sample_id, u.label, u.value FROM (
         SELECT event_id, [
           {'label': 'k', 'value': json_extract_string(props, '$.k')},
           {'label': 'host', 'value': 'host-' || user_id},
           {'label': 'kind', 'value': event_type}] AS labels FROM events), UNNEST(labels) AS t(u)""",
)
def label_merge(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    own = F.create_map(
        F.lit("k"), F.get_json_object("props", "$.k"), F.lit("host"), F.col("user_id").cast("string")
    )
    resource = F.create_map(
        F.lit("host"), F.concat(F.lit("host-"), F.col("user_id").cast("string")), F.lit("kind"), F.col("event_type")
    )
    merged = events.select(F.col("event_id").alias("sample_id"), merge_labels(own, resource).alias("labels"))
    return merged.select("sample_id", F.explode("labels").alias("label", "value"))


@query(
    "target_label_join",
    """SELECT s_name || ':9100' AS target, s_name AS instance, n_name AS rack, r_name AS datacenter
       FROM supplier LEFT JOIN (SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey)
         ON s_nationkey = n_nationkey""",
)
def target_label_join(spark: SparkSession, sf: str) -> DataFrame:
    places = table(spark, sf, "nation").join(
        table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    labels = places.select(F.col("n_nationkey").alias("place"), "n_name", "r_name")
    hosts = table(spark, sf, "supplier").withColumnRenamed("s_nationkey", "place")
    return M.label_targets(
        hosts, labels, "place", "s_name", 9100, {"instance": "s_name", "rack": "n_name", "datacenter": "r_name"}
    )
