"""Rollup stores: partial aggregates of samples per series and time step, at several step widths.

Each arrival of samples adds its own partials, so late samples need no rewrite: reading merges all partials of a step. A commit
log names the folders that count. Folding merges them into one.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labspark.operators.metrics import step_start
from labspark.sources import commits

EPOCH = datetime(1970, 1, 1)
PARTIALS = ("n", "total", "largest", "last")


def _seconds(width: timedelta) -> int:
    return int(width.total_seconds())


def _checked(widths: Sequence[timedelta]) -> list[timedelta]:
    rising = sorted(widths)
    for fine, wide in zip(rising, rising[1:]):
        if wide % fine:
            raise ValueError(f"{wide} is no multiple of {fine}")
    if not rising or rising[0] < timedelta(seconds=1) or any(width.microseconds for width in rising):
        raise ValueError("widths are whole seconds, at least one")
    return rising


def partials(
    df: DataFrame,
    series: Sequence[str],
    width: timedelta,
    ts: str = "ts",
    value: str = "value",
    tie: str | None = None,
) -> DataFrame:
    """Samples as partial aggregates per series and step: ``n`` and ``total`` of the values that are not null, the
    ``largest``, and ``last``, the sample of the highest time and tie. Samples without a time have no step and are left out.
    """
    at = F.struct(F.col(ts).alias("ts"), (F.col(tie) if tie else F.lit(0)).alias("tie"), F.col(value).alias("value"))
    return (
        df.where(F.col(ts).isNotNull())
        .groupBy(*series, step_start(ts, width).alias("step"))
        .agg(
            F.count(value).alias("n"),
            F.sum(value).alias("total"),
            F.max(value).alias("largest"),
            F.max(at).alias("last"),
        )
    )


def merged(df: DataFrame, by: Sequence[str | Column]) -> DataFrame:
    """Partials merged by the given columns; the result is partials again."""
    return df.groupBy(*by).agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("largest").alias("largest"), F.max("last").alias("last")
    )


def _widened(df: DataFrame, series: Sequence[str], width: timedelta) -> DataFrame:
    return merged(df, [*series, step_start("step", width).alias("step")])


def _write(df: DataFrame, path: str) -> DataFrame:
    """Steps in order within files, so that a range of time skips row groups."""
    df.sortWithinPartitions("step").write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _state(spark: SparkSession, path: str) -> tuple[int, dict]:
    found = commits.latest(spark, f"{path}/log")
    return found if found else (-1, {"batch": -1, "folders": [], "widths": []})


def add_samples(
    df: DataFrame,
    path: str,
    batch: int,
    series: Sequence[str],
    widths: Sequence[timedelta],
    ts: str = "ts",
    value: str = "value",
    tie: str | None = None,
) -> bool:
    """Add one arrival of samples; false if this batch, or a later one, is there already.

    Samples are read once, for the finest width; each wider one is made from the width before. Batch numbers rise, as those
    of a stream do, so a batch that runs again after a failure counts once. One writer at a time; a second one fails.
    """
    spark = df.sparkSession
    rising = _checked(widths)
    number, state = _state(spark, path)
    seconds = [_seconds(width) for width in rising]
    if state["widths"] and state["widths"] != seconds:
        raise ValueError(f"the store has widths of {state['widths']} seconds")
    if batch <= state["batch"]:
        return False
    folder = uuid.uuid4().hex
    rows = _write(partials(df, series, rising[0], ts, value, tie), f"{path}/data/{folder}/{seconds[0]}")
    for width in rising[1:]:
        rows = _write(_widened(rows, series, width), f"{path}/data/{folder}/{_seconds(width)}")
    _commit(spark, path, number + 1, {"batch": batch, "folders": [*state["folders"], folder], "widths": seconds})
    return True


def _commit(spark: SparkSession, path: str, number: int, content: dict) -> None:
    if not commits.publish(spark, f"{path}/log", number, content):
        raise RuntimeError(f"another writer changed {path}")


def _stored(spark: SparkSession, path: str, state: dict, seconds: int) -> DataFrame:
    if seconds not in state["widths"]:
        raise ValueError(f"{path} has no steps of {seconds} seconds")
    return spark.read.parquet(*[f"{path}/data/{folder}/{seconds}" for folder in state["folders"]])


def read_rollup(spark: SparkSession, path: str, width: timedelta, series: Sequence[str]) -> DataFrame:
    """One row per series and step of this width, the partials of all arrivals merged."""
    return merged(_stored(spark, path, _state(spark, path)[1], _seconds(width)), [*series, "step"])


def cover(start: datetime, end: datetime, widths: Sequence[timedelta]) -> list[tuple[timedelta, datetime, datetime]]:
    """The time from ``start`` up to ``end`` as stretches of whole steps, each as wide as fits: the widest in the middle,
    finer ones at the ends. Both must be starts of steps of the finest width.
    """
    *finer, widest = _checked(widths)
    first = EPOCH - (EPOCH - start) // widest * widest
    last = EPOCH + (end - EPOCH) // widest * widest
    if start >= end:
        return []
    if not finer:
        if first != start or last != end:
            raise ValueError(f"{start} and {end} must be starts of steps of {widest}")
        return [(widest, start, end)]
    if first >= last:
        return cover(start, end, finer)
    return [*cover(start, first, finer), (widest, first, last), *cover(last, end, finer)]


def read_range(spark: SparkSession, path: str, start: datetime, end: datetime) -> DataFrame:
    """The partials from ``start`` up to ``end``, at mixed widths; ``merged`` gives one row per series.

    Each width is read for its stretches alone; the bounds on ``step`` reach the scan.
    """
    _, state = _state(spark, path)
    stretches = cover(start, end, [timedelta(seconds=s) for s in state["widths"]])
    by_width: dict[int, Column] = {}
    for width, low, high in stretches:
        inside = (F.col("step") >= F.lit(low)) & (F.col("step") < F.lit(high))
        seconds = _seconds(width)
        by_width[seconds] = by_width[seconds] | inside if seconds in by_width else inside
    if not by_width:
        return _stored(spark, path, state, state["widths"][0]).where(F.lit(False))
    rows = [_stored(spark, path, state, seconds).where(inside) for seconds, inside in by_width.items()]
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out


def fold(spark: SparkSession, path: str, series: Sequence[str], since: Mapping[timedelta, datetime] | None = None) -> int:
    """Merge all folders of the store into one; how many there were.

    ``since`` drops the steps of a width that start before a time, so that fine steps may go sooner than wide ones. Readers
    see the store as it was before or after. Old folders stay until ``sweep``, for readers that have begun.
    """
    number, state = _state(spark, path)
    keep = {_seconds(width): at for width, at in (since or {}).items()}
    if not state["folders"]:
        return 0
    folder = uuid.uuid4().hex
    for seconds in state["widths"]:
        rows = merged(_stored(spark, path, state, seconds), [*series, "step"])
        if seconds in keep:
            rows = rows.where(F.col("step") >= F.lit(keep[seconds]))
        _write(rows, f"{path}/data/{folder}/{seconds}")
    _commit(spark, path, number + 1, {**state, "folders": [folder]})
    return len(state["folders"])


def sweep(spark: SparkSession, path: str) -> int:
    """Delete the folders that no longer count, those of failed writers too; how many went. No writer may be at work."""
    live = set(_state(spark, path)[1]["folders"])
    old = [name for name in commits.names(spark, f"{path}/data") if name not in live]
    return sum(commits.delete(spark, f"{path}/data/{name}") for name in old)


def mean_max(df: DataFrame, series: Sequence[str]) -> DataFrame:
    """Mean and maximum of each series, from partials of any widths."""
    rows = merged(df, series)
    mean = F.when(F.col("n") > 0, F.col("total") / F.col("n"))
    return rows.select(*series, mean.alias("mean"), F.col("largest").alias("max"))


def last_values(
    df: DataFrame, keys: Sequence[str], columns: Mapping[str, str], metric: str = "metric"
) -> DataFrame:
    """One column per listed metric with the value of its last sample for the keys, from partials."""

    def last(name: str) -> Column:
        return F.max(F.when(F.col(metric) == name, F.col("last")))["value"]

    return df.where(F.col(metric).isin(*columns)).groupBy(*keys).agg(
        *[last(name).alias(alias) for name, alias in columns.items()]
    )
