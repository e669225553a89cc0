from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from labspark.operators import metrics as M
from labspark.session import scratch_path
from labspark.sources import commits, rollups

MINUTE, HOUR, DAY = timedelta(minutes=1), timedelta(hours=1), timedelta(days=1)
WIDTHS = [MINUTE, HOUR, DAY]
SCHEMA = "host string, ts timestamp_ntz, id bigint, value double"
START = datetime(2024, 3, 1)


def made_up(n: int, seed: int = 7) -> list[tuple]:
    """Samples out of order: nulls as hosts and values, equal times, values that are whole numbers and add up exactly."""
    draw = random.Random(seed)
    hosts = ["a", "a", "a", "b", None]
    return [
        (
            draw.choice(hosts),
            START + timedelta(minutes=draw.randrange(4 * 1440) // 3, seconds=draw.choice([0, 0, 30])),
            i,
            None if draw.random() < 0.1 else float(draw.randrange(100)),
        )
        for i in range(n)
    ]


def filled(spark, rows: list[tuple], batches: int) -> str:
    path = scratch_path(spark, "rollup-test")
    for batch in range(batches):
        part = spark.createDataFrame(rows[batch::batches], SCHEMA)
        assert rollups.add_samples(part, path, batch, ["host"], WIDTHS, tie="id")
    return path


def as_set(df) -> list[tuple]:
    return sorted((tuple(row) for row in df.collect()), key=repr)


def whole(spark, rows: list[tuple], width: timedelta) -> list[tuple]:
    return as_set(rollups.partials(spark.createDataFrame(rows, SCHEMA), ["host"], width, tie="id"))


def stored(spark, path: str, width: timedelta) -> list[tuple]:
    return as_set(rollups.read_rollup(spark, path, width, ["host"]))


def test_arrivals_and_folds_give_what_one_batch_gives(spark):
    rows = made_up(900)
    path = filled(spark, rows, 4)
    for width in WIDTHS:
        assert stored(spark, path, width) == whole(spark, rows, width)
    assert rollups.fold(spark, path, ["host"]) == 4
    late = made_up(100, seed=8)
    assert rollups.add_samples(spark.createDataFrame(late, SCHEMA), path, 4, ["host"], WIDTHS, tie="id")
    for width in WIDTHS:
        assert stored(spark, path, width) == whole(spark, rows + late, width)
    assert rollups.sweep(spark, path) == 4
    assert len(commits.names(spark, f"{path}/data")) == 2
    assert stored(spark, path, DAY) == whole(spark, rows + late, DAY)


def test_a_batch_counts_once(spark):
    rows = made_up(60)
    path = filled(spark, rows, 2)
    again = spark.createDataFrame(rows[1::2], SCHEMA)
    assert not rollups.add_samples(again, path, 1, ["host"], WIDTHS, tie="id")
    assert stored(spark, path, HOUR) == whole(spark, rows, HOUR)


def test_a_failed_writer_leaves_nothing_that_counts(spark, monkeypatch):
    rows = made_up(60)
    path = filled(spark, rows, 1)
    monkeypatch.setattr(commits, "publish", lambda *_: False)
    with pytest.raises(RuntimeError):
        rollups.add_samples(spark.createDataFrame(rows, SCHEMA), path, 1, ["host"], WIDTHS, tie="id")
    monkeypatch.undo()
    assert stored(spark, path, MINUTE) == whole(spark, rows, MINUTE)
    assert rollups.sweep(spark, path) == 1


def test_mean_and_maximum_of_any_range(spark):
    rows = made_up(600)
    path = filled(spark, rows, 3)
    raw = spark.createDataFrame(rows, SCHEMA)
    for low, high in [(0, 2880), (61, 62), (59, 1501), (1440, 1440), (5, 100)]:
        start, end = START + low * MINUTE, START + high * MINUTE
        mine = rollups.mean_max(rollups.read_range(spark, path, start, end), ["host"])
        inside = raw.where((F.col("ts") >= F.lit(start)) & (F.col("ts") < F.lit(end)))
        assert as_set(mine) == as_set(M.series_mean_max(inside, ["host"]))


def test_a_range_reads_wide_steps_in_its_middle(spark):
    path = filled(spark, made_up(600), 1)
    found = rollups.read_range(spark, path, START + 30 * MINUTE, START + DAY + 90 * MINUTE)
    assert "GreaterThanOrEqual(step" in found._jdf.queryExecution().toString()
    starts = {row.step for row in found.select("step").distinct().collect()}
    assert all(step < START + HOUR or step >= START + DAY or step.minute == 0 for step in starts)


def test_dropping_fine_steps_keeps_wide_ones(spark):
    rows = made_up(300)
    path = filled(spark, rows, 2)
    cut = START + 12 * HOUR
    rollups.fold(spark, path, ["host"], {MINUTE: cut})
    assert stored(spark, path, MINUTE) == [row for row in whole(spark, rows, MINUTE) if row[1] >= cut]
    assert stored(spark, path, HOUR) == whole(spark, rows, HOUR)


def test_last_values_take_the_highest_tie_of_a_time(spark):
    rows = [("a", START, 1, 5.0), ("a", START, 2, 3.0), ("a", START - HOUR, 9, 8.0), ("b", START, 1, None)]
    path = filled(spark, rows, 2)
    daily = rollups.read_rollup(spark, path, DAY, ["host"]).where(F.col("step") == F.lit(START))
    wide = rollups.last_values(daily, ["step"], {"a": "of_a", "b": "of_b", "c": "of_c"}, metric="host")
    assert as_set(wide) == [(START, 3.0, None, None)]


def test_empty_arrivals_and_samples_without_time(spark):
    path = scratch_path(spark, "rollup-test")
    for batch, rows in enumerate([[], [("a", None, 1, 2.0)], [("a", START, 2, None)]]):
        assert rollups.add_samples(spark.createDataFrame(rows, SCHEMA), path, batch, ["host"], WIDTHS, tie="id")
    row = rollups.read_rollup(spark, path, DAY, ["host"]).collect()
    assert [(r.host, r.step, r.n, r.total, r.largest) for r in row] == [("a", START, 0, None, None)]
    assert as_set(rollups.mean_max(rollups.read_rollup(spark, path, DAY, ["host"]), ["host"])) == [("a", None, None)]


def test_widths_must_divide(spark):
    with pytest.raises(ValueError):
        rollups.cover(START, START + DAY, [timedelta(minutes=7), HOUR])
    with pytest.raises(ValueError):
        rollups.cover(START, START + timedelta(seconds=90), WIDTHS)


@settings(max_examples=200, deadline=None)
@given(st.integers(-20_000, 20_000), st.integers(0, 20_000))
def test_a_cover_is_gapless_and_wide(first, minutes):
    start = datetime(1970, 1, 8) + first * MINUTE
    end = start + minutes * MINUTE
    stretches = rollups.cover(start, end, WIDTHS)
    at = start
    for width, low, high in stretches:
        assert low == at and high >= low and (low - rollups.EPOCH) % width == timedelta(0)
        assert (high - rollups.EPOCH) % width == timedelta(0)
        at = high
    assert at == end or (minutes == 0 and not stretches)
    fine = sum(((high - low) // width for width, low, high in stretches if width != DAY), 0)
    assert fine <= 2 * (59 + 23)
