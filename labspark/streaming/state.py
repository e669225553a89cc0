"""Streams with keyed state: trailing rates of samples that arrive in any order, and runs that end.

State lies in Spark's RocksDB store with a changelog: a batch reads and writes the keys it holds rows or due timers of, and the
checkpoint gets what has changed. Keys leave the state when they are done, so it does not grow with all that ever was. A key is
a run, or a bucket of series that leave it one by one.

The two processors are Python, as Spark has no such state in its column functions. A key's rows of one batch are one task's;
how many that are is limited by the files a batch takes, and the batch operators cut hot keys where that is too much.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from contextlib import contextmanager
from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from labspark.functions.text import event_message
from labspark.operators.events import CLOSE, ERROR, FRAME, MESSAGE
from labspark.operators.logs import FRAMES_PER_MESSAGE, PROGRESS_TEXT
from labspark.plans.hotgroups import micros
from labspark.session import visible_to_workers
from labspark.streaming.batches import append

STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}

BUCKETS = 1024


@contextmanager
def keyed_store(spark: SparkSession) -> Iterator[None]:
    """Streams started within use the RocksDB store; a stream keeps the settings it was started with."""
    before = {key: spark.conf.get(key, None) for key in STORE}
    for key, value in STORE.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def length_us(length: timedelta) -> int:
    return length // timedelta(microseconds=1)


class TrailingRates(StatefulProcessor):
    """Increase and trailing rate of samples, put in order behind the watermark, for all series of a bucket at once.

    A sample waits until the watermark has passed it: nothing older can come any more. Then its increase follows from the sample
    before, and its rate from the increases of the trailing window, of which the state keeps those that windows to come reach.

    A call to the state costs as much for one series as for hundreds, so a key is a bucket of series by their hash. Its two
    values are flat arrays: ``series`` has the series' texts, a line each, their last samples and those that wait, ``tails``
    the increases that windows to come reach. Rows that only wait leave the tails alone.
    """

    SERIES = "series string, last binary, waiting binary, timer bigint"
    TAILS = "tail binary"
    LAST = np.dtype([("us", "<i8"), ("value", "<f8")])
    WAITING = np.dtype([("series", "<i4"), ("us", "<i8"), ("value", "<f8"), ("tie", "<i8")])
    TAIL = np.dtype([("series", "<i4"), ("us", "<i8"), ("increase", "<f8")])
    OUT = "series string, time_us bigint, value double, tie bigint, increase double, rate double"
    NEVER = np.iinfo(np.int64).min

    def __init__(self, window: timedelta, idle: timedelta | None) -> None:
        self.window = length_us(window)
        self.idle = None if idle is None else length_us(max(idle, window))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.series = handle.getValueState("series", self.SERIES)
        self.tails = handle.getValueState("tails", self.TAILS)

    def close(self) -> None:
        pass

    def _read(self) -> tuple[list[str], np.ndarray, np.ndarray, int | None]:
        known = self.series.get()
        if known is None:
            return [], np.empty(0, self.LAST), np.empty(0, self.WAITING), None
        names, last, waiting, timer = known
        return names.split("\n"), np.frombuffer(last, self.LAST), np.frombuffer(waiting, self.WAITING), timer

    def _write(self, names: list[str], last: np.ndarray, waiting: np.ndarray, timer: int | None, watermark: int) -> None:
        """Store the series and see that a timer is set for when there is something to do."""
        due = [int(waiting["us"].min())] if len(waiting) else []
        if self.idle is not None:
            resting = last["us"] != self.NEVER
            resting[waiting["series"]] = False
            due += [int(last["us"][resting].min()) + self.idle] if resting.any() else []
        at = max(min(due) // 1000, watermark) + 1 if due else None
        if at is not None and (timer is None or at < timer):
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(at)
            timer = at
        self.series.update(("\n".join(names), last.tobytes(), waiting.tobytes(), timer))

    def handleInputRows(self, key: tuple, rows: Iterable[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows))
        new = new[new["value"].notna()]
        if len(new):
            names, last, waiting, timer = self._read()
            places = {name: place for place, name in enumerate(names)}
            codes, found = pd.factorize(new["series"])
            of_found = np.array([places.setdefault(name, len(places)) for name in found], np.int32)
            fresh = np.empty(len(new), self.WAITING)
            fresh["series"] = of_found[codes]
            for field, column, kind in (("us", "time_us", np.int64), ("value", "value", np.float64), ("tie", "tie", np.int64)):
                fresh[field] = new[column].to_numpy(kind)
            last = np.concatenate([last, np.full(len(places) - len(last), np.array((self.NEVER, 0.0), self.LAST))])
            self._write(list(places), last, np.concatenate([waiting, fresh]), timer, timerValues.getCurrentWatermarkInMs())
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        names, last, waiting, _ = self._read()
        if not names:
            return
        passed = waiting["us"] <= watermark * 1000
        due, waiting = waiting[passed], waiting[~passed]
        known = self.tails.get() if len(due) or self.idle is not None else None
        tail = np.empty(0, self.TAIL) if known is None else np.frombuffer(known[0], self.TAIL)
        moved = len(due) > 0
        if moved:
            due = due[np.lexsort((due["tie"], due["us"], due["series"]))]
            last, tail, increase, rate = self._rates(last, tail, due)
            samples = {"time_us": due["us"], "value": due["value"], "tie": due["tie"], "increase": increase, "rate": rate}
            yield pd.DataFrame({"series": np.array(names, object)[due["series"]], **samples})
        if self.idle is not None:
            gone = (last["us"] != self.NEVER) & (last["us"] <= watermark * 1000 - self.idle)
            gone[due["series"]] = gone[waiting["series"]] = False
            if gone.any():
                place = np.cumsum(~gone) - 1
                names, last = [name for name, out in zip(names, gone) if not out], last[~gone]
                waiting, tail, moved = waiting.copy(), tail[~gone[tail["series"]]], True
                waiting["series"], tail["series"] = place[waiting["series"]], place[tail["series"]]
        if not names:
            self.series.clear()
            self.tails.clear()
            return
        if moved:
            self.tails.update((tail.tobytes(),))
        self._write(names, last, waiting, None, watermark)

    def _rates(self, last: np.ndarray, tail: np.ndarray, due: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Last samples and tails after the due samples, which are in order by series and time, and the due samples' increases and rates."""
        series, us, value = due["series"], due["us"], due["value"]
        first = np.concatenate([[True], series[1:] != series[:-1]])
        before = np.concatenate([value[:1], value[:-1]])
        before[first] = np.where(last["us"][series[first]] == self.NEVER, value[first], last["value"][series[first]])
        increase = np.where(value < before, value, value - before)
        grown = np.empty(len(tail) + len(due), self.TAIL)
        for field, new in (("series", series), ("us", us), ("increase", increase)):
            grown[field] = np.concatenate([tail[field], new])
        grown = grown[np.argsort(grown["series"], kind="stable")]
        # Sums start anew with each series, so that none loses digits to another's size.
        sums = pd.Series(grown["increase"]).groupby(grown["series"], sort=False).cumsum().to_numpy()
        sums = np.concatenate([[0.0], sums])
        marks = np.unique(np.concatenate([grown["us"], us - self.window]))

        def place(of: np.ndarray, at: np.ndarray) -> np.ndarray:
            return of.astype(np.int64) * len(marks) + np.searchsorted(marks, at)

        # The window's left end is open, and samples of one instant share it.
        places = place(grown["series"], grown["us"])
        end, start = (np.searchsorted(places, place(series, at), "right") for at in (us, us - self.window))
        at_first = start == np.searchsorted(grown["series"], series)
        rate = (sums[end] - np.where(at_first, 0.0, sums[start])) / (self.window / 1_000_000)
        newest = np.concatenate([first[1:], [True]])
        last = last.copy()
        last["us"][series[newest]], last["value"][series[newest]] = us[newest], value[newest]
        return last, grown[grown["us"] > last["us"][grown["series"]] - self.window], increase, rate


def as_text(df: DataFrame, column: str) -> Column:
    """A column of a key as a text that ``from_text`` turns back into the same value."""
    kind, key = df.schema[column].dataType, F.col(column)
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        raise TypeError(f"{column} is of type {kind.simpleString()}; a series has plain values")
    if isinstance(kind, T.BinaryType):
        return F.hex(key)
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        key = key + F.lit(0.0).cast(kind)  # there is one zero
    elif isinstance(kind, T.TimestampType):
        key = F.unix_micros(key)
    return key.cast("string")


def from_text(text: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.BinaryType):
        return F.unhex(text)
    if isinstance(kind, T.TimestampType):
        return F.timestamp_micros(text.cast("bigint"))
    return text.cast(kind)


def trailing_rates(
    stream: DataFrame,
    series: Sequence[str],
    window: timedelta,
    late: timedelta,
    ts: str = "ts",
    value: str = "value",
    tie: str = "sample_id",
    idle: timedelta | None = None,
    buckets: int = BUCKETS,
) -> DataFrame:
    """``series``, ``ts``, ``value``, ``tie``, ``increase`` and ``rate``, each sample once, as ``counter_rate`` has them.

    Samples may arrive in any order, up to ``late`` behind the newest; what is later than that is dropped. A row without a
    value is no sample but moves the watermark, so one far ahead of all samples lets the last ones out. A series without
    samples for ``idle`` (at least the window) leaves the state; if it comes back, it starts anew. ``tie`` is a whole number.

    The state is read and written by ``buckets`` of series, which a checkpoint keeps: more of them for more series than some
    hundreds a bucket, so that a batch that touches few series reads few others.
    """
    visible_to_workers(stream.sparkSession)
    kind = stream.schema[ts].dataType
    text = F.to_json(F.struct(*[as_text(stream, c).alias(c) for c in series]))
    # Whole numbers without a gap: a null would make them doubles on their way.
    ties = F.when(F.col(value).isNull(), F.lit(0)).otherwise(F.col(tie).cast("bigint"))
    timed = stream.select(text.alias("series"), micros(stream, ts).alias("time_us"), F.col(value).cast("double").alias("value"), ties.alias("tie"))
    timed = timed.withColumn("bucket", F.pmod(F.xxhash64("series"), F.lit(buckets)).cast("int"))
    timed = timed.withColumn("_time", F.timestamp_micros("time_us")).withWatermark("_time", f"{length_us(late)} microseconds")
    rates = timed.groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=TrailingRates(window, idle), outputStructType=T.StructType.fromDDL(TrailingRates.OUT), outputMode="Append", timeMode="EventTime"
    )
    rates = rates.withColumn("series", F.from_json("series", T.StructType([T.StructField(c, T.StringType()) for c in series])))
    names = [from_text(F.col("series")[c], stream.schema[c].dataType).alias(c) for c in series]
    if isinstance(kind, T.TimestampNTZType):
        seconds = (F.col("time_us").cast("decimal(20, 0)") / F.lit(1_000_000)).cast("decimal(18, 6)")
        at = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds)
    else:
        at = F.timestamp_micros("time_us")
    return rates.select(*names, at.alias(ts), F.col("value").alias(value), F.col("tie").alias(tie), "increase", "rate")


def run_trailing_rates(rates: DataFrame, out: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Store the rates; each run goes on where the checkpoint is."""
    with keyed_store(rates.sparkSession):
        return append(rates, out, checkpoint, every)


class RunRouter(StatefulProcessor):
    """The events of a run: its frames are counted until it is closed; a closed run is remembered for a while, then not at all."""

    def __init__(self, every: int, remember: timedelta) -> None:
        self.every, self.remember = every, length_us(remember)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "frames bigint, closed boolean")

    def close(self) -> None:
        pass

    def handleInputRows(self, key: tuple, rows: Iterable[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows))
        before, closed = self.run.get() if self.run.exists() else (0, False)
        if closed:
            return
        events = events.sort_values("seq", kind="stable")
        closes = events[events["event_type"] == CLOSE]
        if len(closes):
            events = events[events["seq"] <= closes["seq"].iloc[0]]
            forget = int(closes["time_us"].iloc[0]) + self.remember
            self.handle.registerTimer(max(forget // 1000, timerValues.getCurrentWatermarkInMs()) + 1)
        frames = (events["event_type"] == FRAME).to_numpy()
        counts = before + np.cumsum(frames)
        progress = frames & (counts % self.every == 0)
        if len(closes) or frames.any():
            self.run.update((int(counts[-1]), len(closes) > 0))
        shown = progress | events["event_type"].isin([MESSAGE, ERROR]).to_numpy()
        found = events[shown]
        if len(found):
            counted = pd.array(counts[shown], "Int64")
            counted[~progress[shown]] = pd.NA
            yield pd.DataFrame({"run_id": [key[0]] * len(found), **{c: found[c].to_numpy() for c in ("seq", "event_type", "message")}, "frames": counted})

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.run.clear()
        return iter(())


def routed_events(
    stream: DataFrame,
    late: timedelta,
    ts: str = "ts",
    every: int = FRAMES_PER_MESSAGE,
    text: str = PROGRESS_TEXT,
    remember: timedelta = timedelta(hours=1),
) -> DataFrame:
    """The messages to show, as ``route_events`` gives them, of a stream of run_id, seq, event_type, message and a time.

    A run's frames are counted from batch to batch. When it closes, its identifier stays until the watermark, ``late`` behind
    the newest event, is ``remember`` past the close, and events that follow the close are dropped; then the run leaves the
    state, and the same identifier is a new run. Events of a run come in order, or up to a batch together.
    """
    visible_to_workers(stream.sparkSession)
    fields = [stream.schema[c] for c in ("run_id", "seq", "event_type", "message")]
    timed = stream.select(*[f.name for f in fields], micros(stream, ts).alias("time_us"))
    timed = timed.withColumn("_time", F.timestamp_micros("time_us")).withWatermark("_time", f"{length_us(late)} microseconds")
    shown = timed.groupBy("run_id").transformWithStateInPandas(
        statefulProcessor=RunRouter(every, remember),
        outputStructType=T.StructType([*fields, T.StructField("frames", T.LongType())]),
        outputMode="Append",
        timeMode="EventTime",
    )
    kind = F.when(F.col("frames").isNotNull(), MESSAGE).otherwise(F.col("event_type"))
    progress = F.format_string(text, "frames")
    message = F.when(F.col("frames").isNotNull(), progress).otherwise(event_message(F.col("event_type"), F.col("message")))
    return shown.select("run_id", "seq", kind.alias("event_type"), message.alias("message"))


def run_routed_events(shown: DataFrame, out: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    with keyed_store(shown.sparkSession):
        return append(shown, out, checkpoint, every)


def state_rows(spark: SparkSession, checkpoint: str, variable: str) -> DataFrame:
    """What a stopped stream's state holds of one variable, a row for each key; of trailing rates' buckets, one for each series.

    A series' ``key`` has its columns' texts by name, its ``value`` the last sample and how many wait.
    """
    with keyed_store(spark):
        rows = spark.read.format("statestore").option("stateVarName", variable).load(checkpoint)
    if rows.schema["key"].dataType.fieldNames() != ["bucket"] or variable != "series":
        return rows
    visible_to_workers(spark)

    @F.udf("array<struct<series string, last_us bigint, last double, waiting bigint>>")
    def listed(series, last, waiting):
        waits = np.bincount(np.frombuffer(waiting, TrailingRates.WAITING)["series"], minlength=series.count("\n") + 1)
        ends = [(None, None) if us == TrailingRates.NEVER else (us, value) for us, value in np.frombuffer(last, TrailingRates.LAST).tolist()]
        return [(name, *end, n) for name, end, n in zip(series.split("\n"), ends, waits.tolist())]

    one = rows.select("partition_id", F.explode(listed("value.series", "value.last", "value.waiting")).alias("one"))
    key = F.from_json("one.series", "map<string, string>").alias("key")
    return one.select("partition_id", key, F.struct("one.last_us", "one.last", "one.waiting").alias("value"))
