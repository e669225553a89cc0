"""Results of update-mode streams without their revisions: closed steps in day folders, open ones once.

An update-mode stream writes a step again whenever it has changed, a folder for each batch. Behind the watermark nothing
changes any more. Compaction writes each day that has closed to a folder of its own, once and for all, and the steps still open
to one folder, each as it is now; the batches are then no longer needed. A commit log (``sources.commits``) names the folders
that count and the last batch they hold, so a reader sees the store before a compaction or after it.

The store: ``batch=<n>`` from the stream, ``day=<date>``, ``open=<version>``, and the log in ``_log``. What a commit no longer
names is deleted one version later, for readers that have just looked.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from labspark.sources.commits import delete, latest, names, numbers, publish
from labspark.sources.commits import commit as committed
from labspark.streaming.batches import newest_update

NOTHING = {"days": [], "open": None, "upto": -1, "closed": None}


def watermark_of(query: StreamingQuery) -> datetime | None:
    """How far a query's watermark had come in its last batch, in UTC; None if it had none."""
    progress = query.lastProgress
    found = progress.eventTime.get("watermark") if progress else None
    return None if found is None else datetime.fromisoformat(found.replace("Z", "+00:00")).replace(tzinfo=None)


def _state(spark: SparkSession, store: str) -> tuple[int, dict]:
    return latest(spark, f"{store}/_log") or (-1, NOTHING)


def _read(spark: SparkSession, store: str, schema: T.StructType, folders: Sequence[str]) -> DataFrame:
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{store}/{name}" for name in folders])


def _changing(spark: SparkSession, store: str, schema: T.StructType, keys: Sequence[str], state: dict, upto: int | None = None) -> DataFrame:
    """The steps that aren't in a day folder yet, each by its last revision."""
    later = [int(name[6:]) for name in names(spark, store) if name.startswith("batch=")]
    later = [n for n in later if n > state["upto"] and (upto is None or n <= upto)]
    full = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
    rows = spark.createDataFrame([], full)
    if later:
        # With the store as their base, the folders' numbers become a column.
        reader = spark.read.schema(full).option("basePath", store)
        rows = reader.parquet(*[f"{store}/batch={n}" for n in sorted(later)])
    if state["open"]:
        rows = rows.unionByName(_read(spark, store, schema, [state["open"]]).withColumn("batch", F.lit(state["upto"]).cast("bigint")))
    rows = newest_update(rows, list(keys)).select(*schema.names)
    if state["closed"]:
        rows = rows.where(_day(schema) >= F.lit(date.fromisoformat(state["closed"])))
    return rows


def _day(schema: T.StructType, step: str = "step") -> Column:
    """The day of a step, in UTC."""
    if isinstance(schema[step].dataType, T.TimestampNTZType):
        return F.to_date(step)
    return F.date_from_unix_date(F.floor(F.unix_micros(F.col(step)) / F.lit(86_400_000_000)).cast("int"))


def read_steps(spark: SparkSession, store: str, schema: T.StructType, keys: Sequence[str]) -> DataFrame:
    """Every step once, as it is now. Days that have closed are read as they lie; only the rest goes through a shuffle."""
    _, state = _state(spark, store)
    return _read(spark, store, schema, [f"day={d}" for d in state["days"]]).unionByName(_changing(spark, store, schema, keys, state))


def compact_steps(
    spark: SparkSession, store: str, schema: T.StructType, keys: Sequence[str], watermark: datetime, length: timedelta, upto: int | None = None
) -> int:
    """Fold the batches (to number ``upto``, by default all) behind the ``watermark``; the store's new version.

    ``keys`` name the step with its series, ``length`` is that of a step. A day closes when the watermark has passed all its
    steps. One compaction may run at a time beside the stream; if another has published first, nothing changes.
    """
    version, state = _state(spark, store)
    known = [int(name[6:]) for name in names(spark, store) if name.startswith("batch=")]
    last = max([n for n in known if upto is None or n <= upto], default=state["upto"])
    # Steps that begin before the watermark less their length are closed; so are the days before the next one's day.
    closed = max(filter(None, [(watermark - length + timedelta(microseconds=1)).date().isoformat(), state["closed"]]))
    rows = _changing(spark, store, schema, keys, state, last)
    day = _day(schema)
    before = rows.where(day < F.lit(date.fromisoformat(closed)))
    open_folder = f"open={version + 1}"
    rows.where(day >= F.lit(date.fromisoformat(closed))).write.mode("overwrite").parquet(f"{store}/{open_folder}")
    draft = f"{store}/draft={version + 1}"
    before.withColumn("day", day).hint("rebalance", "day").write.mode("overwrite").partitionBy("day").parquet(draft)
    days = [name[4:] for name in names(spark, draft) if name.startswith("day=")]
    for d in days:
        _move(spark, f"{draft}/day={d}", f"{store}/day={d}")
    delete(spark, draft)
    content = {"days": sorted({*state["days"], *days}), "open": open_folder, "upto": last, "closed": closed}
    if not publish(spark, f"{store}/_log", version + 1, content):
        return version
    _clean(spark, store, state, content)
    return version + 1


def _move(spark: SparkSession, source: str, target: str) -> None:
    """Put a day's folder in its place; one that a compaction left there without a commit goes first."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    store = path(target).getFileSystem(spark._jsc.hadoopConfiguration())
    store.delete(path(target), True)
    if not store.rename(path(source), path(target)):
        raise RuntimeError(f"{source} could not be moved to {target}")


def _clean(spark: SparkSession, store: str, before: dict, now: dict) -> None:
    """Delete what neither this version nor the one before names."""
    for name in names(spark, store):
        kind, _, value = name.partition("=")
        unused = {
            "batch": lambda: int(value) <= before["upto"],
            "open": lambda: name not in (before["open"], now["open"]) and int(value) < int(now["open"][5:]),
            "day": lambda: value not in before["days"] and value not in now["days"],
        }.get(kind)
        if unused is not None and unused():
            delete(spark, f"{store}/{name}")


def expire_days(spark: SparkSession, store: str, since: date) -> int:
    """Retention: leave the closed days before ``since`` out of the store; how many went.

    They are deleted with the next version's clean-up, as readers may be at them."""
    version, state = _state(spark, store)
    kept = [d for d in state["days"] if d >= since.isoformat()]
    if len(kept) == len(state["days"]) or not publish(spark, f"{store}/_log", version + 1, {**state, "days": kept}):
        return 0
    return len(state["days"]) - len(kept)


def stored_rows(spark: SparkSession, store: str) -> int:
    """How many rows the store's files hold, revisions and all."""
    folders = [name for name in names(spark, store) if name.partition("=")[0] in ("batch", "day", "open")]
    return sum(spark.read.parquet(f"{store}/{name}").count() for name in folders)


def versions(spark: SparkSession, store: str) -> list[dict]:
    """All commits, for those who want to know what happened."""
    return [committed(spark, f"{store}/_log", n) for n in numbers(spark, f"{store}/_log")]
