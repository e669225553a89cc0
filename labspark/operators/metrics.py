"""Counter and gauge samples: selection, rates, grids and panels.

Samples are a long table: one row per series and time. ``series`` names the columns that tell series apart, ``ts`` the
time, ``value`` the number and ``tie`` a column that orders samples of equal time.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from labspark.plans.hotgroups import (
    SEED,
    SLICE,
    TARGET_ROWS,
    largest_groups,
    measured,
    micros,
    seed_with_last,
    seed_with_totals,
    settled,
    split_hot,
)

RATE_ROWS = 200_000
DENSE_ROWS = 20_000
DENSE_PER_WINDOW = 500


def select_metric(
    df: DataFrame, name: str, wanted: Mapping[str, str], metric: str = "metric", labels: str = "labels"
) -> DataFrame:
    """Samples of one metric whose labels equal the wanted values."""
    keep = F.col(metric) == name
    for label, value in wanted.items():
        keep = keep & (F.col(labels)[label] == value)
    return df.where(keep)


def promote_labels(df: DataFrame, names: Sequence[str], labels: str = "labels") -> DataFrame:
    """Turn the named labels into columns."""
    return df.select("*", *[F.col(labels)[name].alias(name) for name in names])


def _span(length: timedelta) -> Column:
    return F.make_dt_interval(secs=F.lit(length.total_seconds()))


def newest(df: DataFrame, ts: str = "ts", minus: timedelta = timedelta(0)) -> Column:
    """The newest time of the table, less a span, as a scalar subquery."""
    return df.agg((F.max(ts) - _span(minus)).alias("t")).scalar()


def relative_range(
    df: DataFrame, last: timedelta, ts: str = "ts", as_of: Column | None = None, day: str | None = None
) -> DataFrame:
    """Rows of the trailing span, its left end open; ``as_of`` defaults to the newest row, which costs a scan of ``ts``.

    For a table stored by day, ``day`` names the date column of its folders; older folders are then not read.
    """
    start = newest(df, ts, last) if as_of is None else as_of - _span(last)
    rows = df.where(F.col(ts) > start)
    return rows if day is None else rows.where(F.col(day) >= F.to_date(start))


def retention_split(df: DataFrame, keep: timedelta, ts: str = "ts", as_of: Column | None = None) -> DataFrame:
    """Add ``expired``: true for rows older than the kept span."""
    start = newest(df, ts, keep) if as_of is None else as_of - _span(keep)
    return df.withColumn("expired", F.col(ts) < start)


def _step_increase(value: str, before: Column) -> Column:
    return F.when(before.isNull(), F.lit(0.0)).when(F.col(value) < before, F.col(value)).otherwise(F.col(value) - before)


def _increases(
    df: DataFrame,
    series: Sequence[str],
    ts: str,
    value: str,
    tie: str | None,
    target_rows: int,
    hot_when: Column | None = None,
    before: str | None = None,
) -> tuple[DataFrame, DataFrame | None]:
    """Cold and hot series apart, each with ``increase``."""
    order = [ts, tie] if tie else [ts]
    cold, hot = split_hot(df, series, ts, target_rows, hot_when, tie)
    along = Window.partitionBy(*series).orderBy(*order)
    columns = [*df.columns, "increase"]

    def grow(window: WindowSpec) -> Column:
        previous = F.lag(value).over(window)
        return _step_increase(value, previous if before is None else F.coalesce(previous, before))

    cold = cold.withColumn("increase", grow(along)).select(*columns)
    if hot is not None:
        within = Window.partitionBy(*series, SLICE).orderBy(SEED, *order)
        seeded = seed_with_last(hot, series, order, [value])
        hot = seeded.withColumn("increase", grow(within)).where(F.col(SEED) == 1).select(*columns)
    return cold, hot


def counter_increase(
    df: DataFrame,
    series: Sequence[str],
    ts: str = "ts",
    value: str = "value",
    tie: str | None = None,
    target_rows: int = TARGET_ROWS,
    before: str | None = None,
) -> DataFrame:
    """Add ``increase``: growth since the sample before; after a reset the value itself; 0 for the first sample.

    ``before`` names a column with the value that came before the first sample, for series that go on from earlier rows.
    """
    cold, hot = _increases(df, series, ts, value, tie, target_rows, before=before)
    return cold if hot is None else cold.unionByName(hot)


def _rate_over_frames(df: DataFrame, series: Sequence[str], ts: str, window: timedelta) -> DataFrame:
    """Trailing sums by a range frame: one shuffle, shared with the increase."""
    seconds = window.total_seconds()
    keys = ", ".join(f"`{key}`" for key in series)
    total = F.expr(
        f"sum(increase) OVER (PARTITION BY {keys} ORDER BY `{ts}` "
        f"RANGE BETWEEN INTERVAL '{seconds - 0.000001:.6f}' SECOND PRECEDING AND CURRENT ROW)"
    )
    return df.withColumn("rate", total / F.lit(seconds))


def _rate_over_blocks(
    df: DataFrame, series: Sequence[str], ts: str, window: timedelta, target_rows: int, distinct_times: bool = False
) -> DataFrame:
    """Trailing sums for dense series, linear in the number of samples.

    Time is cut into blocks of the window's length. A window then covers the end of one block and the start of the next.
    Each sample also visits the next block, moved by the window's length, so that both parts are running sums inside
    one block: own samples forwards in time, visitors backwards. Samples of one instant share a rate; when too many do
    for one task, they are added up first.
    """
    width = int(window.total_seconds() * 1_000_000)
    visits = (
        df.withColumn("_visit", F.explode(F.array(F.lit(0), F.lit(1))))
        .withColumn("_at", micros(df, ts) + F.col("_visit") * F.lit(width).cast("bigint"))
        .withColumn("_block", F.floor(F.col("_at") / F.lit(width)).cast("bigint"))
        .withColumn("_own", F.when(F.col("_visit") == 0, F.col("increase")).otherwise(F.lit(0.0)))
        .withColumn("_visitor", F.when(F.col("_visit") == 1, F.col("increase")).otherwise(F.lit(0.0)))
    )
    keys = [*series, "_block"]
    crowded = F.col("_n") > target_rows
    small, large = split_hot(visits, keys, "_at", target_rows, crowded)
    if large is not None and not distinct_times:
        if measured(largest_groups(large, [*keys, SLICE], crowded)) is not None:
            return _rate_by_instant(df, series, ts, window, target_rows)
    seeded = small.withColumn(SLICE, F.lit(0).cast("bigint")).withColumn(SEED, F.lit(1))
    if large is not None:
        seeded = seeded.unionByName(seed_with_totals(large, keys, before=["_own"], after=["_visitor"]))
    part = Window.partitionBy(*keys, SLICE)
    upto = part.orderBy(SEED, "_at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    beyond = part.orderBy(SEED, F.desc("_at"), "_visit").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.sum("_own").over(upto) + F.sum("_visitor").over(beyond)
    return (
        seeded.withColumn("rate", total / F.lit(window.total_seconds()))
        .where((F.col(SEED) == 1) & (F.col("_visit") == 0))
        .select(*df.columns, "rate")
    )


def _rate_by_instant(
    df: DataFrame, series: Sequence[str], ts: str, window: timedelta, target_rows: int
) -> DataFrame:
    """The same with the samples of each instant added up before, and the rates joined back to the samples."""
    instants = settled(df.groupBy(*series, ts).agg(F.sum("increase").alias("increase")))
    rates = _rate_over_blocks(instants, series, ts, window, target_rows, distinct_times=True)
    keys = [*series, ts]
    named = rates.select(*[F.col(k).alias(f"_at_{i}") for i, k in enumerate(keys)], "rate")
    same = F.lit(True)
    for i, key in enumerate(keys):
        same = same & F.col(key).eqNullSafe(F.col(f"_at_{i}"))
    return df.join(named, same, "left").select(*df.columns, "rate")


def counter_rate(
    df: DataFrame,
    series: Sequence[str],
    window: timedelta,
    ts: str = "ts",
    value: str = "value",
    tie: str | None = None,
    target_rows: int = RATE_ROWS,
) -> DataFrame:
    """Add ``increase`` and ``rate``: growth within the trailing window, its left end open, per second.

    Ordinary series take one shuffle and a range frame, whose cost is samples times samples per window. Series that are
    large, or dense enough for that product to hurt, are cut in time and take the linear way.
    """
    span = F.col("_hi") - F.col("_lo")
    per_window = F.col("_n") * F.lit(window.total_seconds() * 1_000_000)
    dense = (F.col("_n") > DENSE_ROWS) & (per_window > span * DENSE_PER_WINDOW)
    cold, hot = _increases(df, series, ts, value, tie, target_rows, dense)
    rates = _rate_over_frames(cold, series, ts, window)
    if hot is not None:
        rates = rates.unionByName(_rate_over_blocks(settled(hot), series, ts, window, target_rows))
    return rates


def step_start(ts: str, step: timedelta) -> Column:
    """Start of the time step a sample falls in."""
    return F.window(F.col(ts), f"{int(step.total_seconds() * 1_000_000)} microseconds")["start"]


def last_per_step(
    df: DataFrame,
    series: Sequence[str],
    step: timedelta,
    ts: str = "ts",
    value: str = "value",
    tie: str | None = None,
) -> DataFrame:
    """A gauge on a time grid: the last sample of each series and step."""
    order = F.struct(ts, tie) if tie else F.col(ts)
    return (
        df.withColumn("step", step_start(ts, step))
        .groupBy(*series, "step")
        .agg(F.max_by(value, order).alias(value))
    )


def average_by(df: DataFrame, by: Sequence[str], value: str, name: str) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(value).alias(name))


def busy_percent(
    df: DataFrame,
    host: str,
    series: Sequence[str],
    window: timedelta,
    step: timedelta,
    ts: str = "ts",
    value: str = "value",
    tie: str | None = None,
    target_rows: int = RATE_ROWS,
) -> DataFrame:
    """``100 - 100 * average idle rate`` per host and time step, from idle-time counters."""
    rates = counter_rate(df, series, window, ts, value, tie, target_rows).withColumn("step", step_start(ts, step))
    idle = average_by(rates, ["step", host], "rate", "_idle")
    return idle.select("step", host, (F.lit(100.0) - F.col("_idle") * F.lit(100.0)).alias("busy_pct"))


def series_mean_max(df: DataFrame, series: Sequence[str], value: str = "value") -> DataFrame:
    """Mean and maximum of each series over the rows given."""
    return df.groupBy(*series).agg(F.avg(value).alias("mean"), F.max(value).alias("max"))


def legend(label: str, suffix: Column) -> Column:
    return F.concat_ws(" ", F.col(label).cast("string"), suffix)


def panel_targets(df: DataFrame, targets: Mapping[str, str], label: str, metric: str = "metric") -> DataFrame:
    """Several metrics as one panel: rows of the named metrics with a ``legend`` text, from one scan."""
    suffix = F.lit(None).cast("string")
    for name, text in targets.items():
        suffix = F.when(F.col(metric) == name, F.lit(text)).otherwise(suffix)
    return df.where(F.col(metric).isin(*targets)).withColumn("legend", legend(label, suffix))


def side_by_side(
    df: DataFrame,
    keys: Sequence[str],
    columns: Mapping[str, str],
    metric: str = "metric",
    ts: str = "ts",
    value: str = "value",
    tie: str | None = None,
) -> DataFrame:
    """One column per listed metric holding its last value for the keys."""
    order = F.struct(ts, tie) if tie else F.col(ts)
    return (
        df.where(F.col(metric).isin(*columns))
        .groupBy(*keys)
        .agg(
            *[
                F.max_by(F.when(F.col(metric) == name, F.col(value)), F.when(F.col(metric) == name, order)).alias(alias)
                for name, alias in columns.items()
            ]
        )
    )


def label_targets(
    targets: DataFrame, labels: DataFrame, on: str, address: str, port: int | Column, names: Mapping[str, str]
) -> DataFrame:
    """Scrape targets as ``address:port`` with the named label columns attached."""
    place = F.concat_ws(":", F.col(address).cast("string"), port if isinstance(port, Column) else F.lit(str(port)))
    joined = targets.join(labels, on, "left")
    return joined.select(place.alias("target"), *[F.col(source).alias(label) for label, source in names.items()])
