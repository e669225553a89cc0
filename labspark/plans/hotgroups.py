"""Splitting groups that are too large for one task.

A window or an ordered fold needs all rows of its group in one task. These helpers first count the groups, then split
only those that hold more rows than one task should take. Without such groups the plan stays what it would have been.

The list of hot groups is the one thing that reaches the driver or is broadcast here, and only while it has at most
``LISTED_GROUPS`` rows. A longer one is written to the shared folder and joined as any table; no hot group is left out.

All splits are computed from exact counts, minima and maxima. Recomputing a lost partition gives the same split.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labspark.session import scratch_path, shared_dir

TARGET_ROWS = 1_000_000
LISTED_GROUPS = 10_000
BURST_PARTS = 1024
MAX_PARTS = 1 << 15  # four levels of slice numbers fit one bigint

SLICE = "_slice"
SEED = "_seed"


def micros(df: DataFrame, column: str) -> Column:
    """A timestamp as whole microseconds since 1970, free of the session time zone."""
    if isinstance(df.schema[column].dataType, T.TimestampNTZType):
        seconds = F.expr(
            f"cast(cast(`{column}` - TIMESTAMP_NTZ '1970-01-01 00:00:00' as interval second) as decimal(18, 6))"
        )
        return F.round(seconds.cast("double") * 1_000_000).cast("bigint")
    return F.unix_micros(F.col(column))


def position(df: DataFrame, column: str) -> Column:
    """A number that never falls as ``column`` rises: microseconds, days or the value. Texts have none.

    Groups ordered by a text are numbered and paged by ``plans.numbering``.
    """
    kind = df.schema[column].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return micros(df, column).cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(column).cast("double")
    if isinstance(kind, T.StringType):
        raise TypeError(f"{column} is a text; slices need a time or a number")
    return F.col(column).cast("double")


def largest_groups(df: DataFrame, keys: Sequence[str], keep: Column, *extra: Column) -> DataFrame:
    """Groups that meet ``keep``, a condition on their row count ``_n`` and the ``extra`` aggregates."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *extra).where(keep)


def measured(df: DataFrame) -> DataFrame | None:
    """A result computed now: literal rows while it is short, else a stored table; None when it is empty."""
    rows = df.limit(LISTED_GROUPS + 1).toArrow()
    if rows.num_rows > LISTED_GROUPS:
        return sized(df)
    return df.sparkSession.createDataFrame(rows, df.schema) if rows.num_rows else None


def settled(df: DataFrame) -> DataFrame:
    """The rows written once to the shared checkpoint folder, for plans that read them several times."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def sized(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder and read back, so that plans know how large they are."""
    path = scratch_path(df.sparkSession, "rows")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _join_hot(df: DataFrame, hot: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Join the hot-group table, treating null keys as equal. Spark broadcasts it by its size, known either way."""
    renamed = hot.select(
        *[F.col(k).alias(f"_hot_{i}") for i, k in enumerate(keys)],
        *[c for c in hot.columns if c not in keys],
    )
    condition = F.lit(True)
    for i, key in enumerate(keys):
        condition = condition & F.col(key).eqNullSafe(F.col(f"_hot_{i}"))
    return df.join(renamed, condition, how)


def split_hot(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    target_rows: int = TARGET_ROWS,
    hot_when: Column | None = None,
    tie: str | None = None,
    levels: int = 3,
) -> tuple[DataFrame, DataFrame | None]:
    """Rows of cold groups, and rows of hot groups cut along ``order`` into slices of up to about ``target_rows`` rows.

    The hot rows carry ``_slice``, which rises with ``order``; they are None when no group is hot. Cutting is by equal
    width between the group's ends; each further level cuts again the slices that a burst has left too large. Rows equal
    in ``order`` can only be cut along the ``tie``, when there is one.

    ``hot_when`` names further groups to treat as hot, as a condition on their count ``_n`` and ends ``_lo``, ``_hi``.
    """
    names = df.columns
    placed = df.select("*", position(df, order).alias("_pos"))

    by_tie = tie is not None

    def ends(column: str, low: str, high: str) -> list[Column]:
        return [F.min(column).alias(low), F.max(column).alias(high)]

    def measure(base: DataFrame, grouping: Sequence[str], also: Column | None = None) -> DataFrame | None:
        hot = (F.col("_n") > target_rows) & (F.col("_hi") > F.col("_lo"))
        return measured(largest_groups(base, grouping, hot if also is None else hot | also, *ends("_pos", "_lo", "_hi")))

    def place(at_least: int, column: str = "_pos") -> Column:
        # Half the target on average, so that uneven slices seldom exceed it and need another pass.
        wanted = F.greatest(F.ceil(F.col("_n") * 2 / F.lit(target_rows)), F.lit(at_least))
        parts = F.least(wanted, F.lit(MAX_PARTS)).cast("bigint")
        offset = (F.col(column) - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))
        # Rows without a position sort first, and so do those of a group that is not cut.
        within = F.least(F.floor(offset * parts).cast("bigint"), parts - 1)
        return F.when(offset.isNull(), F.lit(0)).otherwise(within)

    if by_tie:
        crowded = F.col("_n") > target_rows
        hot_when = crowded if hot_when is None else hot_when | crowded
    groups = measure(placed, keys, hot_when)
    if groups is None:
        return df, None
    cold = _join_hot(df, groups, keys, "left_anti")
    hot = _join_hot(placed, groups, keys, "inner").select(*names, "_pos", place(1).alias(SLICE))
    for _ in range(levels - 1):
        grouping = [*keys, SLICE]
        slices = measure(hot, grouping)
        if slices is None:
            break
        finer = F.col(SLICE) * MAX_PARTS + place(BURST_PARTS)
        hot = _join_hot(hot, slices, grouping, "left").select(*names, "_pos", finer.alias(SLICE))
    if by_tie:
        grouping = [*keys, SLICE]
        tied = hot.withColumn("_tie", position(df, tie))
        same = (F.col("_first") == F.col("_last")) & (F.col("_timed") == F.col("_n"))
        instant = (F.col("_n") > target_rows) & same & (F.col("_hi") > F.col("_lo"))
        sides = [*ends("_tie", "_lo", "_hi"), *ends(order, "_first", "_last"), F.count(order).alias("_timed")]
        instants = measured(largest_groups(tied, grouping, instant, *sides))
        finer = F.col(SLICE) * MAX_PARTS
        if instants is None:
            hot = tied.select(*names, finer.alias(SLICE))
        else:
            placed_ties = finer + place(BURST_PARTS, "_tie")
            hot = _join_hot(tied, instants, grouping, "left").select(*names, placed_ties.alias(SLICE))
    return cold, hot.select(*names, SLICE)


def seed_with_last(sliced: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Put in front of each hot slice one row with the last values of the slice before it.

    Seed rows have ``_seed`` 0 and real rows 1; order by ``_seed`` first and drop the seeds afterwards.
    """
    tails = sliced.groupBy(*keys, SLICE).agg(
        F.max_by(F.struct(*columns), F.struct(*order)).alias("_tail"),
    )
    along = Window.partitionBy(*keys).orderBy(SLICE)
    seeds = (
        tails.select(*keys, F.lead(SLICE).over(along).alias(SLICE), "_tail.*")
        .where(F.col(SLICE).isNotNull())
        .withColumn(SEED, F.lit(0))
    )
    return sliced.withColumn(SEED, F.lit(1)).unionByName(seeds, allowMissingColumns=True)


def seed_with_totals(
    sliced: DataFrame, keys: Sequence[str], before: Sequence[str] = (), after: Sequence[str] = ()
) -> DataFrame:
    """Put in front of each hot slice one row with the totals of all earlier (``before``) or later (``after``) slices."""
    totals = sliced.groupBy(*keys, SLICE).agg(*[F.sum(c).alias(c) for c in [*before, *after]])
    along = Window.partitionBy(*keys).orderBy(SLICE)
    back = Window.partitionBy(*keys).orderBy(F.desc(SLICE))
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    later = back.rowsBetween(Window.unboundedPreceding, -1)
    seeds = totals.select(
        *keys,
        SLICE,
        *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).cast(sliced.schema[c].dataType).alias(c) for c in before],
        *[F.coalesce(F.sum(c).over(later), F.lit(0)).cast(sliced.schema[c].dataType).alias(c) for c in after],
    ).withColumn(SEED, F.lit(0))
    return sliced.withColumn(SEED, F.lit(1)).unionByName(seeds, allowMissingColumns=True)


def join_unique(
    left: DataFrame, right: DataFrame, keys: Sequence[str], max_rows: int = TARGET_ROWS, null_safe: bool = False
) -> DataFrame:
    """Left join to a table with one row per key, with the rows of hot keys left where they are.

    Spark splits hot keys of a join by itself, unless a step that follows wants the rows grouped by the same key or one
    side comes straight out of an aggregation. This is for those cases; it counts the left keys first.

    The right rows of hot keys, one for each, are joined by their size; Spark broadcasts them while they are few. All other
    keys are joined as usual, so the right table itself may be of any size. ``null_safe`` lets null keys match.
    """
    names = {key: f"_right_{i}" for i, key in enumerate(keys)}
    table = right.select(*[F.col(c).alias(names.get(c, c)) for c in right.columns])

    def joined(rows: DataFrame, others: DataFrame) -> DataFrame:
        same = F.lit(True)
        for key, name in names.items():
            same = same & (F.col(key).eqNullSafe(F.col(name)) if null_safe else F.col(key) == F.col(name))
        return rows.join(others, same, "left").drop(*names.values())

    groups = measured(largest_groups(left, keys, F.col("_n") > max_rows))
    if groups is None:
        return joined(left, table)
    few = _join_hot(table, groups.withColumnsRenamed(names), list(names.values()), "left_semi")
    hot = joined(_join_hot(left, groups, keys, "left_semi"), sized(few))
    return hot.unionByName(joined(_join_hot(left, groups, keys, "left_anti"), table))
