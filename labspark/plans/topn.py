"""Newest rows per group and the cut between kept and surplus rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labspark.plans.hotgroups import sized


# Spark cuts groups before the shuffle only for ranks up to its own limit, 1000 by default.
EARLY_CUT = 1000
SPREAD = 256


def first_n(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    n: int,
    rank: str | None = None,
    spread: str | None = None,
) -> DataFrame:
    """The first ``n`` rows of each group.

    A rank filter of this form lets Spark cut every map task to ``n`` rows per group before the shuffle, so a hot group
    sends at most ``n`` rows per task. For larger ``n`` the groups are first cut in parts, by a hash of ``spread``.
    """
    name = rank or "_rank"
    if n > EARLY_CUT and spread:
        parts = df.withColumn("_part", F.pmod(F.xxhash64(spread), F.lit(SPREAD)))
        within = Window.partitionBy(*keys, "_part").orderBy(*order)
        df = parts.withColumn("_rank", F.row_number().over(within)).where(F.col("_rank") <= n).select(*df.columns)
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    kept = ranked.where(F.col(name) <= n)
    return kept.withColumn(name, F.col(name).cast("bigint")) if rank else kept.drop(name)


def newest_n(df: DataFrame, keys: Sequence[str], at: str, tie: str, n: int) -> DataFrame:
    """The newest ``n`` rows per group; equal times are taken in rising ``tie``."""
    return first_n(df, keys, [F.desc(at), F.asc(tie)], n, spread=tie)


def mark_beyond_n(df: DataFrame, keys: Sequence[str], at: str, tie: str, n: int, flag: str) -> DataFrame:
    """Add a boolean ``flag`` that is true for rows beyond the newest ``n`` of their group.

    Only the n-th row of each group is computed; it is joined back and compared, so no group is sorted in one task. The
    cut table has one row per group. It is stored first, so that Spark knows its true size before it plans the join:
    small enough, it is broadcast and the large side is not shuffled at all; else hot groups are split by Spark.
    """
    if n <= 0:
        return df.withColumn(flag, F.lit(True))
    kept = first_n(df.select(*keys, at, tie), keys, [F.desc(at), F.asc(tie)], n, rank="_rank", spread=tie)
    cuts = (
        kept.groupBy(*keys)
        .agg(F.max_by(F.struct(F.col(at).alias("at"), F.col(tie).alias("tie")), "_rank").alias("_cut"))
        .select(*[F.col(k).alias(f"_cut_{i}") for i, k in enumerate(keys)], "_cut")
    )
    cuts = sized(cuts)
    condition = F.lit(True)
    for i, key in enumerate(keys):
        condition = condition & F.col(key).eqNullSafe(F.col(f"_cut_{i}"))
    # As in the ranking, a row without a tie comes first among rows of its time.
    later_tie = F.coalesce(F.col(tie) > F.col("_cut.tie"), F.col(tie).isNotNull() & F.col("_cut").isNotNull())
    beyond = (
        F.when(F.col(at).isNull(), F.col("_cut.at").isNotNull() | later_tie)
        .when(F.col("_cut.at").isNull(), F.lit(False))
        .otherwise((F.col(at) < F.col("_cut.at")) | ((F.col(at) == F.col("_cut.at")) & later_tie))
    )
    return df.join(cuts, condition, "left").select(*df.columns, beyond.alias(flag))
