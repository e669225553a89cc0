"""Jobs, steps and pods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labspark.functions.status import age_seconds, job_status, ready_of_total


def job_overview(df: DataFrame, as_of: Column) -> DataFrame:
    """Status, ``done/wanted`` text and age of jobs with succeeded, failed, active and completions counters."""
    return df.select(
        "*",
        job_status(F.col("succeeded"), F.col("failed"), F.col("active"), F.col("completions")).alias("status"),
        F.concat_ws(
            "/", F.coalesce("succeeded", F.lit(0)), F.coalesce("completions", F.lit(1))
        ).alias("completed"),
        age_seconds(F.col("created"), as_of).alias("age_seconds"),
    )


def named(df: DataFrame, part: str | None, name: str = "name") -> DataFrame:
    """Jobs whose name holds the text; all when there is none."""
    return df if part is None else df.where(F.col(name).contains(part))


def oldest_first(df: DataFrame, created: str = "created", tie: str = "name") -> DataFrame:
    return df.orderBy(F.asc_nulls_last(created), F.asc(tie))


def most_recent(df: DataFrame, n: int, start: str = "start_time", tie: str = "step_id") -> DataFrame:
    """The ``n`` rows started last, in order; rows without a start come last."""
    return df.orderBy(F.desc_nulls_last(start), F.asc(tie)).limit(n)


def pod_readiness(df: DataFrame, containers: str = "containers", floor: Column | None = None) -> DataFrame:
    """``ready/total`` and restarts from a list of containers; ``floor`` is a lower bound for the total."""
    items = F.col(containers)
    n_ready = F.size(F.filter(items, lambda c: F.coalesce(c["ready"], F.lit(False))))
    total = F.coalesce(F.size(items), F.lit(0))
    restarts = F.aggregate(
        items, F.lit(0).cast("bigint"), lambda done, c: done + F.coalesce(c["restart_count"], F.lit(0))
    )
    return df.select(
        "*",
        ready_of_total(F.greatest(n_ready, F.lit(0)), total if floor is None else F.greatest(total, floor)).alias("ready"),
        F.coalesce(restarts, F.lit(0)).alias("restarts"),
    )


def pod_readiness_by_rows(df: DataFrame, pod: str, ready: str = "ready", restarts: str = "restart_count") -> DataFrame:
    """The same from one row per container."""
    return df.groupBy(pod).agg(
        ready_of_total(F.count_if(F.col(ready)), F.count(F.lit(1))).alias("ready"),
        F.coalesce(F.sum(restarts), F.lit(0)).alias("restarts"),
    )
