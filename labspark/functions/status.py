"""Job, step and cluster states."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The state names of steps and clusters.
TERMINAL_STEP_STATES = ("COMPLETED", "FAILED", "CANCELLED")
READY_CLUSTER_STATES = ("RUNNING", "WAITING")
ACTIVE_CLUSTER_STATES = ("STARTING", "BOOTSTRAPPING", "RUNNING", "WAITING")
TERMINATED_CLUSTER_STATES = ("TERMINATED", "TERMINATED_WITH_ERRORS")


def job_status(succeeded: Column, failed: Column, active: Column, completions: Column) -> Column:
    """Status by completions reached; absent counters are 0 and absent completions 1."""
    done = F.coalesce(succeeded, F.lit(0)) >= F.coalesce(completions, F.lit(1))
    return (
        F.when(done, F.lit("Completed"))
        .when(failed > 0, F.lit("Failed"))
        .when(active > 0, F.lit("Running"))
        .otherwise(F.lit("Pending"))
    )


def job_status_by_activity(succeeded: Column, failed: Column, active: Column) -> Column:
    """Status by what is going on now, whatever the wanted completions."""
    return (
        F.when(active > 0, F.lit("Running"))
        .when(succeeded > 0, F.lit("Completed"))
        .when(failed > 0, F.lit("Failed"))
        .otherwise(F.lit("Unknown"))
    )


def in_states(state: Column, states: tuple[str, ...]) -> Column:
    return F.coalesce(state.isin(*states), F.lit(False))


def is_terminal_step(state: Column) -> Column:
    return in_states(state, TERMINAL_STEP_STATES)


def is_ready_cluster(state: Column) -> Column:
    return in_states(state, READY_CLUSTER_STATES)


def is_active_cluster(state: Column) -> Column:
    return in_states(state, ACTIVE_CLUSTER_STATES)


def is_terminated_cluster(state: Column) -> Column:
    return in_states(state, TERMINATED_CLUSTER_STATES)


def age_seconds(created: Column, as_of: Column) -> Column:
    return F.timestamp_diff("SECOND", created, as_of)


def ready_of_total(ready: Column, total: Column) -> Column:
    """``ready/total`` with a total of at least 1."""
    return F.concat_ws("/", F.coalesce(ready, F.lit(0)), F.greatest(F.coalesce(total, F.lit(0)), F.lit(1)))
