"""Output events of tool runs: frames, messages, errors and the close that ends a run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labspark.functions.text import event_message
from labspark.operators.logs import FRAMES_PER_MESSAGE, PROGRESS_TEXT
from labspark.plans.hotgroups import TARGET_ROWS, join_unique
from labspark.plans.numbering import numbered

# The kinds of output events.
FRAME, MESSAGE, ERROR, CLOSE = "frame", "message", "error", "close"

RUN_STATE = "run_id string, frame_count bigint, closed boolean"


def route_events(
    events: DataFrame,
    runs: DataFrame,
    every: int = FRAMES_PER_MESSAGE,
    text: str = PROGRESS_TEXT,
    target_rows: int = TARGET_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """Messages to show, and the state of each run afterwards.

    ``events`` has run_id, seq, event_type and message; ``runs`` is the state from before: frames counted and whether
    the run was closed. Messages and errors pass, cleaned. Of the frames every ``every``-th becomes a progress message.
    What follows a close is dropped.
    """
    closing = events.where(F.col("event_type") == CLOSE).select("run_id", F.col("seq").alias("_close"))
    known = runs.select("run_id", F.col("frame_count").alias("_counted"), F.col("closed").alias("_closed"))
    limits = (
        closing.unionByName(known, allowMissingColumns=True)
        .groupBy("run_id")
        .agg(F.min("_close").alias("_close"), F.max("_counted").alias("_counted"), F.bool_or("_closed").alias("_closed"))
    )
    open_events = join_unique(events, limits, ["run_id"], target_rows).where(
        ~F.coalesce("_closed", F.lit(False)) & (F.col("_close").isNull() | (F.col("seq") <= F.col("_close")))
    )
    frames = open_events.where(F.col("event_type") == FRAME)
    counted = numbered(frames.select("run_id", "seq", "_counted"), ["run_id"], ["seq"], "_number")
    total = F.col("_number") + F.coalesce("_counted", F.lit(0))
    shown_frames = counted.where(total % every == 0).select(
        "run_id", "seq", F.lit(MESSAGE).alias("event_type"), F.format_string(text, total).alias("message")
    )
    shown = open_events.where(F.col("event_type").isin(MESSAGE, ERROR)).select(
        "run_id", "seq", "event_type", event_message(F.col("event_type"), F.col("message")).alias("message")
    )
    seen = open_events.groupBy("run_id").agg(
        F.count_if(F.col("event_type") == FRAME).alias("frame_count"),
        F.bool_or(F.col("event_type") == CLOSE).alias("closed"),
    )
    after = (
        runs.unionByName(seen)
        .groupBy("run_id")
        .agg(F.sum("frame_count").alias("frame_count"), F.bool_or("closed").alias("closed"))
    )
    return shown.unionByName(shown_frames), after
