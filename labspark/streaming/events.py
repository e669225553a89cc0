"""The output event stream: route by kind, sample frames, end runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from labspark.operators.events import RUN_STATE, route_events
from labspark.operators.logs import FRAMES_PER_MESSAGE, PROGRESS_TEXT
from labspark.plans.hotgroups import TARGET_ROWS
from labspark.streaming.batches import Carried, run, store_batch


def run_event_route(
    stream: DataFrame,
    out: str,
    state: str,
    checkpoint: str,
    frames_per_message: int = FRAMES_PER_MESSAGE,
    text: str = PROGRESS_TEXT,
    every: str | None = None,
    target_rows: int = TARGET_ROWS,
) -> StreamingQuery:
    """Store the messages to show; frame counts and closed runs are carried between batches."""
    carried = Carried(state, T.StructType.fromDDL(RUN_STATE))

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        events = batch.select("run_id", "seq", "event_type", "message").persist()
        try:
            runs = carried.before(batch.sparkSession, batch_id)
            shown, after = route_events(events, runs, frames_per_message, text, target_rows)
            store_batch(shown, out, batch_id)
            carried.after(after, batch_id)
        finally:
            events.unpersist()

    return run(stream, on_batch, checkpoint, every)
