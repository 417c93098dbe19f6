"""Sequence numbers per session on a stream of events.

Numbers are given per micro-batch in plain DataFrame operations, so one session
with very many events is still spread over tasks. The last number of every session is keyed
state: a batch writes the counters of its own sessions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarry.operators.conversation import assign_order
from quarry.streaming.batches import run_batches, write_batch
from quarry.streaming.state import KeyedState

_COUNTERS = "session_id {type}, last_order BIGINT"


def number_stream(
    events: DataFrame, order: Column, block: Column, path: str, checkpoint: str, once: bool = True
) -> StreamingQuery:
    """Write events with `num_order` to `path/events` and counters to `path/counters`.

    A batch that runs again finds the same counters, overwrites its own
    folders and gives the same numbers.
    """
    key_type = events.schema["session_id"].dataType.simpleString()

    def handle(rows: DataFrame, batch_id: int) -> None:
        spark = rows.sparkSession
        counters = KeyedState(spark, f"{path}/counters", _COUNTERS.format(type=key_type), ["session_id"])
        counters.clean(batch_id)
        write_batch(assign_order(rows, counters.read(batch_id), order, block), f"{path}/events", batch_id)
        written = spark.read.parquet(f"{path}/events/batch_id={batch_id}")
        counters.write(written.groupBy("session_id").agg(F.max("num_order").cast("long").alias("last_order")), batch_id)

    return run_batches(events, handle, checkpoint, once)
