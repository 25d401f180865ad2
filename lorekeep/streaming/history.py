"""Streaming event history: the newest N events of every stream, kept as keyed state, and its changes as rows."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from lorekeep.operators.events import MAX_EVENTS

EVENT = StructType(
    [
        StructField("stream_id", StringType()),
        StructField("event_id", StringType()),
        StructField("seq", LongType()),
        StructField("message", StringType()),
    ]
)
# A change of a history: an event that came to be kept, or one (without its message) that no longer is.
CHANGE = StructType([*EVENT.fields, StructField("kept", BooleanType())])
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_NAMES = EVENT.fieldNames()


def _newest(events: pd.DataFrame, n: int) -> pd.DataFrame:
    """Newest ``n`` rows per stream; an event delivered twice counts once."""
    once = events.drop_duplicates(["stream_id", "seq"]).sort_values(["stream_id", "seq"])
    return once.groupby("stream_id", sort=False).tail(n)


def trim_locally(n: int):
    """Map-side reduction: no batch of a task sends more than ``n`` events of one stream to the shuffle. Nothing
    is held from batch to batch, so a task of many streams needs no more memory than one batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield _newest(batch, n)

    return run


class _History(StatefulProcessor):
    def __init__(self, n: int):
        self.n = n

    def init(self, handle: StatefulProcessorHandle) -> None:
        # One text for a stream: each row of a list state is sent and packed by itself.
        self.kept = handle.getValueState("kept", "events string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        """Plain rows: a trigger brings a stream few events, for which frames cost far more than the work."""
        known = self.kept.get()
        held = {event[1]: tuple(event) for event in json.loads(known[0])} if known else {}
        fresh = dict(held)
        for row in rows:
            fresh.setdefault(row["seq"], (row["event_id"], row["seq"], row["message"]))
        newest = sorted(fresh)[-self.n :]
        come = [seq for seq in newest if seq not in held]
        if not come:
            return
        self.kept.update((json.dumps([fresh[seq] for seq in newest], ensure_ascii=False),))
        for seq in come:
            event_id, _, message = fresh[seq]
            yield Row(stream_id=key[0], event_id=event_id, seq=seq, message=message, kept=True)
        for seq in held.keys() - set(newest):
            yield Row(stream_id=key[0], event_id=held[seq][0], seq=seq, message=None, kept=False)

    def close(self) -> None:
        pass


def stream_last_n(events: DataFrame, n: int = MAX_EVENTS) -> DataFrame:
    """What changed in a trigger (update mode, ``CHANGE``): events that came to be kept and events that left. What a
    stream held before and still holds is not sent again, so the rows are at most twice the new events.

    ``events`` is a streaming frame of ``EVENT``. Evicted events leave the state with their ids, so a
    later replay from them finds nothing. Needs the RocksDB state store (``ROCKSDB``).
    """
    trimmed = events.select(*_NAMES).mapInPandas(trim_locally(n), EVENT)
    return trimmed.groupBy("stream_id").transformWithState(
        statefulProcessor=_History(n), outputStructType=CHANGE, outputMode="Update", timeMode="None"
    )


def write_history(history: DataFrame, path: str, checkpoint: str, **trigger):
    """Starts the query that appends each trigger's changes under ``path``, one folder per batch.
    A batch that is run again replaces its own folder."""

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        history.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(save)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def read_history(batches: DataFrame) -> DataFrame:
    """The retained history from the changes that ``write_history`` stored: events that came and did not leave. An event
    that left is older than all that are kept and never comes back, so the order of changes does not matter."""
    merged = batches.groupBy("stream_id", "seq").agg(F.max("event_id").alias("event_id"), F.max("message").alias("message"), F.min("kept").alias("kept"))
    return merged.filter("kept").select(*_NAMES)
