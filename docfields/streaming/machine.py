"""Q3 and Q7 as keyed state: a document's status moves along allowed transitions only, and a failed one waits before its next try.

Needs protobuf beside PySpark on the workers, and a state store that keeps several states per key (RocksDB).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from docfields.operators.status import COMPLETED, FAILED, IN_PROGRESS, NOT_STARTED

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ACCEPTED, REJECTED, HELD, RELEASED = "accepted", "rejected", "held", "released"
OUT = "doc_id long, event_id long, status string, us long, attempt int, outcome string"


class StatusMachine(StatefulProcessor):
    """One state per document: (status, attempt, earliest start of that attempt in microseconds, start held back)."""

    def __init__(self, retries: int, backoff_seconds: int):
        self.retries, self.backoff = retries, backoff_seconds * 1_000_000

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("status", "status string, attempt int, not_before long, held boolean")

    def step(self, state: tuple, status: str, us: int) -> tuple[tuple, str]:
        """(new state, outcome) of one event."""
        now, attempt, not_before, _ = state
        if status == NOT_STARTED and now is None:
            return (NOT_STARTED, 1, None, False), ACCEPTED
        if status == IN_PROGRESS and now == NOT_STARTED:
            if not_before is None or us >= not_before:
                return (IN_PROGRESS, attempt, None, False), ACCEPTED
            if not state[3]:
                return (NOT_STARTED, attempt, not_before, True), HELD
        if status in (COMPLETED, FAILED) and now == IN_PROGRESS:
            if status == FAILED and attempt <= self.retries:
                return (NOT_STARTED, attempt + 1, us + self.backoff, False), ACCEPTED
            return (status, attempt, None, False), ACCEPTED
        return state, REJECTED

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(["us", "event_id"])
        state = before = self.state.get() or (None, 0, None, False)
        out = []
        for event_id, status, us in zip(events["event_id"], events["status"], events["us"]):
            if state[3] and us >= state[2]:
                out.append((key[0], None, IN_PROGRESS, state[2], state[1], RELEASED))
                state = (IN_PROGRESS, state[1], None, False)
            tried = state[1]
            state, outcome = self.step(state, status, int(us))
            out.append((key[0], event_id, status, us, tried or state[1], outcome))
        # a held start gets a timer; it goes when a later event has released the start already
        if before[3] and before != state:
            self.handle.deleteTimer(_millis(before[2]))
        if state[3] and before != state:
            self.handle.registerTimer(_millis(state[2]))
        self.state.update(state)
        yield _frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        status, attempt, not_before, held = self.state.get()
        self.state.update((IN_PROGRESS, attempt, None, False))
        yield _frame([(key[0], None, IN_PROGRESS, not_before, attempt, RELEASED)])

    def close(self) -> None:
        pass


def _millis(us: int) -> int:
    """The first full millisecond at or after a time."""
    return -(-us // 1000)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=["doc_id", "event_id", "status", "us", "attempt", "outcome"])
    return frame.astype({"event_id": "Int64", "us": "int64", "attempt": "int32"})


def transitions(events: DataFrame, retries: int = 2, backoff_seconds: int = 5, late: str = "0 seconds") -> DataFrame:
    """What becomes of every event (doc_id, event_id, status, at) of a stream, and every held start when its time has come.

    Allowed are Not Started -> In Progress -> Completed or Failed. A failed try that may be repeated puts its document back to Not
    Started; it may start again ``backoff_seconds`` later. An In Progress event before that time is ``held`` once, and ``released``
    (event_id NULL) at that time by a later event or by the event-time timer, whichever comes first. Anything else, repeated events
    included, is ``rejected``. ``attempt`` is the try an event met (0: the document is unknown). Events without doc_id, status or time are left out.
    Events of one batch are taken in order of (at, event_id); an event older than the watermark of the batches before is dropped by Spark.
    The events of one document in one batch are sorted in memory; the intake's files per trigger bound them.
    """
    known = events.filter(F.col("doc_id").isNotNull() & F.col("status").isNotNull() & F.col("at").isNotNull())
    rows = known.select(F.col("doc_id").cast("long"), F.col("event_id").cast("long"), "status", "at", F.unix_micros("at").alias("us")).withWatermark("at", late)
    return rows.groupBy("doc_id").transformWithStateInPandas(
        StatusMachine(retries, backoff_seconds), outputStructType=OUT, outputMode="Append", timeMode="EventTime")


def drain_transitions(events: DataFrame, out: str, checkpoint: str, **how) -> StreamingQuery:
    """Start ``transitions`` on a stream of events, append to ``out`` and end when everything there has been taken up."""
    spark = events.sparkSession
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKSDB)
    try:
        return (transitions(events, **how).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
                .trigger(availableNow=True).start())
    finally:
        spark.conf.set(key, before)
