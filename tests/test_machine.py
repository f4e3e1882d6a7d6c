"""The status machine: allowed transitions, waiting after a failure, the third failure, odd events."""

from datetime import datetime, timedelta

from docfields.operators.status import COMPLETED, FAILED, IN_PROGRESS, NOT_STARTED
from docfields.streaming.machine import StatusMachine, drain_transitions

START = datetime(2024, 1, 1)
SECOND = 1_000_000


def test_steps():
    m = StatusMachine(retries=2, backoff_seconds=5)
    state, outcomes = (None, 0, None, False), []
    for status, second in [(COMPLETED, 0), (NOT_STARTED, 1), (NOT_STARTED, 2), (FAILED, 3), (IN_PROGRESS, 4), (IN_PROGRESS, 4), (FAILED, 5), (IN_PROGRESS, 10),
                           (FAILED, 11), (IN_PROGRESS, 12), (IN_PROGRESS, 13), (COMPLETED, 13)]:
        state, outcome = m.step(state, status, second * SECOND)
        outcomes.append(outcome)
    assert outcomes == ["rejected", "accepted", "rejected", "rejected", "accepted", "rejected", "accepted", "accepted", "accepted", "held", "rejected", "rejected"]
    assert state == (NOT_STARTED, 3, 16 * SECOND, True)
    state, _ = m.step(m.step((NOT_STARTED, 3, 16 * SECOND, False), IN_PROGRESS, 16 * SECOND)[0], FAILED, 17 * SECOND)
    assert state == (FAILED, 3, None, False) and m.step(state, IN_PROGRESS, 99 * SECOND)[1] == "rejected"


def test_stream_holds_back_and_releases(spark, tmp_path):
    schema = "doc_id long, event_id long, status string, at timestamp"

    def run(rows):
        spark.createDataFrame([(d, e, s, None if at is None else START + timedelta(seconds=at)) for d, e, s, at in rows], schema).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        drain_transitions(stream, f"{tmp_path}/out", f"{tmp_path}/check", backoff_seconds=10).awaitTermination()
        return {(r["doc_id"], r["event_id"], r["outcome"], r["attempt"]) for r in spark.read.schema("doc_id long, event_id long, outcome string, attempt int").parquet(f"{tmp_path}/out").collect()}

    assert run([]) == set()
    # out of order within a batch, repeated, and with nulls
    first = run([(1, 3, FAILED, 3), (1, 2, IN_PROGRESS, 2), (1, 1, NOT_STARTED, 1), (1, 1, NOT_STARTED, 1), (1, 4, IN_PROGRESS, 4),
                 (None, 5, FAILED, 5), (2, 6, None, 6), (2, 7, FAILED, None), (2, 8, COMPLETED, 5)])
    assert first == {(1, 1, "accepted", 1), (1, 1, "rejected", 1), (1, 2, "accepted", 1), (1, 3, "accepted", 1), (1, 4, "held", 2), (2, 8, "rejected", 0)}
    # another document moves the time on: the held start is released by its timer
    second = run([(3, 9, NOT_STARTED, 30)])
    assert second - first == {(1, None, "released", 2), (3, 9, "accepted", 1)}
    assert run([(1, 10, COMPLETED, 31)]) - second == {(1, 10, "accepted", 2)}
