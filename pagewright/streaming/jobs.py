"""The job state machine on a stream of events, keyed by job, exactly once per event.

State by job: the latest status, sequence number and attempt.  An event of a
superseded attempt or an old sequence number is dropped; cancelled stays until
the job is queued again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "status string, seq long, attempt int"
OUT = "job_id long, status string, seq long, attempt int, accepted int, dropped int"


def advance(state: tuple | None, events) -> tuple[tuple, int, int]:
    """The state after events (seq, attempt, status) in order, and how many counted and didn't."""
    status, seq, attempt = state or (None, -1, -1)
    good = bad = 0
    for e_seq, e_attempt, e_status in events:
        if e_seq <= seq or e_attempt < attempt:
            bad += 1
            continue
        if status != "cancelled" or e_status == "queued":
            status = e_status
        seq, attempt, good = e_seq, max(attempt, e_attempt), good + 1
    return (status, seq, attempt), good, bad


def tracked_jobs(events: DataFrame) -> DataFrame:
    """A streaming table of each job's state after every batch that touches it."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["seq", "attempt"])
        new, good, bad = advance(state.get if state.exists else None, rows[["seq", "attempt", "status"]].itertuples(index=False, name=None))
        state.update(new)
        yield pd.DataFrame([(key[0], *new, good, bad)], columns=["job_id", "status", "seq", "attempt", "accepted", "dropped"])

    return events.groupBy("job_id").applyInPandasWithState(step, OUT, STATE, "update", GroupStateTimeout.NoTimeout)
