"""Retention and heartbeats of jobs on a stream, by timers over state.

Time is the stream's own, its watermark; nothing looks at a clock.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Seconds a finished job is kept, and statuses that are final.
KEEP = 24 * 3600
FINAL = ("completed", "partial", "failed", "cancelled")
OUT = "job_id long, what string, ms long"


class _Watch(StatefulProcessor):
    """The last event of a job and the timer that it asks for."""

    def __init__(self, keep: int, silence: int):
        self.keep, self.silence = keep * 1000, silence * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "status string, ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen = pd.concat(list(rows))
        ms, status = max(zip(seen["ms"].tolist(), seen["status"].tolist(), strict=True))
        if not self.last.exists() or self.last.get()[1] <= ms:  # a late event changes nothing
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.last.update((status, ms))
            if status in FINAL:
                self.handle.registerTimer(ms + self.keep)
            elif status == "running":
                self.handle.registerTimer(ms + self.silence)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        status, ms = self.last.get()
        at = expiredTimerInfo.getExpiryTimeInMs()
        if status in FINAL:
            self.last.clear()
            what = "expired"
        else:  # its page counts as failed; the job itself is kept as a failed one
            self.last.update(("failed", at))
            self.handle.registerTimer(at + self.keep)
            what = "interrupted"
        yield pd.DataFrame({"job_id": [key[0]], "what": [what], "ms": [at]})

    def close(self) -> None:
        pass


def watched_jobs(events: DataFrame, keep: int = KEEP, silence: int = 600, late: str = "1 hour") -> DataFrame:
    """A streaming table of job_id, what, at for events(job_id, ts, status).

    ``expired``: a finished job ``keep`` seconds after its last event; its state goes.
    ``interrupted``: a running one that was silent for ``silence`` seconds.  A job that
    is queued or runs again in time isn't told.
    """
    known = events.withColumn("ms", F.unix_millis("ts")).withWatermark("ts", late)
    told = known.groupBy("job_id").transformWithStateInPandas(_Watch(keep, silence), OUT, "Append", "EventTime")
    return told.select("job_id", "what", F.timestamp_millis("ms").alias("at"))
