"""Progress of jobs from their events, by event time: the same on a table and on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def progress(events: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """job_id, begins, n_events, completed, failed, share, stage of events(event_id, ts,
    job_id, stage, status), by job and window of event time.

    An event counts once, however often it comes.  On a stream one that is later than
    ``late`` is passed over, and a repeated one is known for as long; a window is told
    whenever a batch changes it.  ``share`` is completed among ended; ``stage`` that of
    the last event, by time and then number.
    """
    if events.isStreaming:
        once = events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    else:
        once = events.dropDuplicates(["event_id"])
    is_ = lambda s: F.count_if(F.col("status") == s)
    by = once.groupBy("job_id", F.window("ts", window).alias("w")).agg(F.count("*").alias("n_events"), is_("completed").alias("completed"), is_("failed").alias("failed"), F.max_by("stage", F.struct("ts", "event_id")).alias("stage"))
    ended = F.col("completed") + F.col("failed")
    return by.select("job_id", F.col("w.start").alias("begins"), "n_events", "completed", "failed", F.when(ended > 0, F.col("completed") / ended).alias("share"), "stage")
