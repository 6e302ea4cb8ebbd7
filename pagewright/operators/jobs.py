"""Jobs, pages and attempts as tables: status rollups, retries, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def n(condition: Column, name: str) -> Column:
    return F.count_if(condition).alias(name)


def routing_summary(pages: DataFrame) -> DataFrame:
    s, r = F.col("status"), F.col("route")
    return pages.groupBy("job_id").agg(n(s == "completed", "completed"), n(s == "blank", "blank"), n(s == "failed", "failed"), *(n(r == x, x) for x in ("direct_text", "ocr_image", "hybrid")))


def job_status(pages: DataFrame) -> DataFrame:
    """completed if all pages are, partial if some are, else failed."""
    s = F.col("status")
    good, part = s.isin("completed", "blank"), s == "partial"
    return pages.groupBy("job_id").agg(F.when(F.bool_and(good), "completed").when(F.bool_or(good | part), "partial").otherwise("failed").alias("job_status"))


def progress(pages: DataFrame, batch: int = 200) -> DataFrame:
    """Counts (blank pages are done), batches, and the batch of the first open page."""
    s = F.col("status")
    rows = pages.withColumn("_i", F.row_number().over(Window.partitionBy("job_id").orderBy("page_id")) - 1)
    first = F.min(F.when(s.isin("queued", "running"), F.col("_i")))
    batches = F.ceil(F.count("*") / batch)
    return rows.groupBy("job_id").agg(n(s.isin("completed", "blank"), "completed"), n(s == "failed", "failed"), n(s == "cancelled", "cancelled"), batches.alias("batches"), F.coalesce(F.floor(first / batch) + 1, batches).alias("batch"))


def crash_recovery(pages: DataFrame) -> DataFrame:
    """Running pages failed while nobody looked; queued ones stay queued."""
    return pages.withColumn("status", F.when(F.col("status") == "running", "failed").otherwise(F.col("status")))


def crash_status(pages: DataFrame) -> DataFrame:
    """A job after a crash: partial if a page was completed (blank ones don't count here)."""
    return pages.groupBy("job_id").agg(F.when(F.count_if(F.col("status") == "completed") > 0, "partial").otherwise("failed").alias("job_status"))


def retry_pages(pages: DataFrame, mode: str) -> DataFrame:
    good, ai = F.col("status").isin("completed", "blank"), F.col("ai_status") == "completed"
    which = {"full": F.lit(True), "failed_only": ~good, "ai_only": good & ~ai, "full_text_ai": good}[mode]
    return pages.where(which)


def expired(jobs: DataFrame, now: Column, hours: float = 24) -> DataFrame:
    """Finished jobs not touched for ``hours``; 0 takes all; times that can't be read never expire otherwise."""
    done = F.col("status").isin("completed", "partial", "failed", "cancelled")
    age = F.unix_timestamp(now) - F.unix_timestamp(F.try_to_timestamp("updated_at"))
    return jobs.where(done & (F.lit(hours <= 0) | F.coalesce(age >= hours * 3600, F.lit(False))))


def latest(jobs: DataFrame, limit: int) -> DataFrame:
    """The latest jobs by creation; -1 is all of them."""
    rows = jobs.orderBy(F.desc("created_at"), "job_id")
    return rows if limit < 0 else rows.limit(limit)


def cascade(tables: dict[str, DataFrame], deleted: DataFrame) -> dict[str, DataFrame]:
    """The tables without the rows of deleted jobs."""
    return {k: df.join(deleted.select("job_id"), "job_id", "left_anti") for k, df in tables.items()}


def current_state(events: DataFrame) -> DataFrame:
    """job_id, status, seq: the latest by sequence, but cancelled stays until a later queued; events of superseded attempts don't count."""
    own = Window.partitionBy("job_id").orderBy("seq")
    so_far = own.rowsBetween(Window.unboundedPreceding, 0)
    live = events.withColumn("_a", F.max("attempt").over(so_far)).where("attempt >= _a")
    live = live.withColumn("_q", F.coalesce(F.max(F.when(F.col("status") == "queued", F.col("seq"))).over(so_far), F.lit(-1)))
    live = live.withColumn("_c", F.coalesce(F.max(F.when(F.col("status") == "cancelled", F.col("seq"))).over(so_far), F.lit(-1)))
    live = live.withColumn("_s", F.when(F.col("_c") > F.col("_q"), "cancelled").otherwise(F.col("status")))
    return live.groupBy("job_id").agg(F.max_by("_s", "seq").alias("status"), F.max("seq").alias("seq"), F.max("attempt").alias("attempt"))


def next_attempt(attempts: DataFrame) -> DataFrame:
    """One more attempt, queued, for each job."""
    return attempts.groupBy("job_id").agg((F.max("attempt") + 1).alias("attempt")).withColumn("status", F.lit("queued"))


def queue(jobs: DataFrame, capacity: int = 1) -> DataFrame:
    """One row: how many jobs run and wait, and the room left."""
    return jobs.agg(n(F.col("status") == "running", "active"), n(F.col("status") == "queued", "queued")).withColumn("room", F.greatest(F.lit(0), F.lit(capacity) - F.col("active")))


def waiting(jobs: DataFrame) -> DataFrame:
    """job_id, position of the jobs that wait, oldest first: ranked within a day, after
    the days before it, so no task holds them all."""
    rows = jobs.where("status = 'queued'").select("job_id", "created_at", F.substring("created_at", 1, 10).alias("day"))
    own = Window.partitionBy("day").orderBy("created_at", "job_id")
    days = rows.groupBy("day").agg(F.count("*").alias("n"))  # a row a day
    before = F.coalesce(F.sum("n").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("r", F.row_number().over(own)).join(days.select("day", before.alias("base")), "day").select("job_id", (F.col("base") + F.col("r") - 1).alias("position"))


def started(queued: DataFrame, queues: DataFrame) -> DataFrame:
    """queue_id, job_id, starts of queued(queue_id, job_id, pos, uses_model): in order,
    as many as queues(queue_id, running, capacity, model_busy) have room for; one that
    needs the model while it is in use holds up all behind it."""
    upto = Window.partitionBy("queue_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = queued.withColumn("_n", F.count("*").over(upto)).withColumn("_m", F.sum(F.col("uses_model").cast("int")).over(upto)).join(queues, "queue_id")
    fits = (F.col("_n") <= F.col("capacity") - F.col("running")) & (F.col("_m") + F.col("model_busy").cast("int") * (F.col("_m") > 0).cast("int") <= 1)
    return rows.select("queue_id", "job_id", fits.alias("starts"))


def page_range(pages: DataFrame, requests: DataFrame) -> DataFrame:
    """Pages that a valid start request (job_id, first, last; the job queued, 1 <= first <= last <= pages) leaves."""
    total = pages.groupBy("job_id").agg(F.count("*").alias("_n"))
    valid = requests.join(total, "job_id").where((F.col("status") == "queued") & (F.col("first") >= 1) & (F.col("first") <= F.col("last")) & (F.col("last") <= F.col("_n"))).select("job_id", "first", "last")
    return pages.join(valid, "job_id").where(F.col("page_id").between(F.col("first"), F.col("last"))).drop("first", "last")


def page_batches(pages: DataFrame, size: int = 200) -> DataFrame:
    """Pages with the batch of ``size`` that they are in, by number within their job.
    Numbers alone are sorted; what else a page has joins them afterwards."""
    nth = F.row_number().over(Window.partitionBy("job_id").orderBy("page_id")) - 1
    ranked = pages.select("job_id", "page_id").distinct().withColumn("batch", F.floor(nth / size).cast("int"))
    return pages.join(ranked, ["job_id", "page_id"])


def edits_saved(pages: DataFrame, edits: DataFrame) -> DataFrame:
    """page_id, outcome, revision, manual, review of edits(page_id, expected, manual) to
    pages(page_id, revision, manual, review): one made for another revision conflicts,
    else the revision grows by one, the job goes into review, and the manual mark is
    set by a manual edit and never taken away."""
    now = pages.select("page_id", "revision", F.col("manual").alias("_m"), F.col("review").alias("_r"))
    got = edits.join(now, "page_id", "left")
    outcome = F.when(F.col("revision").isNull(), "unknown_page").when(F.col("expected") != F.col("revision"), "conflict").otherwise("saved")
    saved = outcome == "saved"
    return got.select("page_id", outcome.alias("outcome"), F.when(saved, F.col("revision") + 1).otherwise(F.col("revision")).alias("revision"), F.when(saved, F.col("_m") | F.col("manual")).otherwise(F.col("_m")).alias("manual"), F.when(saved, "in_review").otherwise(F.col("_r")).alias("review"))


#: The size of a page whose image isn't known, and the transform of one that isn't turned.
PAGE_SIZE = (1000, 1400)
UPRIGHT = {"angle": 0.0, "scale_x": 1.0, "scale_y": 1.0, "translate_x": 0.0, "translate_y": 0.0}


def _with_texts(pages: DataFrame) -> DataFrame:
    """The texts with the raw one where there is no other, and whether they differ from it."""
    from .correct import changed

    raw = F.coalesce("raw", F.lit(""))
    return pages.withColumns({"raw": raw, "corrected": F.coalesce("corrected", raw), "final": F.coalesce("final", raw), "changed": changed(raw, F.col("corrected"), F.col("final"))})


def page_view(pages: DataFrame, jobs: DataFrame) -> DataFrame:
    """Pages (job_id, page_id, raw, corrected, final) with their job's status, the three
    texts with the raw one where there is no other, and whether they differ from it."""
    own = pages.join(jobs.select("job_id", F.col("status").alias("job_status")), "job_id", "left")
    return _with_texts(own).select("job_id", "page_id", "job_status", "raw", "corrected", "final", "changed")


def page_data(pages: DataFrame, jobs: DataFrame, spans: DataFrame, changes: DataFrame, images: DataFrame) -> DataFrame:
    """``page_view`` with what a page's editor needs beside the texts.

    spans and changes (arrays in order) come from spans(job_id, page_id, block_id,
    line_index, start, end) and changes(job_id, page_id, change_id, start, end, original,
    corrected, status); width, height and transform from images(job_id, page_id, width,
    height, transform), 1000 x 1400 and upright where there is none.  Spans say where
    lines are in the raw text.
    """
    key = ["job_id", "page_id"]
    listed = lambda df, name, *columns: df.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))
    # what is narrow is put together first, so the texts are moved once
    beside = listed(spans, "spans", "start", "end", "block_id", "line_index")
    beside = beside.join(listed(changes, "changes", "start", "end", "change_id", "original", "corrected", "status"), key, "full")
    beside = beside.join(images.select(*key, "width", "height", "transform"), key, "full")
    states = jobs.select("job_id", F.col("status").alias("job_status"))
    beside = pages.select(*key).distinct().join(states, "job_id", "left").join(beside, key, "left")
    got = _with_texts(pages.join(beside, key))
    upright = F.struct(*(F.lit(v).alias(n) for n, v in UPRIGHT.items()))
    none = lambda c: F.coalesce(c, F.array().cast(beside.schema[c].dataType)).alias(c)
    return got.select(*key, "job_status", "raw", "corrected", "final", "changed", none("spans"), none("changes"), F.coalesce("width", F.lit(PAGE_SIZE[0])).alias("width"), F.coalesce("height", F.lit(PAGE_SIZE[1])).alias("height"), F.coalesce("transform", upright).alias("transform"))


def staleness(exports: DataFrame, now: DataFrame, parts=("source", "glossary", "validator")) -> DataFrame:
    """key, stale, reasons: which revisions that an export was made from have changed since."""
    got = exports.alias("e").join(now.alias("n"), "key", "left")
    reasons = F.array_compact(F.array(*(F.when(~F.col(f"e.{p}").eqNullSafe(F.col(f"n.{p}")), F.lit(f"{p}_changed")) for p in parts)))
    return got.select("key", (F.size(reasons) > 0).alias("stale"), F.array_join(reasons, ",").alias("reasons"))


def review_state(pages: DataFrame) -> DataFrame:
    """An edit puts a page in review; a new attempt takes a reviewed one back there."""
    s = F.col("review")
    return pages.withColumn("review", F.when(F.col("edited"), "in_review").when(F.col("new_attempt") & (s == "reviewed"), "in_review").otherwise(s))


def deletions(jobs: DataFrame, requests: DataFrame) -> DataFrame:
    """job_id, outcome: running jobs only by force, unknown ones are orphans."""
    got = requests.join(jobs.select("job_id", "status"), "job_id", "left")
    return got.select("job_id", F.when(F.col("status").isNull(), "orphan_removed").when((F.col("status") == "running") & ~F.col("force"), "refused").otherwise("deleted").alias("outcome"))
