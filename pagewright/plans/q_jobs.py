"""Queries of jobs, pages, attempts and their events."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewright.operators import jobs, merge
from pagewright.streaming import progress as events_progress

from . import inputs as I

QUERIES: dict = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = (fn, sql)
        return fn

    return add


@query("A1_routing_summary", f"WITH {I.PAGES} SELECT job_id, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'blank') AS blank, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (route = 'direct_text') AS direct_text, count(*) FILTER (route = 'ocr_image') AS ocr_image, count(*) FILTER (route = 'hybrid') AS hybrid FROM pg GROUP BY job_id")
def summary(spark, d):
    return jobs.routing_summary(I.pages(spark, d))


@query("A2_job_status", f"WITH {I.PAGES} SELECT job_id, CASE WHEN bool_and(status IN ('completed', 'blank')) THEN 'completed' WHEN bool_or(status IN ('completed', 'blank')) THEN 'partial' ELSE 'failed' END AS job_status FROM pg GROUP BY job_id")
def status(spark, d):
    return jobs.job_status(I.pages(spark, d))


@query("A15_progress", f"WITH {I.PAGES}, r AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY page_id) - 1 AS i FROM pg) SELECT job_id, count(*) FILTER (status IN ('completed', 'blank')) AS completed, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'cancelled') AS cancelled, ceil(count(*) / 2)::BIGINT AS batches, coalesce(min(i) FILTER (status IN ('queued', 'running')) // 2 + 1, ceil(count(*) / 2))::BIGINT AS batch FROM r GROUP BY job_id")
def progress(spark, d):
    return jobs.progress(I.pages(spark, d), 2)


@query("A19_T5_crash_recovery", f"WITH {I.PAGES} SELECT job_id, CASE WHEN count(*) FILTER (status = 'completed') > 0 THEN 'partial' ELSE 'failed' END AS job_status FROM pg GROUP BY job_id")
def crash(spark, d):
    return jobs.crash_status(jobs.crash_recovery(I.pages(spark, d)))


for _mode, _where in (("failed_only", "status NOT IN ('completed', 'blank')"), ("ai_only", "status IN ('completed', 'blank') AND ai_status <> 'completed'"), ("full_text_ai", "status IN ('completed', 'blank')")):

    @query(f"T4_retry_{_mode}", f"WITH {I.PAGES} SELECT job_id, page_id FROM pg WHERE {_where}")
    def retry(spark, d, mode=_mode):
        return jobs.retry_pages(I.pages(spark, d), mode).select("job_id", "page_id")


@query("T6_retention", f"WITH {I.JOBS} SELECT job_id FROM jb WHERE status = 'completed' AND TIMESTAMP '2001-01-01' - try_cast(updated_at AS TIMESTAMP) >= INTERVAL 24 HOUR")
def expired(spark, d):
    return jobs.expired(I.jobs(spark, d), F.lit("2001-01-01 00:00:00").cast("timestamp")).select("job_id")


@query("O1_latest_jobs", f"WITH {I.JOBS} SELECT job_id, status FROM jb ORDER BY created_at DESC, job_id LIMIT 50")
def latest(spark, d):
    return jobs.latest(I.jobs(spark, d), 50).select("job_id", "status")


@query("J18_U3_delete_cascade", f"WITH {I.PAGES}, {I.JOBS} SELECT job_id, page_id FROM pg WHERE job_id NOT IN (SELECT job_id FROM jb WHERE status = 'completed')")
def cascade(spark, d):
    return jobs.cascade({"pages": I.pages(spark, d)}, I.jobs(spark, d).where("status = 'completed'"))["pages"].select("job_id", "page_id")


def events(spark, d):
    e = I.table(spark, d, "events")
    k = F.col("event_id") % 5
    s = F.when(k == 0, "queued").when(k == 1, "running").when(k == 2, "completed").when(k == 3, "cancelled").otherwise("failed")
    return e.select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), (F.floor(F.col("event_id") / 4000) + F.when(F.col("event_id") % 17 == 0, -1).otherwise(0)).cast("int").alias("attempt"), s.alias("status"))


_EVENTS = "ev AS (SELECT user_id AS job_id, event_id AS seq, (event_id // 4000 + CASE WHEN event_id % 17 = 0 THEN -1 ELSE 0 END)::INT AS attempt, CASE event_id % 5 WHEN 0 THEN 'queued' WHEN 1 THEN 'running' WHEN 2 THEN 'completed' WHEN 3 THEN 'cancelled' ELSE 'failed' END AS status FROM events)"


@query(
    "T2_T3_current_state",
    f"""WITH {_EVENTS}, a AS (SELECT *, max(attempt) OVER (PARTITION BY job_id ORDER BY seq) AS m FROM ev), l AS (SELECT * FROM a WHERE attempt >= m),
s AS (SELECT *, coalesce(max(seq) FILTER (status = 'queued') OVER w, -1) AS q, coalesce(max(seq) FILTER (status = 'cancelled') OVER w, -1) AS c FROM l WINDOW w AS (PARTITION BY job_id ORDER BY seq))
SELECT job_id, arg_max(CASE WHEN c > q THEN 'cancelled' ELSE status END, seq) AS status, max(seq) AS seq, max(attempt) AS attempt FROM s GROUP BY job_id""",
)
def state(spark, d):
    return jobs.current_state(events(spark, d))


@query("T12_next_attempt", f"WITH {_EVENTS} SELECT job_id, (max(attempt) + 1)::INT AS attempt, 'queued' AS status FROM ev GROUP BY job_id")
def attempt(spark, d):
    return jobs.next_attempt(events(spark, d).select("job_id", "attempt"))


@query("T13_queue", f"WITH {I.JOBS} SELECT count(*) FILTER (status = 'running') AS active, count(*) FILTER (status = 'queued') AS queued FROM jb")
def queue(spark, d):
    return jobs.queue(I.jobs(spark, d)).select("active", "queued")


@query("T13_waiting", f"WITH {I.JOBS} SELECT job_id, row_number() OVER (ORDER BY created_at, job_id) - 1 AS position FROM jb WHERE status = 'queued'")
def waiting(spark, d):
    return jobs.waiting(I.jobs(spark, d))


@query("T1_head_of_line", "WITH q AS (SELECT o_custkey AS queue_id, o_orderkey AS job_id, o_orderkey % 3 = 0 AS model, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, sum((o_orderkey % 3 = 0)::INT) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS m FROM orders) SELECT queue_id, job_id, n <= 1 + queue_id % 5 AND (m = 0 OR (m = 1 AND queue_id % 2 = 0)) AS starts FROM q")
def started(spark, d):
    q = I.table(spark, d, "orders").select(F.col("o_custkey").alias("queue_id"), F.col("o_orderkey").alias("job_id"), F.col("o_orderkey").alias("pos"), (F.col("o_orderkey") % 3 == 0).alias("uses_model"))
    k = F.col("queue_id")
    state = q.select("queue_id").distinct().select("queue_id", F.lit(1).alias("running"), (2 + k % 5).alias("capacity"), (k % 2 == 1).alias("model_busy"))
    return jobs.started(q, state)


def requests(spark, d):
    k = F.col("job_id")
    return I.jobs(spark, d).select("job_id", "status", (k % 3).cast("int").alias("first"), (1 + k % 4).cast("int").alias("last"))


@query("V9_page_range", f"WITH {I.PAGES}, {I.JOBS}, n AS (SELECT job_id, count(*) AS n FROM pg GROUP BY job_id) SELECT p.job_id, p.page_id FROM pg p JOIN jb USING (job_id) JOIN n USING (job_id) WHERE jb.status = 'queued' AND p.job_id % 3 >= 1 AND p.job_id % 3 <= 1 + p.job_id % 4 AND 1 + p.job_id % 4 <= n.n AND p.page_id BETWEEN p.job_id % 3 AND 1 + p.job_id % 4")
def page_range(spark, d):
    return jobs.page_range(I.pages(spark, d).drop("status"), requests(spark, d)).select("job_id", "page_id")


@query("W20_page_batches", f"WITH {I.PAGES} SELECT job_id, page_id, ((row_number() OVER (PARTITION BY job_id ORDER BY page_id) - 1) // 3)::INT AS batch FROM pg")
def page_batches(spark, d):
    return jobs.page_batches(I.pages(spark, d), 3).select("job_id", "page_id", "batch")


@query("D5_saved_edits", "SELECT c_custkey AS page_id, CASE WHEN c_custkey % 10 = 9 THEN 'unknown_page' WHEN c_custkey % 3 <> c_custkey % 4 THEN 'conflict' ELSE 'saved' END AS outcome, CASE WHEN c_custkey % 10 = 9 THEN NULL WHEN c_custkey % 3 <> c_custkey % 4 THEN c_custkey % 4 ELSE c_custkey % 4 + 1 END AS revision, CASE WHEN c_custkey % 10 = 9 THEN NULL WHEN c_custkey % 3 <> c_custkey % 4 THEN c_custkey % 5 = 0 ELSE c_custkey % 5 = 0 OR c_custkey % 2 = 0 END AS manual, CASE WHEN c_custkey % 10 = 9 THEN NULL WHEN c_custkey % 3 <> c_custkey % 4 THEN 'reviewed' ELSE 'in_review' END AS review FROM customer")
def edits(spark, d):
    c, k = I.table(spark, d, "customer").select(F.col("c_custkey").alias("page_id")), F.col("page_id")
    pages = c.where("page_id % 10 <> 9").select("page_id", (k % 4).alias("revision"), (k % 5 == 0).alias("manual"), F.lit("reviewed").alias("review"))
    return jobs.edits_saved(pages, c.select("page_id", (k % 3).alias("expected"), (k % 2 == 0).alias("manual")))


@query("D7_staleness", "SELECT c_custkey AS key, (c_custkey % 2 = 1 OR c_custkey % 5 = 0 OR c_custkey % 7 = 0) AS stale, concat_ws(',', CASE WHEN c_custkey % 2 = 1 OR c_custkey % 7 = 0 THEN 'source_changed' END, CASE WHEN c_custkey % 5 = 0 OR c_custkey % 7 = 0 THEN 'glossary_changed' END, CASE WHEN c_custkey % 7 = 0 THEN 'validator_changed' END) AS reasons FROM customer")
def stale(spark, d):
    c = I.table(spark, d, "customer").select(F.col("c_custkey").alias("key"))
    made = c.select("key", F.lit("a").alias("source"), F.lit("a").alias("glossary"), F.lit("a").alias("validator"))
    now = c.where("key % 7 <> 0").select("key", F.when(F.col("key") % 2 == 1, "b").otherwise("a").alias("source"), F.when(F.col("key") % 5 == 0, "b").otherwise("a").alias("glossary"), F.lit("a").alias("validator"))
    return jobs.staleness(made, now)


@query("T11_review_state", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'in_review' WHEN c_custkey % 2 = 0 AND c_nationkey % 2 = 0 THEN 'in_review' WHEN c_nationkey % 2 = 0 THEN 'reviewed' ELSE 'new' END AS review FROM customer")
def review(spark, d):
    c = I.table(spark, d, "customer").select("c_custkey", (F.col("c_custkey") % 3 == 0).alias("edited"), (F.col("c_custkey") % 2 == 0).alias("new_attempt"), F.when(F.col("c_nationkey") % 2 == 0, "reviewed").otherwise("new").alias("review"))
    return jobs.review_state(c).select("c_custkey", "review")


@query("T10_deletions", f"WITH {I.JOBS} SELECT job_id, CASE WHEN status = 'running' AND job_id % 2 = 1 THEN 'refused' ELSE 'deleted' END AS outcome FROM jb UNION ALL SELECT -1, 'orphan_removed'")
def deletions(spark, d):
    j = I.jobs(spark, d)
    r = j.select("job_id", (F.col("job_id") % 2 == 0).alias("force")).unionByName(spark.createDataFrame([(-1, False)], "job_id long, force boolean"))
    return jobs.deletions(j, r)


@query("S22_page_view", f"WITH {I.PAGES}, {I.JOBS}, x AS (SELECT job_id, page_id, CASE WHEN page_id % 4 <> 3 THEN route END AS raw, CASE WHEN page_id % 2 = 0 THEN status END AS corrected, CASE WHEN job_id % 3 = 0 THEN ai_status END AS final FROM pg) SELECT x.job_id, page_id, j.status AS job_status, coalesce(raw, '') AS raw, coalesce(corrected, raw, '') AS corrected, coalesce(final, raw, '') AS final, coalesce(final <> coalesce(raw, ''), false) OR coalesce(corrected <> coalesce(raw, ''), false) AS changed FROM x LEFT JOIN jb j ON j.job_id = x.job_id")
def page_view(spark, d):
    p, k = I.pages(spark, d), F.col("page_id")
    p = p.select("job_id", "page_id", F.when(k % 4 != 3, F.col("route")).alias("raw"), F.when(k % 2 == 0, F.col("status")).alias("corrected"), F.when(F.col("job_id") % 3 == 0, F.col("ai_status")).alias("final"))
    return jobs.page_view(p, I.jobs(spark, d))


_EDITED = """ed AS (SELECT doc_id AS job_id, doc_id % 4 + 1 AS page_id, CASE WHEN doc_id % 9 <> 0 THEN text END AS raw, CASE WHEN doc_id % 2 = 0 THEN replace(text, 'e', 'E') END AS corrected, CASE WHEN doc_id % 3 = 0 THEN source END AS final, doc_id % 5 < 2 AS pictured FROM documents)"""


@query("S22_page_data", f"""WITH {I.SPANS}, pr AS (SELECT doc_id, 'c' || ord AS change_id, "start", "start" + 3 AS "end", block_id AS original, 'x' || ord AS corrected, CASE WHEN ord % 8 = 1 THEN 'accepted' ELSE 'pending' END AS status FROM sp WHERE ord % 4 = 1), {I.JOBS}, {_EDITED}, s AS (SELECT doc_id, sha256(string_agg("start" || ':' || "end" || ':' || block_id || ':' || line_index, ',' ORDER BY "start", "end", block_id, line_index)) AS spans FROM sp GROUP BY doc_id),
c AS (SELECT doc_id, count(*) AS n, sha256(string_agg("start" || ':' || change_id || ':' || original || ':' || corrected || ':' || status, ',' ORDER BY "start", "end", change_id)) AS changes FROM pr GROUP BY doc_id)
SELECT ed.job_id, page_id, jb.status AS job_status, sha256(coalesce(raw, '')) AS raw, sha256(coalesce(corrected, raw, '')) AS corrected, sha256(coalesce(final, raw, '')) AS final,
  coalesce(final <> coalesce(raw, ''), false) OR coalesce(corrected <> coalesce(raw, ''), false) AS changed, s.spans, coalesce(c.changes, sha256('')) AS changes, coalesce(c.n, 0) AS n_changes, CASE WHEN pictured THEN 800 + ed.job_id ELSE 1000 END AS width, CASE WHEN pictured THEN 600 ELSE 1400 END AS height, CASE WHEN pictured THEN 90.0::DOUBLE ELSE 0.0::DOUBLE END AS angle
FROM ed LEFT JOIN jb ON jb.job_id = ed.job_id LEFT JOIN s ON s.doc_id = ed.job_id LEFT JOIN c ON c.doc_id = ed.job_id""")
def page_data(spark, d):
    docs = I.table(spark, d, "documents")
    k, page = F.col("doc_id"), (F.col("doc_id") % 4 + 1).alias("page_id")
    pages = docs.select(k.alias("job_id"), page, F.when(k % 9 != 0, F.col("text")).alias("raw"), F.when(k % 2 == 0, F.replace("text", F.lit("e"), F.lit("E"))).alias("corrected"), F.when(k % 3 == 0, F.col("source")).alias("final"))
    turned = F.struct(*(F.lit(90.0 if n == "angle" else v).alias(n) for n, v in jobs.UPRIGHT.items()))
    images = docs.where(k % 5 < 2).select(k.alias("job_id"), page, (800 + k).alias("width"), F.lit(600).alias("height"), turned.alias("transform"))
    spans, ord_ = I.spans(spark, d), F.col("ord")
    changes = spans.where(ord_ % 4 == 1).select("doc_id", F.concat(F.lit("c"), ord_.cast("string")).alias("change_id"), "start", (F.col("start") + 3).alias("end"), F.col("block_id").alias("original"), F.concat(F.lit("x"), ord_.cast("string")).alias("corrected"), F.when(ord_ % 8 == 1, "accepted").otherwise("pending").alias("status"))
    own = lambda df: df.select(k.alias("job_id"), page, *(c for c in df.columns if c != "doc_id"))
    got = jobs.page_data(pages, I.jobs(spark, d), own(spans), own(changes), images)
    text = lambda xs, *names: F.sha2(F.array_join(F.transform(xs, lambda x: F.concat_ws(":", *(x[n].cast("string") for n in names))), ","), 256)
    hashed = [F.sha2(c, 256).alias(c) for c in ("raw", "corrected", "final")]
    return got.select("job_id", "page_id", "job_status", *hashed, "changed", text("spans", "start", "end", "block_id", "line_index").alias("spans"), text("changes", "start", "change_id", "original", "corrected", "status").alias("changes"), F.size("changes").cast("long").alias("n_changes"), "width", F.col("height").cast("long").alias("height"), F.col("transform.angle").alias("angle"))


@query("S14_A13_job_json", f"""WITH {I.PAGES} SELECT job_id, '[' || string_agg('{{"page_id":' || page_id || ',"status":"' || status || '","route":"' || route || '"}}', ',' ORDER BY page_id) || ']' AS document FROM pg GROUP BY job_id""")
def job_json(spark, d):
    p = I.pages(spark, d)
    return p.groupBy("job_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("page_id", "status", "route")))).alias("document"))


_WRITTEN = """wr AS (SELECT job_id, page_id, CASE (job_id + page_id) % 7 WHEN 3 THEN '{"pages": [' WHEN 5 THEN NULL WHEN 6 THEN '[1]' ELSE '{"pages":[{"page_id":' || page_id || ',"route":"' || route || '"}]}' END AS ocr,
  CASE WHEN page_id % 3 = 0 THEN NULL WHEN page_id % 3 = 1 AND job_id % 5 = 0 THEN 'nope' ELSE '{"n":' || page_id || '}' END AS changes FROM pg)"""


def written(spark, d):
    """What the pages of jobs have written: some not at all, some not as it should be."""
    k, page = (F.col("job_id") + F.col("page_id")) % 7, F.col("page_id")
    ocr = F.when(k == 3, '{"pages": [').when(k == 6, "[1]").when(k != 5, F.concat(F.lit('{"pages":[{"page_id":'), page.cast("string"), F.lit(',"route":"'), "route", F.lit('"}]}')))
    changes = F.when((page % 3 == 1) & (F.col("job_id") % 5 == 0), "nope").when(page % 3 != 0, F.concat(F.lit('{"n":'), page.cast("string"), F.lit("}")))
    return I.pages(spark, d).select("job_id", "page_id", ocr.alias("ocr"), changes.alias("changes"))


@query("S14_merged_documents", f"""WITH {I.PAGES}, {_WRITTEN}, o AS (SELECT job_id, string_agg(ocr[11:-3], ',' ORDER BY page_id) FILTER ((job_id + page_id) % 7 NOT IN (3, 5, 6)) AS o, string_agg(changes, ',' ORDER BY page_id) FILTER (changes <> 'nope') AS c FROM wr GROUP BY job_id)
SELECT o_orderkey AS job_id, '{{"job_id":' || o_orderkey || ',"pages":[' || coalesce(o, '') || ']}}' AS ocr, '{{"job_id":' || o_orderkey || ',"pages":[' || coalesce(c, '') || ']}}' AS changes FROM orders LEFT JOIN o ON job_id = o_orderkey""".replace("ocr[11:-3]", "ocr[11:length(ocr) - 2]"))
def merged(spark, d):
    return merge.merged_pages(I.jobs(spark, d), written(spark, d))[0]


@query("S14_pages_set_aside", f"WITH {I.PAGES}, {_WRITTEN} SELECT job_id, page_id, 'ocr' AS file, CASE (job_id + page_id) % 7 WHEN 3 THEN 'not_json' ELSE 'not_an_object' END AS reason FROM wr WHERE (job_id + page_id) % 7 IN (3, 6) UNION ALL SELECT job_id, page_id, 'changes', 'not_json' FROM wr WHERE changes = 'nope'")
def set_aside(spark, d):
    return merge.merged_pages(I.jobs(spark, d), written(spark, d))[1]


@query("T8_progress", """WITH e AS (SELECT user_id AS job_id, date_trunc('day', ts) AS begins, event_id, ts, event_type AS stage, CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'running' END AS status FROM events)
SELECT job_id, strftime(begins, '%Y-%m-%d %H:%M:%S') AS begins, count(*) AS n_events, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed,
  count(*) FILTER (status = 'completed') / nullif(count(*) FILTER (status IN ('completed', 'failed')), 0)::DOUBLE AS share, arg_max(stage, (ts, event_id)) AS stage FROM e GROUP BY job_id, begins""")
def progress_by_day(spark, d):
    e = I.table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("job_id"), F.col("event_type").alias("stage"), F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").otherwise("running").alias("status"))
    return events_progress.progress(e, "1 day").withColumn("begins", F.date_format("begins", "yyyy-MM-dd HH:mm:ss"))


@query("S21_library_batches", "SELECT source, batch, count(*) AS n, sha256(trim(string_agg(text, chr(10) || chr(10) ORDER BY doc_id))) AS h FROM (SELECT source, doc_id, trim(text) AS text, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 10 AS batch FROM documents) GROUP BY source, batch")
def library(spark, d):
    from pagewright.operators.assemble import ordered_concat

    p = I.table(spark, d, "documents").select(F.col("source").alias("job_id"), F.col("doc_id").alias("page_id"), F.trim("text").alias("text"))
    b = jobs.page_batches(p, 10).groupBy("job_id", "batch").agg(F.count("*").alias("n"), F.sha2(F.trim(ordered_concat("job_id", "page_id", "text", "\n\n")), 256).alias("h"))
    return b.select(F.col("job_id").alias("source"), F.col("batch").cast("long").alias("batch"), "n", "h")


@query("U1_united_blocks", f"WITH {I.BOXES}, b AS (SELECT page_id, line_index, x0, y0, CASE WHEN line_index % 2 = 0 THEN 'native' ELSE 'ocr' END AS origin FROM bx) SELECT page_id, line_index, origin, (row_number() OVER (PARTITION BY page_id ORDER BY y0, x0, origin, line_index) - 1)::INT AS position FROM b")
def united(spark, d):
    from pagewright.operators import assemble

    b = I.boxes(spark, d)
    return assemble.united_blocks(b.where("line_index % 2 = 0"), b.where("line_index % 2 = 1")).select("page_id", "line_index", "origin", "position")


@query("U2_all_proposals", f"""WITH {I.PROPOSALS} SELECT doc_id, change_id, (row_number() OVER (PARTITION BY doc_id ORDER BY status <> 'accepted', "start", "end", change_id) - 1)::INT AS ord FROM pr""")
def all_proposals(spark, d):
    from pagewright.operators import correct

    p = I.proposals(spark, d)
    return correct.all_proposals(p.where("status = 'accepted'"), p.where("status <> 'accepted'")).select("doc_id", "change_id", "ord")


@query("U3_missing_files", "WITH r(name) AS (VALUES ('mimetype'), ('META-INF/container.xml'), ('OEBPS/content.opf'), ('OEBPS/nav.xhtml')), p AS (SELECT DISTINCT o_custkey AS package_id FROM orders) SELECT package_id, name FROM p, r EXCEPT SELECT o_custkey, CASE o_orderkey % 5 WHEN 0 THEN 'mimetype' WHEN 1 THEN 'META-INF/container.xml' WHEN 2 THEN 'OEBPS/content.opf' WHEN 3 THEN 'OEBPS/nav.xhtml' ELSE 'other' END FROM orders")
def missing_files(spark, d):
    from pagewright.operators import package

    k = F.col("o_orderkey") % 5
    names = I.table(spark, d, "orders").select(F.col("o_custkey").alias("package_id"), F.when(k == 0, "mimetype").when(k == 1, "META-INF/container.xml").when(k == 2, "OEBPS/content.opf").when(k == 3, "OEBPS/nav.xhtml").otherwise("other").alias("name"))
    return package.missing_files(names)


@query("D12_toc_saved", "SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 11 = 0 THEN 'not_found' WHEN c_custkey % 6 = 0 AND c_custkey % 4 <> 0 THEN 'confirmation_required' WHEN c_custkey % 5 = 1 THEN 'source_changed' WHEN c_custkey % 7 = 1 THEN 'toc_changed' WHEN c_custkey % 9 = 1 THEN 'preview_changed' WHEN c_custkey % 8 = 0 THEN 'invalid' ELSE 'saved' END AS outcome FROM customer")
def toc_saved(spark, d):
    from pagewright.operators import toc

    c, k = I.table(spark, d, "customer").select(F.col("c_custkey").alias("doc_id")), F.col("doc_id")
    states = c.where("doc_id % 11 <> 0").select("doc_id", F.lit("s").alias("source"), F.lit("t").alias("toc"), F.lit("p").alias("preview"))
    asked = c.select("doc_id", F.when(k % 5 == 1, "x").otherwise("s").alias("base_source"), F.when(k % 7 != 1, "t").alias("base_toc"), F.when(k % 9 == 1, "x").otherwise("p").alias("base_preview"), (k % 6 == 0).alias("regenerate"), (k % 4 == 0).alias("confirmed"))
    return toc.toc_saved(states, asked, c.where("doc_id % 8 = 0"))
