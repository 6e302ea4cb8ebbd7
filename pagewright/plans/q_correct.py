"""Queries of the correction operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewright.functions import arrow as A
from pagewright.operators import correct

from . import inputs as I

QUERIES: dict = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = (fn, sql)
        return fn

    return add


def texts(spark, d):
    return I.table(spark, d, "documents").select("doc_id", "text")


@query(
    "J1_J5_located_proposals",
    f"""WITH {I.PROPOSALS}, n AS (SELECT p.doc_id, p.change_id, s.line_index, row_number() OVER (PARTITION BY p.doc_id, p.change_id ORDER BY NOT (s."start" <= p."start" AND p."end" <= s."end"), s.ord) AS r
  FROM pr p JOIN sp s ON s.doc_id = p.doc_id AND s.block_id = p.block_id AND ((s."start" <= p."start" AND p."end" <= s."end") OR (s."start" <= p."start" AND p."start" < s."end")))
SELECT p.doc_id, p.change_id, n.line_index AS line FROM pr p LEFT JOIN n ON n.doc_id = p.doc_id AND n.change_id = p.change_id AND n.r = 1""",
)
def located(spark, d):
    return correct.located(I.proposals(spark, d), I.spans(spark, d)).select("doc_id", "change_id", "line")


@query("J2_span_at", f"""WITH {I.PROPOSALS}, n AS (SELECT p.doc_id, p."start", p."end", s.block_id, s.line_index, row_number() OVER (PARTITION BY p.doc_id, p."start", p."end" ORDER BY s.ord) AS r FROM (SELECT DISTINCT doc_id, "start", "end" FROM pr) p JOIN sp s ON s.doc_id = p.doc_id AND ((s."start" <= p."start" AND p."start" < s."end") OR (p."start" <= s."start" AND s."end" <= p."end"))) SELECT doc_id, "start", "end", block_id, line_index FROM n WHERE r = 1""")
def span_at(spark, d):
    return correct.span_at(I.proposals(spark, d).select("doc_id", "start", "end").distinct(), I.spans(spark, d))


@query(
    "V1_W14_validated_proposals",
    f"""WITH RECURSIVE {I.PROPOSALS}, n AS (SELECT p.doc_id, p.change_id, s.line_index, row_number() OVER (PARTITION BY p.doc_id, p.change_id ORDER BY NOT (s."start" <= p."start" AND p."end" <= s."end"), s.ord) AS r
  FROM pr p JOIN sp s ON s.doc_id = p.doc_id AND s.block_id = p.block_id AND ((s."start" <= p."start" AND p."end" <= s."end") OR (s."start" <= p."start" AND p."start" < s."end"))),
kb AS (SELECT DISTINCT doc_id, block_id FROM sp),
x AS (SELECT p.*, d.text, n.line_index AS line, kb.block_id IS NOT NULL AS known FROM pr p JOIN documents d USING (doc_id) LEFT JOIN n ON n.doc_id = p.doc_id AND n.change_id = p.change_id AND n.r = 1 LEFT JOIN kb ON kb.doc_id = p.doc_id AND kb.block_id = p.block_id),
v AS (SELECT *, CASE WHEN "start" < 0 OR "end" > length(text) OR "start" >= "end" THEN 'out_of_bounds' WHEN substr(text, "start" + 1, "end" - "start") <> original THEN 'content_mismatch' END AS before,
  CASE WHEN NOT known THEN 'invalid_block' WHEN line IS NULL THEN 'mapping_mismatch' WHEN length(original) > 25 OR length(trim(original)) - length(replace(trim(original), ' ', '')) > 1 THEN 'phrase_level'
    WHEN levenshtein({I.one_byte("original")}, {I.one_byte("corrected")}) > greatest(2, length(original) // 2) OR abs(length(original) - length(corrected)) > 3 THEN 'edit_distance' END AS after FROM x),
g AS (SELECT doc_id, change_id, "start" AS s, "end" AS e, after IS NULL AS ok, row_number() OVER (PARTITION BY doc_id ORDER BY "start", "end", change_id) AS k FROM v WHERE before IS NULL),
f AS (SELECT doc_id, change_id, k, true AS free, CASE WHEN ok THEN e ELSE -1 END AS last FROM g WHERE k = 1 UNION ALL SELECT g.doc_id, g.change_id, g.k, g.s >= f.last, CASE WHEN g.s >= f.last AND g.ok THEN g.e ELSE f.last END FROM f JOIN g ON g.doc_id = f.doc_id AND g.k = f.k + 1),
r AS (SELECT v.*, coalesce(before, CASE WHEN NOT f.free THEN 'overlap' END, after, 'accepted') AS verdict FROM v LEFT JOIN f ON f.doc_id = v.doc_id AND f.change_id = v.change_id)
SELECT doc_id, change_id, verdict, verdict = 'accepted' AND regexp_matches(original || corrected, '[0-9\\x{{0E50}}-\\x{{0E59}}]') AS flagged FROM r""",
)
def validated(spark, d):
    return correct.validated(I.proposals(spark, d), texts(spark, d), I.spans(spark, d)).select("doc_id", "change_id", "verdict", "flagged")


@query(
    "W14_greedy_overlap",
    f"""WITH RECURSIVE {I.LINES}, iv AS (SELECT doc_id, ln AS id, (ln * 7) AS s, (ln * 7 + 3 + (doc_id + ln) % 12) AS e, row_number() OVER (PARTITION BY doc_id ORDER BY ln) AS k FROM ln),
f AS (SELECT doc_id, k, id, true AS free, e AS last FROM iv WHERE k = 1 UNION ALL SELECT iv.doc_id, iv.k, iv.id, iv.s >= f.last, CASE WHEN iv.s >= f.last THEN iv.e ELSE f.last END FROM f JOIN iv ON iv.doc_id = f.doc_id AND iv.k = f.k + 1)
SELECT doc_id, id::VARCHAR AS id, free FROM f""",
)
def greedy(spark, d):
    ln = F.col("ln")
    item = F.struct((ln * 7).cast("int").alias("start"), (ln * 7 + 3 + (F.col("doc_id") + ln) % 12).cast("int").alias("end"), ln.cast("string").alias("id"), F.lit(True).alias("ok"))
    return I.lines(spark, d).groupBy("doc_id").agg(correct.greedy_spans(F.collect_list(item)).alias("o")).select("doc_id", F.explode("o").alias("o")).select("doc_id", "o.id", "o.free")


def single(spark, d):
    return I.proposals(spark, d).where("change_id = 'c0'")


@query("D1_applied_correction", f"""WITH {I.PROPOSALS} SELECT d.doc_id, CASE WHEN p.doc_id IS NULL THEN d.text ELSE substr(d.text, 1, p."start") || p.corrected || substr(d.text, p."end" + 1) END AS text FROM documents d LEFT JOIN pr p ON p.doc_id = d.doc_id AND p.change_id = 'c0'""")
def applied(spark, d):
    return correct.applied(texts(spark, d), single(spark, d))


_PIECES = """pc AS (SELECT doc_id, "start", "end", corrected, coalesce(lag("end") OVER (PARTITION BY doc_id ORDER BY "start"), 0) AS before FROM pr WHERE change_id <> 'none' AND original <> corrected)"""


@query("D1_D2_rebuilt_equals_applied", f"""WITH {I.PROPOSALS}, {_PIECES}, h AS (SELECT p.doc_id, string_agg(substr(d.text, before + 1, p."start" - before) || corrected, '' ORDER BY p."start") AS head, max(p."end") AS last FROM pc p JOIN documents d USING (doc_id) GROUP BY p.doc_id) SELECT d.doc_id, sha256(coalesce(h.head, '') || substr(d.text, coalesce(h.last, 0) + 1)) AS applied, true AS same FROM documents d LEFT JOIN h USING (doc_id)""")
def rebuilt(spark, d):
    p = I.proposals(spark, d).where("original <> corrected")
    a = correct.applied(texts(spark, d), p).withColumnRenamed("text", "x")
    # a proposal that isn't where it says is put in by one and passed over by the other
    fits = p.join(texts(spark, d), "doc_id").where("substring(text, start + 1, end - start) = original").drop("text")
    b = correct.rebuilt(texts(spark, d), p).withColumnRenamed("text", "y").join(correct.applied(texts(spark, d), fits), "doc_id")
    return a.join(b, "doc_id").select("doc_id", F.sha2("x", 256).alias("applied"), (F.col("y") == F.col("text")).alias("same"))


@query("D3_reverted_is_raw", "SELECT doc_id, sha256(text) AS h FROM documents")
def reverted(spark, d):
    p = single(spark, d)
    return correct.reverted(texts(spark, d), p, p.select("doc_id", "change_id")).select("doc_id", F.sha2("text", 256).alias("h"))


@query("D4_J16_replace_near", """WITH w AS (SELECT doc_id, text, unnest(string_split(text, 'the')) AS piece, generate_subscripts(string_split(text, 'the'), 1) AS i FROM documents),
o AS (SELECT doc_id, i, sum(length(piece) + 3) OVER (PARTITION BY doc_id ORDER BY i) - 3 AS s, max(i) OVER (PARTITION BY doc_id) AS k FROM w),
n AS (SELECT doc_id, s, rank() OVER (PARTITION BY doc_id ORDER BY abs(s - 100)) AS r FROM o WHERE i < k), b AS (SELECT doc_id, min(s)::BIGINT AS s, count(*) AS n FROM n WHERE r = 1 GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN b.n = 1 THEN sha256(substr(d.text, 1, b.s) || 'THE' || substr(d.text, b.s + 4)) END AS h FROM documents d LEFT JOIN b USING (doc_id)""")
def near(spark, d):
    t = texts(spark, d).select("doc_id", "text", F.lit("the").alias("needle"), F.lit("THE").alias("replacement"), F.lit(100).alias("expected"))
    return correct.replace_near(t).select("doc_id", F.sha2("out", 256).alias("h"))


@query("W27_offset_shift", f"""WITH {I.PROPOSALS} SELECT doc_id, change_id, coalesce(sum(CASE WHEN status = 'accepted' THEN length(corrected) - length(original) ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS shift FROM pr""")
def shifted(spark, d):
    return correct.shifted(I.proposals(spark, d)).select("doc_id", "change_id", "shift")


@query("A6_proposal_counters", f"WITH {I.PROPOSALS} SELECT doc_id, count(*) AS total, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'accepted') AS accepted, count(*) FILTER (status = 'rejected') AS rejected, count(*) FILTER (status = 'stale') AS stale FROM pr GROUP BY doc_id")
def counters(spark, d):
    return correct.counters(I.proposals(spark, d))


@query("D8_candidates", f"""WITH {I.PROPOSALS}, m AS (SELECT p.doc_id, p."start" AS ord, trim(' ' || original) AS o, trim(corrected) AS c, strpos(d.text, original) - 1 AS s FROM pr p JOIN documents d USING (doc_id) WHERE original <> corrected) SELECT doc_id, 'chg_' || (row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1) AS change_id, s::INT AS "start", (s + length(o))::INT AS "end", o AS original, c AS corrected, 'spelling' AS category FROM m WHERE s >= 0""")
def candidates(spark, d):
    m = I.proposals(spark, d).select("doc_id", F.col("start").alias("ord"), F.concat(F.lit(" "), "original").alias("original"), "corrected", F.lit("odd").alias("category"), F.lit(None).cast("int").alias("start"))
    return correct.candidates(m, texts(spark, d))


@query("O5_spot_context", f"""WITH {I.PROPOSALS}, n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY "start", "end") AS n FROM pr) SELECT n.doc_id, n.n, n."start", n."end", substr(d.text, greatest(0, n."start" - 40) + 1, n."end" + 40 - greatest(0, n."start" - 40)) AS context FROM n JOIN documents d USING (doc_id) WHERE n.n <= 10""")
def context(spark, d):
    return correct.context(texts(spark, d), I.proposals(spark, d).select("doc_id", "start", "end"))


@query("A5_diff_summary")
def diff(spark, d):
    # comparing costs more than bytes tell, so the lines of a file's few splits are dealt over the cores
    t = I.lines(spark, d).repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism), "doc_id", "ln")
    t = t.withColumn("s", A.diff_summary(F.col("line"), F.translate("line", "eno", "aE")))
    # what one side has and the other hasn't accounts for both lengths
    sides = (F.col("s.unchanged") + F.col("s.substitutions") + F.col("s.deletions") == F.length("line")) & (F.col("s.unchanged") + F.col("s.substitutions") + F.col("s.insertions") == F.length(F.translate("line", "eno", "aE")))
    return t.select("doc_id", "ln", "s.*", sides.alias("bounded"))


@query("D6_unified_diff")
def unified(spark, d):
    return texts(spark, d).select("doc_id", F.sha2(A.unified_diff(F.col("text"), F.replace("text", F.lit(" the "), F.lit(" THE "))), 256).alias("h"))


@query("D9_variant_flags", "SELECT doc_id, (coalesce(CASE WHEN doc_id % 3 = 0 THEN text || 'x' WHEN doc_id % 3 = 1 THEN text END, text) <> text OR coalesce(CASE WHEN doc_id % 5 = 0 THEN '' END, text) <> text) AS changed FROM documents")
def variants(spark, d):
    k = F.col("doc_id")
    final = F.when(k % 3 == 0, F.concat("text", F.lit("x"))).when(k % 3 == 1, F.col("text"))
    return texts(spark, d).select("doc_id", correct.changed(F.col("text"), F.when(k % 5 == 0, ""), final).alias("changed"))


@query("D10_source_revision", "SELECT doc_id // 10 AS source, sha256(string_agg(sha256(CASE doc_id % 2 WHEN 0 THEN 'raw' ELSE 'final' END || chr(10) || coalesce(text, '')), '|' ORDER BY doc_id)) AS revision FROM documents GROUP BY doc_id // 10")
def revision(spark, d):
    k = F.col("doc_id")
    files = texts(spark, d).select(F.floor(k / 10).alias("source"), k.alias("ord"), F.when(k % 2 == 0, "raw").otherwise("final").alias("label"), "text")
    return correct.source_revision(files)
