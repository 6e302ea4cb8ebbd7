"""Queries of the translation operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewright.operators import translate
from pagewright.sources import providers

from . import inputs as I

QUERIES: dict = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = (fn, sql)
        return fn

    return add


_GROUPS = """g0 AS (SELECT *, (group_id IS NULL OR lag(group_id) OVER (PARTITION BY doc_id ORDER BY pos) IS DISTINCT FROM group_id)::INT AS new FROM sg WHERE status = 'pending'),
g1 AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY pos) AS g FROM g0), g2 AS (SELECT doc_id, g, sum(size) AS s, count(*) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY g) AS k FROM g1 GROUP BY doc_id, g)"""


@query(
    "W17_batch_packing",
    f"""WITH RECURSIVE {I.SEGMENTS}, {_GROUPS},
f AS (SELECT doc_id, k, g, s AS cs, n AS cn, 0 AS batch FROM g2 WHERE k = 1 UNION ALL SELECT g2.doc_id, g2.k, g2.g, CASE WHEN f.cs + g2.s > 5000 OR f.cn + g2.n > 8 THEN g2.s ELSE f.cs + g2.s END, CASE WHEN f.cs + g2.s > 5000 OR f.cn + g2.n > 8 THEN g2.n ELSE f.cn + g2.n END, f.batch + CASE WHEN f.cs + g2.s > 5000 OR f.cn + g2.n > 8 THEN 1 ELSE 0 END FROM f JOIN g2 ON g2.doc_id = f.doc_id AND g2.k = f.k + 1)
SELECT g1.doc_id, g1.pos, f.batch FROM g1 JOIN f ON f.doc_id = g1.doc_id AND f.g = g1.g""",
)
def batches(spark, d):
    return translate.packed_groups(I.segments(spark, d))


@query(
    "W19_prompt_packing",
    f"""WITH RECURSIVE {I.SEGMENTS}, u AS (SELECT doc_id, pos, strlen(text) AS s, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM sg),
f AS (SELECT doc_id, k, pos, s AS cs, 1 AS cn, 0 AS batch FROM u WHERE k = 1 UNION ALL SELECT u.doc_id, u.k, u.pos, CASE WHEN f.cs + u.s > 5500 OR f.cn >= 25 THEN u.s ELSE f.cs + u.s END, CASE WHEN f.cs + u.s > 5500 OR f.cn >= 25 THEN 1 ELSE f.cn + 1 END, f.batch + CASE WHEN f.cs + u.s > 5500 OR f.cn >= 25 THEN 1 ELSE 0 END FROM f JOIN u ON u.doc_id = f.doc_id AND u.k = f.k + 1)
SELECT doc_id, pos, batch FROM f""",
)
def prompts(spark, d):
    return translate.packed_bytes(I.segments(spark, d))


@query("W18_assembled_units")
def units(spark, d):
    k = F.col("pos") % 6
    s = I.segments(spark, d).withColumn("page", F.lit("1")).withColumn("series", F.when(k != 5, F.concat(F.lit("s"), F.floor(F.col("pos") / 6).cast("string")))).withColumn("text", F.when(k == 1, F.concat(F.rtrim("text"), F.lit("a-"))).otherwise(F.col("text")))
    return translate.assembled_units(s).select("doc_id", "unit", F.size("members").alias("members"), F.sha2("text", 256).alias("h"), F.array_join("rules", ",").alias("rules"))


@query("W15_text_chunks")
def chunks(spark, d):
    return translate.text_chunks(I.table(spark, d, "documents")).select("doc_id", "chunk", "start", "end", "prefix_overlap")


@query("W16_rejoined_chunks", "SELECT doc_id, text FROM documents WHERE text <> ''")
def rejoined(spark, d):
    return translate.rejoined(translate.text_chunks(I.table(spark, d, "documents")))


@query(
    "P12_A7_language_detection",
    f"""WITH {I.THAI_SQL}, j AS (SELECT doc_id, substr(string_agg(line, ' ' ORDER BY ln), 1, 100000) AS t FROM th GROUP BY doc_id), c AS (SELECT doc_id, len(regexp_extract_all(t, '[\\x{{0E00}}-\\x{{0E7F}}]')) AS th, len(regexp_extract_all(t, '[\\x{{3400}}-\\x{{9FFF}}]')) AS zh, len(regexp_extract_all(t, '[A-Za-z]')) AS en FROM j)
SELECT doc_id, CASE WHEN th + zh + en = 0 THEN 'und' WHEN th = greatest(th, zh, en) THEN 'th' WHEN zh = greatest(th, zh, en) THEN 'zh' ELSE 'en' END AS language, CASE WHEN th + zh + en = 0 THEN 0 ELSE round_even(greatest(th, zh, en) / (th + zh + en), 4) END AS confidence FROM c""",
)
def language(spark, d):
    return translate.detected_language(I.thai(spark, d).select("doc_id", F.col("ln").alias("pos"), F.col("line").alias("text")))


_PAIR = "pr AS (SELECT doc_id AS pair_id, 'on 2024-03-0' || (doc_id % 3) || ' 10:3' || (doc_id % 2) || ' 10:30 a.b@x.co ' || text AS source, 'le 2024-03-0' || (doc_id % 2) || ' 10:30 a.b@x.co ' || CASE WHEN doc_id % 3 = 0 THEN replace(text, 'the', 'le') ELSE replace(text, 'and', '') END AS target FROM documents)"


def pairs(spark, d):
    k = F.col("doc_id")
    s = F.concat(F.lit("on 2024-03-0"), (k % 3).cast("string"), F.lit(" 10:3"), (k % 2).cast("string"), F.lit(" 10:30 a.b@x.co "), "text")
    t = F.concat(F.lit("le 2024-03-0"), (k % 2).cast("string"), F.lit(" 10:30 a.b@x.co "), F.when(k % 3 == 0, F.replace("text", F.lit("the"), F.lit("le"))).otherwise(F.replace("text", F.lit("and"), F.lit(""))))
    return I.table(spark, d, "documents").select(k.alias("pair_id"), s.alias("source"), t.alias("target"))


@query(
    "A8_J17_token_multiset_difference",
    f"""WITH {_PAIR}, t AS (SELECT pair_id, 'date' AS kind, unnest(regexp_extract_all(source, '(?i)\\b\\d{{1,4}}[-/.]\\d{{1,2}}[-/.]\\d{{1,4}}\\b')) AS token, 1 AS n FROM pr UNION ALL SELECT pair_id, 'time', unnest(regexp_extract_all(source, '(?i)\\b\\d{{1,2}}:\\d{{2}}(?::\\d{{2}})?\\b')), 1 FROM pr
  UNION ALL SELECT pair_id, 'date', unnest(regexp_extract_all(target, '(?i)\\b\\d{{1,4}}[-/.]\\d{{1,2}}[-/.]\\d{{1,4}}\\b')), -1 FROM pr UNION ALL SELECT pair_id, 'time', unnest(regexp_extract_all(target, '(?i)\\b\\d{{1,2}}:\\d{{2}}(?::\\d{{2}})?\\b')), -1 FROM pr),
s AS (SELECT pair_id, kind, token, sum(n) AS n FROM t GROUP BY ALL) SELECT pair_id, kind, token, greatest(n, 0)::BIGINT AS missing, greatest(-n, 0)::BIGINT AS unexpected FROM s WHERE n <> 0""",
)
def changes(spark, d):
    return translate.token_changes(pairs(spark, d), ("date", "time")).select("pair_id", "kind", "token", F.col("missing").cast("long").alias("missing"), F.col("unexpected").cast("long").alias("unexpected"))


_TERMS = (("the", "le", False, False, "translated"), ("ENDNT", "fin", True, False, "translated"), ("and", "", False, True, "preserved"), ("de", "DE", True, False, "transliterated"))


def glossary(spark):
    return spark.createDataFrame(list(_TERMS), "source string, target string, case_sensitive boolean, do_not_translate boolean, mode string")


_GL = "gl(term, wanted, cs, keep, mode) AS (VALUES " + ", ".join(f"('{a}', '{b}', {str(c).lower()}, {str(k).lower()}, '{m}')" for a, b, c, k, m in _TERMS) + ")"


@query("J12_glossary_terms", f"WITH {_PAIR}, {_GL} SELECT pair_id, term, CASE WHEN keep THEN term ELSE wanted END AS expected, CASE WHEN contains(CASE WHEN cs THEN target ELSE lower(target) END, CASE WHEN cs THEN CASE WHEN keep THEN term ELSE wanted END ELSE lower(CASE WHEN keep THEN term ELSE wanted END) END) THEN mode ELSE 'missing' END AS state FROM pr JOIN gl ON contains(CASE WHEN cs THEN source ELSE lower(source) END, CASE WHEN cs THEN term ELSE lower(term) END)")
def terms(spark, d):
    return translate.term_states(pairs(spark, d), glossary(spark))


@query("V2_U5_glossary_errors", "WITH x AS (SELECT p_partkey AS ord, p_size AS set_id, CASE WHEN p_partkey % 9 = 0 THEN ' ' ELSE p_brand END AS source, CASE WHEN p_partkey % 7 = 0 THEN '' ELSE p_type END AS target, p_partkey % 2 = 0 AS cs, p_partkey % 5 = 0 AS keep, CASE p_partkey % 4 WHEN 0 THEN 'translated' WHEN 1 THEN 'preserved' WHEN 2 THEN 'odd' ELSE 'transliterated' END AS mode FROM part) SELECT ord, concat_ws(',', CASE WHEN trim(source) = '' THEN 'empty_source' END, CASE WHEN NOT keep AND trim(target) = '' THEN 'empty_target' END, CASE WHEN mode = 'odd' THEN 'mode' END, CASE WHEN keep AND mode <> 'preserved' THEN 'preserve_mode' END, CASE WHEN row_number() OVER (PARTITION BY set_id, CASE WHEN cs THEN source ELSE lower(source) END ORDER BY ord) > 1 THEN 'duplicate' END) AS errors FROM x")
def glossary_errors(spark, d):
    k = F.col("p_partkey")
    g = I.table(spark, d, "part").select(k.alias("ord"), F.col("p_size").alias("set_id"), F.when(k % 9 == 0, " ").otherwise(F.col("p_brand")).alias("source"), F.when(k % 7 == 0, "").otherwise(F.col("p_type")).alias("target"), (k % 2 == 0).alias("case_sensitive"), (k % 5 == 0).alias("do_not_translate"), F.when(k % 4 == 0, "translated").when(k % 4 == 1, "preserved").when(k % 4 == 2, "odd").otherwise("transliterated").alias("mode"))
    return translate.glossary_errors(g).select("ord", F.array_join("errors", ",").alias("errors"))


def old_segments(spark, d):
    k = F.col("pos")
    text = F.when(k % 4 == 3, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return I.segments(spark, d).where("pos % 5 <> 4").select("doc_id", "id", text.alias("source_text"), F.reverse("text").alias("translated_text"), F.lower("text").alias("final_text"), (k % 2 == 0).alias("manual_edited"), F.when(k % 3 == 0, "queued").otherwise("translated").alias("status"))


def new_segments(spark, d):
    return I.segments(spark, d).select("doc_id", "pos", "id", F.col("text").alias("source_text"), F.lit(None).cast("string").alias("translated_text"), F.lit(None).cast("string").alias("final_text"), F.lit("pending").alias("status"))


@query("J8_carried_edits", f"WITH {I.SEGMENTS} SELECT doc_id, pos, CASE WHEN pos % 5 <> 4 AND pos % 4 <> 3 AND pos % 2 = 0 THEN lower(text) END AS final_text, (pos % 5 <> 4 AND pos % 4 <> 3 AND pos % 2 = 0) AS carried FROM sg")
def carried(spark, d):
    return translate.carried_over(new_segments(spark, d), old_segments(spark, d)).select("doc_id", "pos", "final_text", "carried")


@query("J9_resumed_segments", f"WITH {I.SEGMENTS} SELECT doc_id, pos, CASE WHEN pos % 5 <> 4 AND pos % 4 <> 3 AND pos % 3 <> 0 THEN reverse(text) END AS translated_text, CASE WHEN pos % 5 <> 4 AND pos % 4 <> 3 AND pos % 3 <> 0 THEN 'translated' ELSE 'pending' END AS status FROM sg")
def resumed(spark, d):
    return translate.resumed(new_segments(spark, d), old_segments(spark, d)).select("doc_id", "pos", "translated_text", "status")


@query("J10_answer_parity", f"WITH {I.SEGMENTS}, b AS (SELECT doc_id AS batch, bool_and(NOT (doc_id % 3 = 1 AND pos = 0) AND NOT (doc_id % 3 = 2 AND pos % 4 = 1)) AS ok FROM sg GROUP BY doc_id) SELECT batch, ok FROM b")
def parity(spark, d):
    asked = I.segments(spark, d).select(F.col("doc_id").alias("batch"), "pos", "id")
    answered = asked.where("not (batch % 3 = 1 and pos = 0)").withColumn("id", F.when((F.col("batch") % 3 == 2) & (F.col("pos") % 4 == 1), "other").otherwise(F.col("id")))
    return translate.answer_parity(asked, answered)


@query("A17_A16_unit_status", f"WITH {I.SEGMENTS}, m AS (SELECT doc_id, pos // 5 AS unit, pos, CASE (doc_id + pos) % 13 WHEN 0 THEN 'flagged' WHEN 1 THEN 'queued' ELSE 'translated' END AS status, (doc_id + pos) % 7 = 0 AS man, 'w' || (pos % 3) AS w FROM sg), w AS (SELECT doc_id, unit, w, min(pos) AS p FROM m GROUP BY ALL), s AS (SELECT doc_id, unit, CASE WHEN bool_or(status = 'flagged') THEN 'flagged' WHEN bool_or(man) THEN 'manual_final' WHEN bool_and(status = 'translated') THEN 'translated' ELSE 'queued' END AS status FROM m GROUP BY ALL), v AS (SELECT doc_id, unit, string_agg(w, ',' ORDER BY p) AS warnings FROM w GROUP BY ALL) SELECT * FROM s JOIN v USING (doc_id, unit)")
def unit_status(spark, d):
    k = (F.col("doc_id") + F.col("pos")) % 13
    m = I.segments(spark, d).select("doc_id", F.floor(F.col("pos") / 5).alias("unit"), "pos", F.when(k == 0, "flagged").when(k == 1, "queued").otherwise("translated").alias("status"), ((F.col("doc_id") + F.col("pos")) % 7 == 0).alias("manual_edited"), F.array(F.concat(F.lit("w"), (F.col("pos") % 3).cast("string"))).alias("warnings"))
    return translate.unit_status(m).select("doc_id", "unit", "status", F.array_join("warnings", ",").alias("warnings"))


@query("P33_cost", f"WITH {I.SEGMENTS} SELECT doc_id, (sum(CASE WHEN status <> 'preserved' THEN length(text) ELSE 0 END) * 2)::BIGINT AS chars FROM sg GROUP BY doc_id")
def cost(spark, d):
    return translate.cost(I.segments(spark, d), 20.0, True).select("doc_id", F.col("chars").cast("long").alias("chars"))


@query("X1_provider_identity", f"WITH {I.SEGMENTS} SELECT doc_id || '/' || id AS id, text AS translated, 'translated' AS status FROM sg")
def provider(spark, d):
    s = I.segments(spark, d).select(F.concat(F.col("doc_id").cast("string"), F.lit("/"), "id").alias("id"), "text")
    return providers.hybrid(s, providers.Identity(), providers.Dictionary({})).select("id", "translated", "status")


class _Fussy(providers.Identity):
    """Fails on a word, and gives no more than some characters of a text."""

    name, word, most = "fussy", "password", 2000

    def translate(self, texts):
        if texts.str.contains(self.word, regex=False).any():
            raise ValueError("refused")
        return [providers.Reply(t[: self.most], True) if len(t) > self.most else t for t in texts]


@query("X2_T7_outcomes", f"WITH {I.SEGMENTS} SELECT doc_id || '/' || id AS id, CASE WHEN contains(text, 'password') THEN 'failed' WHEN length(text) > 2000 THEN 'truncated' ELSE 'translated' END AS status, CASE WHEN contains(text, 'password') THEN 'refused' WHEN length(text) > 2000 THEN 'truncated' END AS error, CASE WHEN NOT contains(text, 'password') THEN length(left(text, 2000)) END AS n FROM sg")
def outcomes(spark, d):
    """Lines by a provider that refuses some: each of these fails alone."""
    s = I.segments(spark, d).select(F.concat(F.col("doc_id").cast("string"), F.lit("/"), "id").alias("id"), "text")
    return providers.translated(s, _Fussy()).select("id", "status", "error", F.length("translated").cast("long").alias("n"))


@query("X4_request_envelope", "SELECT doc_id, '{\"id\":' || doc_id || ',\"lang\":\"' || lang || '\",\"source\":\"' || source || '\"}' AS envelope FROM documents")
def envelope(spark, d):
    return I.table(spark, d, "documents").select("doc_id", F.to_json(F.struct(F.col("doc_id").alias("id"), "lang", "source")).alias("envelope"))


@query(
    "V6_translation_warnings",
    f"""WITH {_PAIR}, {_GL}, t AS (SELECT pair_id, 'date' AS kind, unnest(regexp_extract_all(source, '(?i)\\b\\d{{1,4}}[-/.]\\d{{1,2}}[-/.]\\d{{1,4}}\\b')) AS token, 1 AS n FROM pr UNION ALL SELECT pair_id, 'time', unnest(regexp_extract_all(source, '(?i)\\b\\d{{1,2}}:\\d{{2}}(?::\\d{{2}})?\\b')), 1 FROM pr
  UNION ALL SELECT pair_id, 'date', unnest(regexp_extract_all(target, '(?i)\\b\\d{{1,4}}[-/.]\\d{{1,2}}[-/.]\\d{{1,4}}\\b')), -1 FROM pr UNION ALL SELECT pair_id, 'time', unnest(regexp_extract_all(target, '(?i)\\b\\d{{1,2}}:\\d{{2}}(?::\\d{{2}})?\\b')), -1 FROM pr),
s AS (SELECT pair_id, kind, token, sum(n) AS n FROM t GROUP BY ALL HAVING sum(n) <> 0),
u AS (SELECT pair_id, CASE kind WHEN 'date' THEN 2 ELSE 4 END + (n < 0)::INT AS rank, kind || CASE WHEN n > 0 THEN '_changed: ' ELSE '_unexpected: ' END AS head, token, unnest(range(abs(n)::BIGINT)) AS again FROM s),
w AS (SELECT pair_id, rank, 'critical_' || head || array_to_string(list_sort(list(token))[1:5], ', ') AS text FROM u GROUP BY pair_id, rank, head
  UNION ALL SELECT pair_id, 1000, 'glossary_term_changed: ' || term FROM pr JOIN gl ON contains(CASE WHEN cs THEN source ELSE lower(source) END, CASE WHEN cs THEN term ELSE lower(term) END) WHERE NOT contains(CASE WHEN cs THEN target ELSE lower(target) END, CASE WHEN cs THEN CASE WHEN keep THEN term ELSE wanted END ELSE lower(CASE WHEN keep THEN term ELSE wanted END) END))
SELECT pair_id, coalesce(string_agg(text, ' | ' ORDER BY rank, text), '') AS warnings FROM pr LEFT JOIN w USING (pair_id) GROUP BY pair_id""",
)
def warnings(spark, d):
    # a language without a script of its own: the script's part has a query and cases of its own
    return translate.translation_warnings(pairs(spark, d), glossary(spark), "xx", ("date", "time")).select("pair_id", F.array_join("warnings", " | ").alias("warnings"))


@query("A18_validator_metrics", f"WITH {I.SEGMENTS}, x AS (SELECT doc_id, CASE WHEN pos % 11 = 7 AND doc_id % 3 = 0 THEN 'unresolved' WHEN pos % 11 = 5 AND doc_id % 4 = 0 THEN 'flagged_for_human_review' ELSE status END AS status, CASE WHEN pos % 13 = 2 AND doc_id % 5 = 0 THEN 'b: x' WHEN pos % 13 = 4 AND doc_id % 5 = 0 THEN 'a' END AS w FROM sg) SELECT doc_id, count(*) AS total, count(*) FILTER (status IN ('unresolved', 'flagged_for_human_review') OR w IS NOT NULL) AS flagged, CASE WHEN count(*) FILTER (status IN ('unresolved', 'flagged_for_human_review') OR w IS NOT NULL) > 0 THEN 'partial' ELSE 'completed' END AS status, array_to_string(list_sort(list(DISTINCT split_part(w, ':', 1)) FILTER (w IS NOT NULL)), ',') AS kinds FROM x GROUP BY doc_id")
def metrics(spark, d):
    k, n = F.col("doc_id"), F.col("pos")
    s = I.segments(spark, d)
    status = F.when((n % 11 == 7) & (k % 3 == 0), "unresolved").when((n % 11 == 5) & (k % 4 == 0), "flagged_for_human_review").otherwise(F.col("status"))
    w = F.when((n % 13 == 2) & (k % 5 == 0), F.array(F.lit("b: x"))).when((n % 13 == 4) & (k % 5 == 0), F.array(F.lit("a")))
    got = translate.validator_metrics(s.select("doc_id", status.alias("status"), w.alias("warnings")))
    return got.select("doc_id", "total", "flagged", "status", F.when(F.size("kinds") > 0, F.array_join("kinds", ",")).alias("kinds"))


@query("D11_saved_translations")
def saved(spark, d):
    s = I.segments(spark, d).select("doc_id", "id", "pos", F.col("text").alias("source_text"), F.lit(None).cast("string").alias("final_text"), F.when((F.col("pos") == 5) & (F.col("doc_id") % 4 == 0), "unresolved").otherwise("pending").alias("status"), F.array().cast("array<string>").alias("warnings"))
    models = s.select("doc_id").distinct().select("doc_id", (F.col("doc_id") % 3).alias("revision"), (F.col("doc_id") % 7 == 0).alias("stale"))
    edits = s.where("pos % 3 = 2").select("doc_id", "id", F.upper("source_text").alias("text"), F.lit(1).cast("long").alias("base_revision"))
    outcome, _ = translate.translation_saved(models, s.drop("pos"), edits, glossary(spark), "xx", ("date", "time"))
    return outcome
