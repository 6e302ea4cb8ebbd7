"""Queries of the scalar rules."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from pagewright.functions import arrow as A
from pagewright.functions import text as T
from pagewright.operators import geometry
from pagewright.sources import files, raster, structure

from . import inputs as I

QUERIES: dict = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = (fn, sql)
        return fn

    return add


_STRIP = lambda c: f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"
_CODE = lambda c: f"""(regexp_matches({c}, '^\\s{{2,}}\\S') OR regexp_matches({_STRIP(c)}, '^(?:def|class)\\s+[A-Za-z_]\\w*') OR regexp_matches({_STRIP(c)}, '^function\\s+[A-Za-z_]\\w*\\s*\\(') OR regexp_matches({_STRIP(c)}, '^(?:const|let|var)\\s+[A-Za-z_]\\w*\\s*=')
  OR regexp_matches({_STRIP(c)}, '^(?:import\\s+|#include\\b|</?[A-Za-z][^>]*>)') OR regexp_matches({_STRIP(c)}, '^[A-Za-z_]\\w*(?:\\.[A-Za-z_]\\w*)*\\([^\\n)]*\\);?$') OR contains({_STRIP(c)}, '=>') OR (contains({_STRIP(c)}, '{{') AND (contains({_STRIP(c)}, '}}') OR {_STRIP(c)} LIKE '%;')))"""  # noqa: E731


@query("P1_encoding_quality", f"WITH {I.THAI_SQL} SELECT doc_id, ln, (contains(line, chr(65533)) OR len(regexp_extract_all(line, '[\\x{{E000}}-\\x{{F8FF}}]')) > greatest(2.0, length(line) * 0.05) OR len(regexp_extract_all(line, '[\\x{{0E48}}-\\x{{0E4E}}]{{2,}}')) > 5) AS broken FROM (SELECT doc_id, ln, replace(replace(line, 'ont', '่้'), 'qu', chr(57345)) AS line FROM th)")
def encoding(spark, d):
    line = F.replace(F.replace("line", F.lit("ont"), F.lit("่้")), F.lit("qu"), F.lit(""))
    return I.thai(spark, d).select("doc_id", "ln", T.encoding_broken(line).alias("broken"))


@query("P2_visually_blank", "SELECT l_orderkey, l_linenumber, l_quantity, (CASE WHEN l_quantity - l_tax * 100 < 5 THEN true ELSE sqrt(l_discount * 100) < 2.0 END) AS blank FROM lineitem")
def blank(spark, d):
    li = I.table(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_quantity", T.visually_blank(F.col("l_tax") * 100, F.col("l_quantity"), F.col("l_discount") * 100).alias("blank"))


@query(
    "P3_page_routing",
    """WITH s AS (SELECT doc_id, length(regexp_replace(text, '\\s', '', 'g')) % 30 AS chars, doc_id % 11 = 0 AS broken, doc_id % 3 AS images, (doc_id % 50) / 50.0::DOUBLE AS area, doc_id % 2 = 0 AS blank FROM documents)
SELECT doc_id, CASE WHEN chars = 0 THEN CASE WHEN blank THEN 'blank' ELSE 'ocr_image' END WHEN broken THEN 'ocr_image' WHEN images > 0 AND area >= 0.4 AND chars < 15 THEN 'ocr_image' WHEN images > 0 AND area >= 0.15 AND chars >= 15 THEN 'hybrid' ELSE 'direct_text' END AS route FROM s""",
)
def routing(spark, d):
    s = I.table(spark, d, "documents").select("doc_id", (F.length(F.regexp_replace("text", r"\s", "")) % 30).alias("chars"))
    return s.select("doc_id", T.route(F.col("chars"), F.col("doc_id") % 11 == 0, F.col("doc_id") % 3, (F.col("doc_id") % 50) / 50.0, F.col("doc_id") % 2 == 0).alias("route"))


@query("P4_script_and_printable", f"WITH {I.THAI_SQL} SELECT doc_id, ln, len(regexp_extract_all(line, '[\\x{{0E00}}-\\x{{0E7F}}]'))::BIGINT AS thai, CASE WHEN length(line) > 0 THEN round_even(length(regexp_replace(line, '\\s', '', 'g')) / length(line), 4) ELSE 0 END AS printable FROM th")
def printable(spark, d):
    return I.thai(spark, d).select("doc_id", "ln", F.regexp_count("line", F.lit(T.THAI)).cast("long").alias("thai"), T.printable_ratio(F.col("line")).alias("printable"))


@query("P5_P6_ocr_repair", f"WITH {I.THAI_SQL}, n AS (SELECT doc_id, ln, line, regexp_replace(regexp_replace(replace(replace(nfc_normalize(line), chr(8203), ''), chr(65279), ''), '([\\x{{0E01}}-\\x{{0E2E}}])[ \\x{{A0}}]+([\\x{{0E48}}-\\x{{0E4B}}])\\x{{0E32}}', '\\1\\2\\x{{0E33}}', 'g'), '([\\x{{0E01}}-\\x{{0E2E}}])[ \\x{{A0}}]+\\x{{0E32}}', '\\1\\x{{0E33}}', 'g') AS fixed FROM th) SELECT doc_id, ln, fixed, CASE WHEN fixed <> line THEN line END AS source_text FROM n".replace("\\x{0E33}", "ำ"))
def repair(spark, d):
    t = I.thai(spark, d).withColumn("fixed", T.repair_sara_am(A.nfc(F.col("line"))))
    return t.select("doc_id", "ln", "fixed", F.when(F.col("fixed") != F.col("line"), F.col("line")).alias("source_text"))


_KNOWN = ", ".join(f"('{k}', '{a}', '{b}')" for k, (a, b) in T.KNOWN_CORRECTIONS.items())


@query("P7_known_corrections", f"WITH {I.THAI_SQL}, w AS (SELECT doc_id, ln, i, w FROM (SELECT doc_id, ln, unnest(string_split(line, ' ')) AS w, generate_subscripts(string_split(line, ' '), 1) - 1 AS i FROM th)), k(w, c, g) AS (VALUES {_KNOWN}) SELECT doc_id, ln, i AS pos, w.w AS word, k.c AS corrected, k.g AS category FROM w JOIN k ON w.w = k.w")
def known(spark, d):
    w = I.thai(spark, d).select("doc_id", "ln", F.posexplode(F.split("line", " ", -1)).alias("pos", "word"))
    return w.withColumn("k", T.known_correction(F.col("word"))).where("k.corrected is not null").select("doc_id", "ln", "pos", "word", "k.corrected", "k.category")


def _spots_sql() -> str:
    """Spots by pattern: literals with a look ahead by their places, others by the lengths between matches."""
    parts = []
    for i, (pattern, _) in enumerate(T.SPOTS):
        word, ahead, rest = pattern.partition("(?=")
        p = re.sub(r"\\u(....)", r"\\x{\1}", pattern)
        if ahead:
            follows = re.sub(r"\\u(....)", r"\\x{\1}", rest.partition("|")[0])
            parts.append(f"SELECT doc_id, ln, {i} AS i, pos - 1 AS s, pos - 1 + {len(word)} AS e, '{word}' AS m FROM (SELECT doc_id, ln, line, unnest(range(1, length(line) + 1)) AS pos FROM th WHERE contains(line, '{word}')) WHERE substr(line, pos, {len(word)}) = '{word}' AND (pos + {len(word)} > length(line) OR regexp_matches(substr(line, pos + {len(word)}, 1), '{follows}'))")
        else:
            parts.append(f"""SELECT doc_id, ln, {i} AS i, (e - length(m))::BIGINT AS s, e::BIGINT AS e, m FROM (SELECT doc_id, ln, m, sum(length(g) + length(m)) OVER (PARTITION BY doc_id, ln ORDER BY k) AS e FROM (SELECT doc_id, ln, unnest(regexp_extract_all(line, '{p}')) AS m,
  unnest(string_split_regex(line, '{p}')[:len(regexp_extract_all(line, '{p}'))]) AS g, generate_subscripts(regexp_extract_all(line, '{p}'), 1) AS k FROM th WHERE regexp_matches(line, '{p}')))""")
    reasons = " ".join(f"WHEN {i} THEN '{r}'" for i, (_, r) in enumerate(T.SPOTS))
    known = " ".join(f"WHEN '{k}' THEN '{c}'" for k, (c, _) in T.KNOWN_CORRECTIONS.items())
    split = "([\\x{0E01}-\\x{0E2E}])[ \\x{00A0}]+([\\x{0E48}-\\x{0E4B}]?)\\x{0E32}"
    return f"""WITH {I.THAI_SQL}, x AS ({" UNION ALL ".join(parts)}), o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, ln, s, e ORDER BY i) AS r FROM x)
SELECT doc_id, ln, s::INT AS start, e::INT AS "end", m AS matched, CASE i {reasons} END AS reason, coalesce(CASE m {known} END, CASE WHEN regexp_full_match(m, '{split}') THEN regexp_replace(m, '{split}', '\\1\\2ำ') END) AS suggested FROM o WHERE r = 1"""


@query("P8_suspicious_spots", _spots_sql())
def spots(spark, d):
    from pagewright.operators.correct import suspicious

    return suspicious(I.thai(spark, d).select("doc_id", "ln", F.col("line").alias("text")))


_EXACT = ("date", "time", "money", "url", "email", "citation")
_INJECT = "line || CASE doc_id % 5 WHEN 0 THEN ' on 2024-03-05 at 10:30' WHEN 1 THEN ' $1,250.50 see [12]' WHEN 2 THEN ' https://e.org/p a.b@x.co' WHEN 3 THEN ' (Smith, 2020) 12:05:09' ELSE '' END"


def injected_lines(spark, d):
    k = F.col("doc_id") % 5
    return I.lines(spark, d).select("doc_id", "ln", F.concat("line", F.when(k == 0, " on 2024-03-05 at 10:30").when(k == 1, " $1,250.50 see [12]").when(k == 2, " https://e.org/p a.b@x.co").when(k == 3, " (Smith, 2020) 12:05:09").otherwise("")).alias("line"))


@query("P9_critical_tokens", f"WITH {I.LINES}, x AS (SELECT doc_id, ln, {_INJECT} AS line FROM ln) SELECT doc_id, ln, " + ", ".join(f"array_to_string(regexp_extract_all(line, '(?i){T.CRITICAL[k]}'), ' ; ') AS {k}_tokens" for k in _EXACT) + " FROM x")
def critical(spark, d):
    # \b, \d and \w as the oracle reads them: ASCII
    plain = lambda k: F.regexp_extract_all("line", F.lit("(?i)" + T.CRITICAL[k]), F.lit(0))
    return injected_lines(spark, d).select("doc_id", "ln", *(F.array_join(plain(k), " ; ").alias(f"{k}_tokens") for k in _EXACT))


@query("P9_number_unit_code_tokens")
def critical_rest(spark, d):
    return injected_lines(spark, d).select("doc_id", "ln", *(F.array_join(T.critical(F.col("line"), k), " ; ").alias(f"{k}_tokens") for k in ("number", "unit", "code")))


_PREFIX = "(CASE (doc_id + ln) % 8 WHEN 0 THEN 'def f' WHEN 1 THEN '  ' WHEN 2 THEN 'const x = ' WHEN 3 THEN '<p>' WHEN 4 THEN 'import ' WHEN 5 THEN 'a => ' WHEN 6 THEN '{ ; } ' ELSE '' END) || line"


def code_lines(spark, d):
    k = (F.col("doc_id") + F.col("ln")) % 8
    p = F.when(k == 0, "def f").when(k == 1, "  ").when(k == 2, "const x = ").when(k == 3, "<p>").when(k == 4, "import ").when(k == 5, "a => ").when(k == 6, "{ ; } ").otherwise("")
    return I.lines(spark, d).select("doc_id", "ln", F.concat(p, "line").alias("line"))


@query("P10_looks_like_code", f"WITH {I.LINES}, x AS (SELECT doc_id, ln, {_PREFIX} AS line FROM ln) SELECT doc_id, ln, {_CODE('line')} AS code FROM x")
def code(spark, d):
    return code_lines(spark, d).select("doc_id", "ln", T.looks_like_code(F.col("line")).alias("code"))


@query(
    "P11_language_tags",
    """WITH x AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN upper(lang) WHEN 1 THEN lang || '-us' WHEN 2 THEN lang || '-Latn-gb' WHEN 3 THEN ' ' || lang || ' ' WHEN 4 THEN lang || '_x' ELSE source END AS v FROM documents)
SELECT doc_id, CASE WHEN regexp_matches(trim(v), '^[A-Za-z]{2,3}(?:-[A-Za-z0-9]{2,8})*$') THEN array_to_string(list_transform(string_split(trim(v), '-'), lambda p, i: CASE WHEN i = 1 THEN lower(p) WHEN length(p) = 2 THEN upper(p) ELSE p END), '-') END AS tag FROM x""",
)
def tags(spark, d):
    k = F.col("doc_id") % 6
    v = F.when(k == 0, F.upper("lang")).when(k == 1, F.concat("lang", F.lit("-us"))).when(k == 2, F.concat("lang", F.lit("-Latn-gb"))).when(k == 3, F.concat(F.lit(" "), "lang", F.lit(" "))).when(k == 4, F.concat("lang", F.lit("_x"))).otherwise(F.col("source"))
    return I.table(spark, d, "documents").select("doc_id", T.language_tag(v).alias("tag"))


@query("P13_glossary_term_language", "SELECT c_custkey, (length(trim(c_mktsegment)) < 4 OR regexp_matches(c_mktsegment, '[\\x{0E00}-\\x{0E7F}]')) AS fits_th, (length(trim(c_mktsegment)) < 4 OR regexp_matches(c_mktsegment, '[A-Za-z]')) AS fits_en FROM customer")
def term_language(spark, d):
    return I.table(spark, d, "customer").select("c_custkey", T.term_fits_language(F.col("c_mktsegment"), "th-TH").alias("fits_th"), T.term_fits_language(F.col("c_mktsegment"), "en").alias("fits_en"))


@query(
    "P14_target_script_missing",
    f"WITH {I.LINES} SELECT doc_id, ln, (NOT {_CODE('line')} AND len(regexp_extract_all(line, '[A-Za-z\\x{{0E00}}-\\x{{0E7F}}\\x{{3400}}-\\x{{9FFF}}\\x{{3040}}-\\x{{30FF}}\\x{{AC00}}-\\x{{D7AF}}]')) >= 12 AND len(regexp_extract_all(line, '\\S+')) >= 3 AND NOT regexp_matches(CASE WHEN ln % 2 = 0 THEN line || ' กข' ELSE line END, '[\\x{{0E00}}-\\x{{0E7F}}]')) AS missing FROM ln",
)
def target_script(spark, d):
    target = F.when(F.col("ln") % 2 == 0, F.concat("line", F.lit(" กข"))).otherwise(F.col("line"))
    return I.lines(spark, d).select("doc_id", "ln", T.target_script_missing(F.col("line"), target, "th").alias("missing"))


_BEFORE = "rtrim(line) || (CASE (doc_id + ln) % 7 WHEN 0 THEN '-' WHEN 1 THEN ' -' WHEN 2 THEN chr(173) WHEN 3 THEN ' self-' WHEN 4 THEN '_x-' WHEN 5 THEN '9-' ELSE '' END)"
_AFTER = "(CASE (doc_id + ln) % 4 WHEN 0 THEN 'Upper' WHEN 1 THEN '7' ELSE '' END) || lower(line)"


@query(
    "P15_dehyphenation",
    f"""WITH {I.LINES}, x AS (SELECT doc_id, ln, {_BEFORE} AS b, {_AFTER} AS a FROM ln)
SELECT doc_id, ln, CASE WHEN b LIKE '%' || chr(173) THEN 'soft_hyphen_merge' WHEN b NOT LIKE '%-' THEN 'line_continuation' WHEN b LIKE '% -' THEN 'minus_sign_preserve'
  WHEN regexp_matches(b, 'https?://|\\S+@\\S+') OR regexp_matches(a, 'https?://|\\S+@\\S+') OR {_CODE('b')} OR {_CODE('a')} OR regexp_matches(b, '[`_]|\\b[A-Za-z0-9]+_[A-Za-z0-9]+\\b') OR regexp_matches(b, '\\[\\d+\\]|\\(\\w+,\\s*\\d{{4}}\\)') THEN 'code_or_identifier_preserve'
  WHEN regexp_extract(b, '([A-Za-z]+)-$', 1) = '' OR regexp_extract(a, '^([A-Za-z]+)', 1) = '' THEN 'non_alpha_hyphen_preserve' WHEN regexp_matches(a, '^[A-Z]') THEN 'capitalized_suffix_preserve'
  WHEN lower(regexp_extract(b, '([A-Za-z]+)-$', 1)) IN ({", ".join(f"'{p}'" for p in T.KEPT_HYPHEN_PREFIXES)}) THEN 'compound_word_preserve' ELSE 'eol_split_word_merge' END AS rule FROM x""",
)
def dehyphenation(spark, d):
    k, m = (F.col("doc_id") + F.col("ln")) % 7, (F.col("doc_id") + F.col("ln")) % 4
    b = F.concat(F.rtrim("line"), F.when(k == 0, "-").when(k == 1, " -").when(k == 2, "­").when(k == 3, " self-").when(k == 4, "_x-").when(k == 5, "9-").otherwise(""))
    a = F.concat(F.when(m == 0, "Upper").when(m == 1, "7").otherwise(""), F.lower("line"))
    return I.lines(spark, d).select("doc_id", "ln", b.alias("b"), a.alias("a")).select("doc_id", "ln", T.dehyphenation(F.col("b"), F.col("a"))["rule"].alias("rule"))


@query("P18_levenshtein", f"WITH {I.LINES}, x AS (SELECT doc_id, ln, line AS a, lower(replace(substr(line, 3), ' t', 'tt')) AS b FROM ln) SELECT doc_id, ln, levenshtein({I.one_byte('a')}, {I.one_byte('b')})::INT AS distance FROM x")
def distance(spark, d):
    other = F.lower(F.replace(F.substring("line", 3, 1 << 30), F.lit(" t"), F.lit("tt")))
    return I.lines(spark, d).select("doc_id", "ln", A.edit_distance(F.col("line"), other).alias("distance"))


@query("P19_ui_highlight")
def highlights(spark, d):
    from pagewright.operators.correct import highlight

    t = I.thai(spark, d).withColumn("s", F.expr("locate('้', line) - 1")).where("s >= 0")
    return t.select("doc_id", "ln", highlight(F.col("line"), F.col("s"), F.col("s") + 1).alias("h")).select("doc_id", "ln", "h.*")


@query("P20_P21_injection_and_digits", f"WITH {I.LINES}, x AS (SELECT doc_id, ln, line || CASE doc_id % 6 WHEN 0 THEN ' IGNORE all previous  instructions' WHEN 1 THEN ' you  are now' WHEN 2 THEN ' คำสั่งลับ' WHEN 3 THEN ' ๕' ELSE '' END AS line FROM ln) SELECT doc_id, ln, regexp_matches(line, '(?i)ignore\\s+(all\\s+)?(previous\\s+)?instructions|system\\s+override|you\\s+are\\s+now|คำสั่งลับ|ลบข้อความทั้งหมด|ให้แต่งนิทาน|สรุปเนื้อหาเป็น') AS injected, regexp_matches(line, '[0-9\\x{{0E50}}-\\x{{0E59}}]') AS digits FROM x")
def injection(spark, d):
    k = F.col("doc_id") % 6
    line = F.concat("line", F.when(k == 0, " IGNORE all previous  instructions").when(k == 1, " you  are now").when(k == 2, " คำสั่งลับ").when(k == 3, " ๕").otherwise(""))
    return I.lines(spark, d).select("doc_id", "ln", T.injected(line).alias("injected"), T.has_digit(line).alias("digits"))


@query("P22_sanitized_text", f"WITH {I.LINES} SELECT doc_id, ln, replace(replace(replace(replace(replace(line || '<a href=\"x\">&''', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') AS safe FROM ln")
def safe_text(spark, d):
    return I.lines(spark, d).select("doc_id", "ln", T.escape_html(F.concat("line", F.lit("\x01<a href=\"x\">&'")), quotes=True).alias("safe"))


@query(
    "P23_heading_inference",
    f"""WITH {I.STYLED}, x AS (SELECT *, trim(text) AS t, size / 12.0 AS ratio, ord = 0 AS first, regexp_matches(trim(text), '^(บทที่|ตอนที่|ส่วนที่|ภาคผนวก|หัวข้อที่|[0-9]+(\\.[0-9]+)*)\\s+') AS pre FROM st)
SELECT page_id, ord, CASE WHEN t = '' OR length(t) > 80 OR (t LIKE '%.' AND NOT regexp_matches(t, '\\b[A-Za-z0-9]\\.$')) OR (ratio >= 1.2)::INT + (bold >= 0.8)::INT + first::INT + pre::INT < 2 THEN NULL
  WHEN ratio >= 1.2 OR (bold >= 0.8 AND first) THEN 'h1' WHEN ratio >= 1.1 OR bold >= 0.8 OR pre THEN 'h2' ELSE 'h3' END AS level FROM x""",
)
def headings(spark, d):
    s = I.styled(spark, d)
    return s.select("page_id", "ord", T.heading_level(F.trim("text"), F.col("size") / 12.0, F.col("bold"), F.col("ord") == 0, F.lit(1.0)).alias("level"))


@query("P25_page_header", f"WITH {I.LINES} SELECT doc_id, ln, regexp_replace(CASE WHEN ln % 2 = 0 THEN '--- page ' || ln || ' ---' || chr(10) || line ELSE line END, '(?i)^\\s*---\\s*Page\\s+\\d+\\s*---\\s*\\n?', '') AS t FROM ln")
def page_header(spark, d):
    line = F.when(F.col("ln") % 2 == 0, F.concat(F.lit("--- page "), F.col("ln").cast("string"), F.lit(" ---\n"), "line")).otherwise(F.col("line"))
    return I.lines(spark, d).select("doc_id", "ln", T.without_page_header(line).alias("t"))


@query("P26_list_markers", f"WITH {I.STYLED} SELECT page_id, ord, CASE WHEN NOT regexp_matches(text, '{T.LIST_BULLETS}') THEN NULL WHEN regexp_extract(text, '{T.LIST_BULLETS}', 2) = '' THEN 'unordered' ELSE 'ordered' END AS kind, try_cast(nullif(regexp_extract(text, '{T.LIST_BULLETS}', 2), '') AS INT) AS number, nullif(regexp_extract(text, '{T.LIST_BULLETS}', 3), '') AS body FROM st")
def markers(spark, d):
    return I.styled(spark, d).select("page_id", "ord", T.list_marker(F.col("text")).alias("m")).select("page_id", "ord", "m.*")


@query("P27_output_text", "SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 = 0 THEN '' END, CASE WHEN c_custkey % 2 = 0 THEN c_name END, c_mktsegment) AS out FROM customer")
def output(spark, d):
    k = F.col("c_custkey")
    return I.table(spark, d, "customer").select("c_custkey", T.output_text(F.when(k % 3 == 0, ""), F.when(k % 2 == 0, F.col("c_name")), F.col("c_mktsegment")).alias("out"))


@query("P28_stable_hash", "SELECT doc_id, substr(sha256(text), 1, 24) AS h FROM documents")
def hashes(spark, d):
    return I.table(spark, d, "documents").select("doc_id", T.stable_hash(F.col("text")).alias("h"))


#: source, target, case_sensitive, do_not_translate
_GLOSSARY = (("the", "the", False, False), ("and", "", True, True), ("de ", "", True, True))


@query("P30_token_protection", "WITH " + I.LINES + " SELECT doc_id, ln, true AS as_written, true AS changed_form, true AS all_missing FROM ln")
def protection(spark, d):
    from pagewright.operators import translate

    t = I.lines(spark, d).withColumn("p", A.protect_tokens(F.col("line"), translate.protected_terms(F.col("line"), _GLOSSARY)))
    same = lambda back: F.lower(back["text"]) == F.lower("line")
    changed = F.regexp_replace(F.lower("p.text"), "__(phase_token_[a-z]+)__", "__ $1\t_")
    gone = F.regexp_replace("p.text", "__PHASE_TOKEN_[A-Z]+__", "")
    back = lambda text: A.restore_tokens(text, F.col("p.held"))
    return t.select("doc_id", "ln", same(back(F.col("p.text"))).alias("as_written"), same(back(changed)).alias("changed_form"), (F.size(back(gone)["missing"]) == F.size("p.held")).alias("all_missing"))


@query("P31_safe_names", "SELECT doc_id, regexp_matches(CASE WHEN doc_id % 3 = 0 THEN source || '/' ELSE source END, '^[A-Za-z0-9_-]{1,64}$') AS safe_id, NOT (p LIKE '/%' OR contains(p, ':') OR regexp_matches(p, '(^|/)(\\.{0,2})(/|$)')) AS safe_path FROM (SELECT *, CASE doc_id % 5 WHEN 0 THEN '/' || source WHEN 1 THEN '../' || source WHEN 2 THEN lang || '//' || source WHEN 3 THEN lang || '/' || source ELSE 'c:' || source END AS p FROM documents)")
def names(spark, d):
    k = F.col("doc_id") % 5
    p = F.when(k == 0, F.concat(F.lit("/"), "source")).when(k == 1, F.concat(F.lit("../"), "source")).when(k == 2, F.concat("lang", F.lit("//"), "source")).when(k == 3, F.concat("lang", F.lit("/"), "source")).otherwise(F.concat(F.lit("c:"), "source"))
    return I.table(spark, d, "documents").select("doc_id", T.safe_job_id(F.when(F.col("doc_id") % 3 == 0, F.concat("source", F.lit("/"))).otherwise(F.col("source"))).alias("safe_id"), T.safe_member_path(p).alias("safe_path"))


#: Files made of parts: a PDF with a page tree of two levels, a JPEG with an Exif block, and what isn't whole.
_FILES = """f0 AS (SELECT p_partkey AS path, p_partkey % 6 AS k, p_partkey % 7 AS n, p_size % 5 = 0 AS locked, 1 + p_size % 8 AS turned, p_name, p_partkey % 200 + 1 AS w, p_size AS h FROM part),
f1 AS (SELECT *, array_to_string(list_transform(range(n), lambda i: (10 + i) || ' 0 R'), ' ') AS kids, array_to_string(list_transform(range(n), lambda i: (10 + i) || ' 0 obj << /Type /Page >> endobj' || chr(10)), '') AS leaves FROM f0),
f2 AS (SELECT *, CASE k WHEN 0 THEN encode('%PDF-1.4' || chr(10) || '1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj' || chr(10) || '2 0 obj << /Type /Pages /Kids [3 0 R] >> endobj' || chr(10) || '3 0 obj << /Type /Pages /Kids [' || kids || '] >> endobj' || chr(10) || leaves || 'trailer << /Root 1 0 R' || CASE WHEN locked THEN ' /Encrypt 9 0 R' ELSE '' END || ' >>')
  WHEN 1 THEN encode('%PDF-1.4 ' || p_name) WHEN 2 THEN encode(p_name) WHEN 3 THEN ''::BLOB
  ELSE unhex('FFD8FFE10022' || '4578696600004D4D002A00000008000101120003000000010' || '00' || turned || '000000000000' || 'FFC0000B08' || printf('%04X', h) || printf('%04X', w) || '01011100' || 'FFDA0008010100003F00' || '12FF0034' || CASE WHEN k = 4 THEN 'FFD9' ELSE '' END) END AS content FROM f1)"""


def made_files(spark, d):
    p = I.table(spark, d, "part")
    k, n, newline = F.col("p_partkey") % 6, (F.col("p_partkey") % 7).cast("int"), F.lit("\n")
    each = F.when(n > 0, F.sequence(F.lit(10), 9 + n)).otherwise(F.array().cast("array<int>"))
    kids = F.array_join(F.transform(each, lambda i: F.concat(i.cast("string"), F.lit(" 0 R"))), " ")
    leaves = F.array_join(F.transform(each, lambda i: F.concat(i.cast("string"), F.lit(" 0 obj << /Type /Page >> endobj\n"))), "")
    pdf = F.concat(F.lit("%PDF-1.4\n1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj\n2 0 obj << /Type /Pages /Kids [3 0 R] >> endobj\n3 0 obj << /Type /Pages /Kids ["), kids, F.lit("] >> endobj\n"), leaves, F.lit("trailer << /Root 1 0 R"), F.when(F.col("p_size") % 5 == 0, " /Encrypt 9 0 R").otherwise(""), F.lit(" >>"))
    word = lambda c: F.lpad(F.hex(c), 4, "0")
    jpeg = F.concat(F.lit("FFD8FFE100224578696600004D4D002A0000000800010112000300000001000"), (1 + F.col("p_size") % 8).cast("string"), F.lit("000000000000FFC0000B08"), word(F.col("p_size")), word(F.col("p_partkey") % 200 + 1), F.lit("01011100FFDA0008010100003F0012FF0034"), F.when(k == 4, "FFD9").otherwise(""))
    content = F.when(k == 0, pdf.cast("binary")).when(k == 1, F.concat(F.lit("%PDF-1.4 "), "p_name").cast("binary")).when(k == 2, F.col("p_name").cast("binary")).when(k == 3, F.lit(b"")).otherwise(F.unhex(jpeg))
    return p.select(F.col("p_partkey").alias("path"), content.alias("content"))


@query(
    "S1_S3_file_validation",
    f"""WITH {_FILES} SELECT path, CASE WHEN k < 2 THEN 'pdf' WHEN k < 4 THEN 'unsupported' ELSE 'jpeg' END AS type, sha256(content) AS sha256,
  CASE WHEN k = 0 AND NOT locked THEN n WHEN k = 4 THEN 1 END AS page_count, CASE WHEN k >= 4 THEN CASE WHEN turned >= 5 THEN h ELSE w END END AS width, CASE WHEN k >= 4 THEN CASE WHEN turned >= 5 THEN w ELSE h END END AS height, CASE WHEN k >= 4 THEN turned END AS orientation,
  k = 0 AND NOT locked OR k = 4 AS valid, CASE k WHEN 0 THEN CASE WHEN locked THEN 'encrypted' END WHEN 1 THEN 'damaged_pdf' WHEN 2 THEN 'unsupported_type' WHEN 3 THEN 'empty' WHEN 5 THEN 'damaged_image' END AS error FROM f2""",
)
def file_check(spark, d):
    return files.validated_files(made_files(spark, d)).drop("size_bytes")


@query("S4_S9_file_pages", f"""WITH {_FILES}, v AS (SELECT path, CASE WHEN k = 0 THEN n ELSE 1 END AS total FROM f2 WHERE k = 0 AND NOT locked OR k = 4),
g AS (SELECT path, unnest(range(2, least(4, total) + 1)) AS page_id FROM v), c AS (SELECT path, count(*) AS m FROM g GROUP BY path)
SELECT f2.path, CASE WHEN total IS NULL THEN 'failed' ELSE 'completed' END AS status, coalesce(total, 0) AS total_pages, coalesce(m, 0) AS processed_pages FROM f2 LEFT JOIN v USING (path) LEFT JOIN c USING (path)""")
def file_page_totals(spark, d):
    """Pages 2 to 4 of every file: an image, which is page 1 alone, is done with none."""
    return files.page_totals(files.validated_files(made_files(spark, d)), 2, 4)


@query("S2_file_parts", f"""WITH {I.PAGE_IMAGES}, p AS (SELECT *, CASE WHEN orientation >= 5 THEN height ELSE width END AS w, CASE WHEN orientation >= 5 THEN width ELSE height END AS h, CASE WHEN kind = 3 THEN 3 ELSE 1 END AS per FROM sz),
k AS (SELECT *, unnest(CASE WHEN orientation = 1 THEN ['chunk IHDR', 'chunk IDAT', 'chunk IEND', 'pixels'] ELSE ['chunk IHDR', 'chunk eXIf', 'chunk IDAT', 'chunk IEND', 'pixels'] END) AS part FROM p)
SELECT page_id, part AS kind, true AS ok, CASE part WHEN 'chunk IHDR' THEN w || ',' || h || ',8,' || (per - 1) || ',0' WHEN 'chunk eXIf' THEN orientation::VARCHAR WHEN 'pixels' THEN ((1 + w * per) * h)::VARCHAR ELSE '' END AS value FROM k""")
def parts(spark, d):
    got = structure.file_parts(I.page_images(spark, d), "page_id")
    return got.select("page_id", "kind", "ok", F.array_join(F.col("value").cast("array<string>"), ",").alias("value"))


@query("P2_blank_images", f"WITH {I.PAGE_IMAGES} SELECT page_id, width, height, kind < 2 AS blank FROM sz")
def blank_images(spark, d):
    seen = raster.rasters(I.page_images(spark, d), with_runs=False)
    return seen.select("page_id", F.col("width").cast("long").alias("width"), F.col("height").cast("long").alias("height"), T.visually_blank(F.col("low"), F.col("high"), F.col("variance")).alias("blank"))


@query("S9_oriented_boxes", f"""WITH {I.PAGE_IMAGES}, b AS (SELECT *, 10 AS x0, 10 AS y0, 10 + 20 * nc + thick AS x1, 10 + 15 * nr + thick AS y1 FROM sz WHERE kind >= 2)
SELECT page_id, orientation::INT AS orientation, x0::DOUBLE AS x0, y0::DOUBLE AS y0, x1::DOUBLE AS x1, y1::DOUBLE AS y1, true AS as_pixels FROM b""")
def oriented_boxes(spark, d):
    """The box of what is drawn, found in the stored pixels and carried by the orientation's
    matrix, against the box of the pixels once turned."""
    images = I.page_images(spark, d)
    s = images.select("page_id", "content", structure.structure("content").alias("s")).where(F.col("page_id") % 5 >= 2)
    upright = F.concat(F.substring("content", F.lit(1), F.lit(33)), F.when(F.col("s.orientation") == 1, F.substring("content", F.lit(34), F.octet_length("content"))).otherwise(F.substring("content", F.lit(34 + 12 + 26), F.octet_length("content"))))
    span = lambda seen: seen.select("page_id", F.array_min(F.transform("columns", lambda r: r["line"])).alias("a"), F.array_min(F.transform("rows", lambda r: r["line"])).alias("b"), (F.array_max(F.transform("columns", lambda r: r["line"])) + 1).alias("c"), (F.array_max(F.transform("rows", lambda r: r["line"])) + 1).alias("d"))
    stored = span(raster.rasters(s.select("page_id", upright.alias("content"))))
    seen = span(raster.rasters(images)).select("page_id", F.struct("a", "b", "c", "d").alias("seen"))
    m = structure.orienting(F.col("s.width"), F.col("s.height"), F.col("s.orientation"))
    at = lambda x, y: geometry.applied(m, F.col(x).cast("double"), F.col(y).cast("double"))
    got = stored.join(s.select("page_id", "s"), "page_id").join(seen, "page_id").withColumns({"p": at("a", "b"), "q": at("c", "d")})
    box = {n: f(F.col(f"p.{c}"), F.col(f"q.{c}")) for n, c, f in (("x0", "x", F.least), ("y0", "y", F.least), ("x1", "x", F.greatest), ("y1", "y", F.greatest))}
    same = (box["x0"] == F.col("seen.a")) & (box["y0"] == F.col("seen.b")) & (box["x1"] == F.col("seen.c")) & (box["y1"] == F.col("seen.d"))
    return got.select("page_id", F.col("s.orientation").alias("orientation"), *(c.alias(n) for n, c in box.items()), same.alias("as_pixels"))


@query("S4_page_numbers", "SELECT doc_id, unnest(generate_series(2, least(6, 1 + n_chars // 500))) AS page_id FROM documents WHERE 1 + n_chars // 500 >= 2")
def page_numbers(spark, d):
    docs = I.table(spark, d, "documents").select("doc_id", (1 + F.floor(F.col("n_chars") / 500)).alias("n_pages"))
    return files.page_numbers(docs, 2, 6).select("doc_id", F.col("page_id").cast("long").alias("page_id"))


@query("S15_variant_resolution", "SELECT o_custkey AS doc_id, min_by(o_orderstatus, CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'P' THEN 2 ELSE 3 END) AS variant FROM orders GROUP BY o_custkey")
def variants(spark, d):
    o = I.table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderstatus").alias("variant"), F.col("o_orderkey").cast("string").alias("path"), F.lit(10).alias("size_bytes"))
    return files.resolved_variant(o, ("O", "P", "F")).select("doc_id", "variant")


@query(
    "S20_glossary_lines",
    """WITH x AS (SELECT p_partkey AS ord, CASE p_partkey % 4 WHEN 0 THEN '!' || p_name WHEN 1 THEN '~' || p_brand || ' => ' || p_name WHEN 2 THEN p_brand || '=>' || p_name ELSE p_name END AS l FROM part)
SELECT ord, CASE WHEN l LIKE '!%' THEN trim(substr(l, 2)) ELSE regexp_extract(l, '^(~?)\\s*(.+?)\\s*=>\\s*(.+)$', 2) END AS source, CASE WHEN l LIKE '!%' THEN '' ELSE regexp_extract(l, '^(~?)\\s*(.+?)\\s*=>\\s*(.+)$', 3) END AS target,
  CASE WHEN l LIKE '!%' THEN 'preserved' WHEN l LIKE '~%' THEN 'transliterated' ELSE 'translated' END AS mode, CASE WHEN l NOT LIKE '!%' AND NOT contains(l, '=>') THEN 'syntax' END AS error FROM x""",
)
def glossary_lines(spark, d):
    k = F.col("p_partkey") % 4
    line = F.when(k == 0, F.concat(F.lit("!"), "p_name")).when(k == 1, F.concat(F.lit("~"), "p_brand", F.lit(" => "), "p_name")).when(k == 2, F.concat("p_brand", F.lit("=>"), "p_name")).otherwise(F.col("p_name"))
    rows = I.table(spark, d, "part").select(F.lit(1).alias("set_id"), F.col("p_partkey").alias("ord"), line.alias("line"))
    return files.parsed_glossary(rows).select("ord", "source", "target", "mode", "error")
