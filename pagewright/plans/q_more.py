"""Queries of markup, settings, noisy answers, grids and limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.operators import layout
from pagewright.sources import files, raster

from . import inputs as I

QUERIES: dict = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = (fn, sql)
        return fn

    return add


@query(
    "P24_inline_styles",
    f"""WITH {I.LINES}, x AS (SELECT doc_id, ln, line AS t, (ln % 10) / 10.0::DOUBLE AS b, (doc_id % 10) / 10.0::DOUBLE AS i FROM ln)
SELECT doc_id, ln, CASE WHEN b >= 0.8 OR i >= 0.8 OR ln % 3 = 0 THEN CASE WHEN b >= 0.8 THEN '<b>' ELSE '' END || CASE WHEN i >= 0.8 THEN '<i>' ELSE '' END || replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || CASE WHEN i >= 0.8 THEN '</i>' ELSE '' END || CASE WHEN b >= 0.8 THEN '</b>' ELSE '' END
  ELSE '<b>' || replace(replace(replace(substr(t, 1, 5), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</b>' || replace(replace(replace(substr(t, 6), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') END AS html FROM x""",
)
def inline(spark, d):
    t = F.col("line")
    part = lambda text, bold: F.struct(text.alias("text"), F.lit(bold).alias("bold"), F.lit(False).alias("italic"))
    spans = F.when(F.col("ln") % 3 == 0, F.array(part(F.lit("other\x00"), False))).otherwise(F.array(part(F.substring(t, 1, 5), True), part(F.substring(t, 6, 1 << 30), False)))
    return I.lines(spark, d).select("doc_id", "ln", T.inline_styles(t, (F.col("ln") % 10) / 10.0, (F.col("doc_id") % 10) / 10.0, spans).alias("html"))


@query(
    "P29_settings",
    """WITH x AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'auto' WHEN 1 THEN lang ELSE 'no_language' END AS s, CASE WHEN doc_id % 4 = 0 THEN 'FR' ELSE 'th-th' END AS t, CASE doc_id % 5 WHEN 0 THEN 'นิยาย' WHEN 1 THEN ' General ' WHEN 2 THEN 'odd' ELSE 'official' END AS y, CASE WHEN doc_id % 7 = 0 THEN 'other' ELSE 'Local' END AS p FROM documents),
n AS (SELECT doc_id, CASE WHEN s = 'auto' THEN 'auto' WHEN s = 'no_language' THEN NULL ELSE lower(s) END AS source, CASE WHEN t = 'FR' THEN 'fr' ELSE 'th-TH' END AS target, CASE WHEN y = 'นิยาย' THEN 'novel' ELSE lower(trim(y)) END AS style, lower(p) AS provider FROM x)
SELECT *, concat_ws(',', CASE WHEN source IS NULL THEN 'source_language' END, CASE WHEN source = target THEN 'same_language' END, CASE WHEN style = 'odd' THEN 'style' END, CASE WHEN provider = 'other' THEN 'provider' END) AS errors FROM n""",
)
def settings(spark, d):
    k = F.col("doc_id")
    s = T.settings_checked(F.when(k % 3 == 0, "auto").when(k % 3 == 1, F.col("lang")).otherwise("no_language"), F.when(k % 4 == 0, "FR").otherwise("th-th"), F.when(k % 5 == 0, "นิยาย").when(k % 5 == 1, " General ").when(k % 5 == 2, "odd").otherwise("official"), F.when(k % 7 == 0, "other").otherwise("Local"), F.lit("preserve"))
    return I.table(spark, d, "documents").select("doc_id", s.alias("s")).select("doc_id", "s.source", "s.target", "s.style", "s.provider", F.array_join("s.errors", ",").alias("errors"))


@query("P29_metadata", "SELECT doc_id, substr(regexp_replace(regexp_replace(text, '[\\x00-\\x1F\\x7F]', '', 'g'), '^[\\s\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+|[\\s\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+$', '', 'g'), 1, 50) AS title, CASE WHEN doc_id % 3 = 0 THEN '2024' WHEN doc_id % 3 = 1 THEN '2024-02-30' ELSE '2024-05-06' END AS d0, CASE WHEN doc_id % 3 = 1 THEN NULL WHEN doc_id % 3 = 0 THEN '2024' ELSE '2024-05-06' END AS date FROM documents")
def metadata(spark, d):
    k = F.col("doc_id")
    when = F.when(k % 3 == 0, "2024").when(k % 3 == 1, "2024-02-30").otherwise("2024-05-06")
    return I.table(spark, d, "documents").select("doc_id", T.clean_metadata(F.col("text"), 50).alias("title"), when.alias("d0"), T.iso_date(when).alias("date"))


@query("P32_json_in_answers", "SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE props END AS found FROM events")
def noisy(spark, d):
    k = F.col("event_id") % 4
    a = F.when(k == 0, F.concat(F.lit("Here:\n```json\n"), "props", F.lit("\n```\nDone {x"))).when(k == 1, F.concat(F.lit("so "), "props", F.lit(" ok"))).when(k == 2, F.col("props")).otherwise("none {")
    return I.table(spark, d, "events").select("event_id", T.json_object(a).alias("found"))


@query("A10_line_confidence", f"WITH {I.WORDS} SELECT page_id, line_index, round_even(avg(CASE WHEN word_index % 5 < 4 THEN (word_index % 8) / 8.0::DOUBLE END), 4) AS confidence FROM wd GROUP BY ALL")
def confidence(spark, d):
    k = F.col("word_index")
    return layout.confidences(I.words(spark, d).withColumn("confidence", F.when(k % 5 < 4, (k % 8) / 8.0)))


@query("A11_unresolved_counts", "SELECT l_orderkey AS page_id, count(*) FILTER (l_linenumber % 3 = 0 OR l_suppkey % 4 = 0) AS unresolved FROM lineitem GROUP BY l_orderkey")
def unresolved(spark, d):
    c = I.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("page_id"), (F.col("l_linenumber") % 3 == 0).alias("unresolved"), F.when(F.col("l_suppkey") % 4 == 0, "a").otherwise("a").alias("text"))
    return layout.unresolved_counts(c)


@query("J15_positional_zip", "WITH a AS (SELECT o_custkey AS k, o_orderkey AS o, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT o_custkey AS k, o_orderkey AS o, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders WHERE o_orderstatus = 'O') SELECT a.k, a.o, b.o AS right_o, (a.n - 1)::INT AS position FROM a JOIN b ON a.k = b.k AND a.n = b.n")
def positional(spark, d):
    o = I.table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("o"), "o_orderstatus")
    return layout.zipped(o.where("o_orderstatus = 'F'").select("k", "o"), o.where("o_orderstatus = 'O'").select("k", "o"), "k", "o")


@query("H6_page_sections", f"WITH {I.PAGES} SELECT job_id, string_agg('<section data-page=\"' || page_id || '\">' || CASE status WHEN 'failed' THEN '<p class=\"failed\">failed</p>' WHEN 'blank' THEN '<p class=\"blank\">blank</p>' ELSE '<p>' || route || '&amp;</p><p>b</p>' END || '</section>', '' ORDER BY page_id) AS html FROM pg GROUP BY job_id")
def sections(spark, d):
    return layout.page_sections(I.pages(spark, d).withColumn("text", F.concat("route", F.lit("&\n\n b".replace(" b", "b")))))


@query("W9_grid_cells", f"""WITH {I.PAGE_IMAGES}, c AS (SELECT page_id, thick, unnest(range(nr)) AS row_index, nc FROM sz WHERE kind >= 2), g AS (SELECT page_id, thick, row_index, unnest(range(nc)) AS column_index FROM c)
SELECT page_id, row_index::INT AS row_index, column_index::INT AS column_index, round_even(10 + 20 * column_index + (thick - 1) / 2.0, 0)::BIGINT AS x0, round_even(10 + 15 * row_index + (thick - 1) / 2.0, 0)::BIGINT AS y0,
  round_even(30 + 20 * column_index + (thick - 1) / 2.0, 0)::BIGINT AS x1, round_even(25 + 15 * row_index + (thick - 1) / 2.0, 0)::BIGINT AS y1 FROM g""")
def grid(spark, d):
    """Ruled tables found in the pixels of the pages' images."""
    return layout.grid_cells(raster.rasters(I.page_images(spark, d)))


@query("V8_covers", "WITH x AS (SELECT p_partkey AS cover_id, p_partkey % 4 AS k, (p_size - 1) * 137 * (p_partkey % 9000) AS pixels, p_size % 2 = 0 AS whole FROM part) SELECT cover_id, CASE k WHEN 0 THEN 'jpeg' WHEN 1 THEN 'unsupported' WHEN 2 THEN 'png' END AS type, CASE WHEN k = 1 THEN 'type' WHEN k = 3 THEN 'encoding' WHEN k = 2 AND pixels > 16000000 THEN 'too_many_pixels' WHEN k = 2 OR NOT whole THEN 'damaged' END AS error FROM x")
def covers(spark, d):
    """Covers of which none but some JPEGs are whole: a PNG that is only a header can't be opened."""
    k = F.col("p_partkey") % 4
    side = lambda n, digits: F.lpad(F.hex(n), digits, "0")
    png = F.unhex(F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), side((F.col("p_size") - 1) * 137, 8), side(F.col("p_partkey") % 9000, 8), F.lit("0800000000")))
    jpeg = F.unhex(F.concat(F.lit("FFD8FFC0000B08"), side(F.col("p_size"), 4), side(F.col("p_partkey") % 200 + 1, 4), F.lit("01011100FFDA0008010100003F0012FF0034"), F.when(F.col("p_size") % 2 == 0, "FFD9").otherwise("")))
    content = F.when(k == 0, jpeg).when(k == 1, F.col("p_name").cast("binary")).otherwise(png)
    encoded = F.when(k == 3, "***").otherwise(F.base64(content))
    return files.checked_covers(I.table(spark, d, "part").select(F.col("p_partkey").alias("cover_id"), encoded.alias("encoded"))).select("cover_id", "type", "error")


@query("V8_clean_covers", f"WITH {I.PAGE_IMAGES} SELECT page_id AS cover_id, CASE WHEN orientation >= 5 THEN height ELSE width END AS width, CASE WHEN orientation >= 5 THEN width ELSE height END AS height, 3 AS parts, CASE kind WHEN 0 THEN 250 WHEN 1 THEN 240 ELSE 40 END AS darkest, CAST(NULL AS VARCHAR) AS error FROM sz")
def clean_covers(spark, d):
    """Pages' images as covers: encoded anew, without the orientation that they held."""
    from pagewright.sources import structure

    images = I.page_images(spark, d)
    got = files.checked_covers(images.select(F.col("page_id").alias("cover_id"), F.base64("content").alias("encoded")))
    chunks = structure.file_parts(got.select("cover_id", F.col("clean").alias("content")), "cover_id").where("at >= 0 and ok").groupBy("cover_id").agg(F.count("*").alias("parts"))
    seen = raster.rasters(got.select("cover_id", F.col("clean").alias("content")), "cover_id").select("cover_id", F.col("low").cast("long").alias("darkest"))
    return got.select("cover_id", F.col("width").cast("long").alias("width"), F.col("height").cast("long").alias("height"), "error").join(chunks, "cover_id").join(seen, "cover_id")


@query("S19_uploads", f"""WITH {I.LINES}, x AS (SELECT doc_id, ln, CASE ln % 3 WHEN 0 THEN replace(line, ',', '/') WHEN 1 THEN replace(line, ' t', chr(92) || 't') ELSE line END || CASE doc_id % 5 WHEN 0 THEN '.pdf' WHEN 1 THEN '.PNG' WHEN 2 THEN '.exe' WHEN 3 THEN '' ELSE '.j:peg' END AS name, length(line) * 1000000 AS size FROM ln),
b AS (SELECT *, split_part(replace(name, chr(92), '/'), '/', -1) AS base FROM x), e AS (SELECT *, lower(regexp_extract(base, '\\.([A-Za-z0-9]+)$', 1)) AS ext FROM b)
SELECT doc_id, ln, right(regexp_replace(base, '[^\\p{{L}}\\p{{M}}\\p{{N}}._ -]', '_', 'g'), 120) AS safe_name, CASE WHEN trim(base) = '' THEN 'name' WHEN ext NOT IN ('pdf', 'png', 'jpg', 'jpeg') THEN 'extension' WHEN size > 314572800 THEN 'too_large' WHEN size <= 0 THEN 'empty' END AS error FROM e""")
def uploads(spark, d):
    k, n = F.col("doc_id") % 5, F.col("ln") % 3
    name = F.concat(F.when(n == 0, F.replace("line", F.lit(","), F.lit("/"))).when(n == 1, F.replace("line", F.lit(" t"), F.lit("\\t"))).otherwise(F.col("line")), F.when(k == 0, ".pdf").when(k == 1, ".PNG").when(k == 2, ".exe").when(k == 3, "").otherwise(".j:peg"))
    rows = I.lines(spark, d).select("doc_id", "ln", name.alias("name"), (F.length("line").cast("long") * 1_000_000).alias("size_bytes"))
    return files.accepted_uploads(rows).select("doc_id", "ln", "safe_name", "error")


@query("O6_caps", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(*) <= 5) GROUP BY ALL")
def caps(spark, d):
    kept, _ = files.capped(I.table(spark, d, "lineitem"), "l_orderkey", 5)
    return kept.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))


@query("O2_O3_O4_orders", f"WITH {I.BOXES} SELECT page_id, line_index, (row_number() OVER (PARTITION BY page_id ORDER BY y0, x0, line_index) - 1)::INT AS position, (row_number() OVER (PARTITION BY page_id ORDER BY line_index DESC) - 1)::INT AS right_to_left FROM bx")
def orders(spark, d):
    from pagewright.operators import assemble, correct

    b = assemble.blocks_in_order(I.boxes(spark, d))
    return correct.right_to_left(b.withColumn("doc_id", F.col("page_id")).withColumn("start", F.col("line_index"))).select("page_id", "line_index", "position", F.col("turn").alias("right_to_left"))
