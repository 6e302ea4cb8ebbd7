"""Queries of geometry, assembly, layout and HTML operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewright.operators import assemble, geometry, html, layout, package, toc

from . import inputs as I

QUERIES: dict = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = (fn, sql)
        return fn

    return add


_BLOCKED = I.BOXES + """,
b0 AS (SELECT *, CASE WHEN y0 - lag(y1) OVER (PARTITION BY page_id ORDER BY line_index) > 1.5 * greatest(1.0, y1 - y0) THEN 1 ELSE 0 END AS new FROM bx),
bl AS (SELECT *, (sum(new) OVER (PARTITION BY page_id ORDER BY line_index))::INT AS block FROM b0)"""


@query("W1_lines_to_blocks", f"WITH {_BLOCKED} SELECT page_id, line_index, block, row_number() OVER (PARTITION BY page_id, block ORDER BY line_index) - 1 AS line_in_block FROM bl")
def blocks(spark, d):
    return assemble.lines_to_blocks(I.boxes(spark, d)).select("page_id", "line_index", "block", "line_in_block")


@query("A12_A14_block_boxes", f"WITH {_BLOCKED} SELECT page_id, block, count(*) AS n_lines, string_agg(text, chr(10) ORDER BY line_index) AS text, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM bl GROUP BY page_id, block")
def block_boxes(spark, d):
    return assemble.block_boxes(assemble.lines_to_blocks(I.boxes(spark, d)))


_T = "regexp_replace(text, '^\\s+|\\s+$', '', 'g')"
_SPANS = f"""{_BLOCKED},
t0 AS (SELECT page_id, block, line_in_block, CASE WHEN line_in_block % 5 = 0 AND block % 2 = 1 THEN '' ELSE {_T} END AS t FROM (SELECT *, row_number() OVER (PARTITION BY page_id, block ORDER BY line_index) - 1 AS line_in_block FROM bl)),
t1 AS (SELECT *, CASE WHEN t <> '' AND line_in_block > 0 THEN 1 ELSE 0 END AS b, dense_rank() OVER (PARTITION BY page_id ORDER BY block) - 1 AS k FROM t0),
t2 AS (SELECT *, coalesce(sum(b + length(t)) OVER (PARTITION BY page_id ORDER BY block, line_in_block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + b + 2 * k AS s FROM t1)"""


def span_input(spark, d):
    b = assemble.lines_to_blocks(I.boxes(spark, d))
    return b.select("page_id", "block", "line_in_block", F.when((F.col("line_in_block") % 5 == 0) & (F.col("block") % 2 == 1), "").otherwise(F.col("text")).alias("text"))


@query("W2_char_spans", f'WITH {_SPANS} SELECT page_id, block, line_in_block, s::BIGINT AS "start", (s + length(t))::BIGINT AS "end", t AS text FROM t2 WHERE t <> \'\'')
def char_spans(spark, d):
    return assemble.char_spans(span_input(spark, d))


@query("A12_page_text", f"WITH {_SPANS}, p AS (SELECT page_id, block, string_agg(CASE WHEN t = '' THEN '' WHEN line_in_block > 0 THEN chr(10) || t ELSE t END, '' ORDER BY line_in_block) AS t FROM t1 GROUP BY page_id, block) SELECT page_id, string_agg(t, chr(10) || chr(10) ORDER BY block) AS text FROM p GROUP BY page_id")
def page_text(spark, d):
    return assemble.page_text(span_input(spark, d))


@query(
    "W3_W4_reading_order",
    f"""WITH {I.BOXES}, c AS (SELECT *, CASE WHEN page_id % 2 = 0 AND line_index % 2 = 1 THEN 300 ELSE 0 END + (line_index % 2) * 10.0::DOUBLE AS a FROM bx), m0 AS (SELECT page_id, line_index AS ord, a AS x0, a + 100 + CASE WHEN line_index % 9 = 8 THEN 120 ELSE 0 END AS x1, y0 FROM c),
m AS (SELECT *, (min(x0) OVER p + max(x1) OVER p) / 2 AS mid FROM m0 WINDOW p AS (PARTITION BY page_id)), s AS (SELECT *, CASE WHEN x1 <= mid THEN 0 WHEN x0 >= mid THEN 1 ELSE 2 END AS side FROM m),
w AS (SELECT *, (sum((side = 0)::INT) OVER p + sum((side = 1)::INT) OVER p >= 0.85 * count(*) OVER p) AND sum((side = 0)::INT) OVER p >= 2 AND sum((side = 1)::INT) OVER p >= 2 AS two FROM s WINDOW p AS (PARTITION BY page_id))
SELECT page_id, ord, row_number() OVER (PARTITION BY page_id ORDER BY CASE WHEN two THEN side ELSE 0 END, CASE WHEN two THEN y0 ELSE round_even(y0 / 15, 0) END, x0, ord) - 1 AS position FROM w""",
)
def reading(spark, d):
    i = F.col("line_index")
    a = F.when((F.col("page_id") % 2 == 0) & (i % 2 == 1), 300).otherwise(0) + (i % 2) * 10.0
    b = I.boxes(spark, d).select("page_id", i.alias("ord"), a.alias("x0"), (a + 100 + F.when(i % 9 == 8, 120).otherwise(0)).alias("x1"), "y0", "y1")
    return assemble.reading_order(b).select("page_id", "ord", "position")


@query(
    "W5_tabbed_lines",
    f"""WITH {I.WORDS}, c AS (SELECT *, CASE WHEN x0 - lag(x1) OVER w > 30 THEN 1 ELSE 0 END AS cut FROM wd WINDOW w AS (PARTITION BY page_id, line_index ORDER BY x0, word_index)),
p AS (SELECT *, sum(cut) OVER (PARTITION BY page_id, line_index ORDER BY x0, word_index) AS part FROM c), g AS (SELECT page_id, line_index, part, string_agg(text, ' ' ORDER BY word_index) AS t FROM p GROUP BY ALL)
SELECT page_id, line_index, count(*) AS parts, string_agg(t, chr(9) ORDER BY part) AS text FROM g GROUP BY ALL""",
)
def tabbed(spark, d):
    return assemble.tabbed_lines(I.words(spark, d))


@query("A3_body_size", f"WITH {I.STYLED}, e AS (SELECT page_id, size, unnest(range(length(text))) FROM st WHERE size > 0 AND trim(text) <> ''), m AS (SELECT page_id, round_even(median(size), 2) AS b FROM e GROUP BY page_id) SELECT p.page_id, coalesce(m.b, 14.0) AS body FROM (SELECT DISTINCT page_id FROM st) p LEFT JOIN m USING (page_id)")
def body(spark, d):
    return assemble.body_size(I.styled(spark, d))


@query("A4_S7_line_style", f"WITH {I.WORDS}, s AS (SELECT *, 10.0 + word_index % 4 AS size, (word_index % 3) * 8 AS flags, CASE word_index % 5 WHEN 0 THEN 'Bold' WHEN 1 THEN 'Oblique' ELSE 'Roman' END AS font FROM wd) SELECT page_id, line_index, max(size) AS size_max, round_even(sum(CASE WHEN flags & 16 <> 0 OR font = 'Bold' THEN length(text) ELSE 0 END) / greatest(sum(length(text)), 1), 4) AS bold_ratio, round_even(sum(CASE WHEN flags & 2 <> 0 OR font = 'Oblique' THEN length(text) ELSE 0 END) / greatest(sum(length(text)), 1), 4) AS italic_ratio FROM s GROUP BY ALL")
def style(spark, d):
    k = F.col("word_index")
    s = I.words(spark, d).withColumn("size", 10.0 + k % 4).withColumn("flags", (k % 3) * 8).withColumn("font", F.when(k % 5 == 0, "Bold").when(k % 5 == 1, "Oblique").otherwise("Roman")).withColumn("ord", k)
    return assemble.line_style(s).select("page_id", "line_index", "size_max", "bold_ratio", "italic_ratio")


@query("A4_block_style", f"""WITH {I.WORDS}, s AS (SELECT *, 10.0 + word_index % 4 AS size, (word_index % 3) * 8 AS flags, CASE word_index % 5 WHEN 0 THEN 'Bold' WHEN 1 THEN 'Oblique' ELSE 'Roman' END AS font FROM wd),
l AS (SELECT page_id, line_index // 5 AS block, line_index, max(size) AS size_max, round_even(sum(CASE WHEN flags & 16 <> 0 OR font = 'Bold' THEN length(text) ELSE 0 END) / greatest(sum(length(text)), 1), 4) AS bold_ratio, round_even(sum(CASE WHEN flags & 2 <> 0 OR font = 'Oblique' THEN length(text) ELSE 0 END) / greatest(sum(length(text)), 1), 4) AS italic_ratio FROM s GROUP BY ALL)
SELECT page_id, block, max(size_max)::DOUBLE AS size_max, round_even(sum(round(bold_ratio * 10000)::BIGINT)::DOUBLE / (count(*) * 100), 0) / 100 AS bold_ratio, round_even(sum(round(italic_ratio * 10000)::BIGINT)::DOUBLE / (count(*) * 100), 0) / 100 AS italic_ratio FROM l GROUP BY ALL""")
def blocks_style(spark, d):
    k = F.col("word_index")
    s = I.words(spark, d).withColumn("size", 10.0 + k % 4).withColumn("flags", (k % 3) * 8).withColumn("font", F.when(k % 5 == 0, "Bold").when(k % 5 == 1, "Oblique").otherwise("Roman")).withColumn("ord", k)
    lines = assemble.line_style(s).withColumn("block", F.floor(F.col("line_index") / 5))
    return assemble.block_style(lines).select("page_id", "block", "size_max", "bold_ratio", "italic_ratio")


@query("S6_native_lines", f"WITH {_BLOCKED}, k AS (SELECT page_id, block, string_agg(text, chr(10) ORDER BY line_index) AS text, min(y0) AS y0, max(y1) AS y1 FROM bl GROUP BY ALL), l AS (SELECT page_id, block, y0, y1, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS a FROM k), u AS (SELECT page_id, block, y0, y1, len(a) AS n, unnest(a) AS text, generate_subscripts(a, 1) - 1 AS i FROM l) SELECT page_id, block AS block_id, i AS line_index, text, round_even(y0 * (144 / 72.0::DOUBLE) + i * ((y1 - y0) * (144 / 72.0::DOUBLE) / n), 2) AS y0 FROM u")
def native(spark, d):
    b = assemble.block_boxes(assemble.lines_to_blocks(I.boxes(spark, d))).withColumnRenamed("block", "block_id")
    return assemble.native_lines(b, 144).select("page_id", "block_id", "line_index", "text", "y0")


@query("S13_job_text", f"WITH {I.PAGES} SELECT job_id, string_agg(CASE status WHEN 'failed' THEN '[Page ' || page_id || ' FAILED]' ELSE route || page_id END, chr(10) || chr(12) || chr(10) ORDER BY page_id) AS text FROM pg GROUP BY job_id")
def job_text(spark, d):
    return assemble.job_text(I.pages(spark, d).withColumn("final_text", F.concat("route", F.col("page_id").cast("string"))).withColumn("raw_text", F.lit("")))


@query("S16_text_to_html", """WITH x AS (SELECT doc_id, replace(replace(text, '.' || chr(10), '.' || chr(13) || chr(10) || chr(10)), ' und ', chr(12)) AS t FROM documents)
SELECT doc_id, '<!doctype html><html><head><meta charset="utf-8"></head><body>' || array_to_string(list_transform(string_split(t, chr(12)), lambda p, i: '<section data-page="' || i || '">' || array_to_string(list_transform(string_split_regex(p, '(\\r?\\n){2,}'),
  lambda b, j: CASE WHEN regexp_full_match(b, '\\s*') THEN '' ELSE '<p data-block-id="text-p' || i || '-' || j || '" data-page="' || i || '">' || replace(replace(replace(replace(replace(regexp_replace(b, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#x27;') || '</p>' END), '') || '</section>'), '') || '</body></html>' AS html FROM x""")
def to_html(spark, d):
    text = F.replace(F.replace("text", F.lit(".\n"), F.lit(".\r\n\n")), F.lit(" und "), F.lit("\f"))
    return html.text_to_html(I.table(spark, d, "documents").select("doc_id", text.alias("text")))


# ---- geometry


@query("P16_P17_iou", f"WITH {I.BOXES}, p AS (SELECT a.page_id, a.line_index, a.x0, a.y0, a.x1, a.y1, a.x0 + (a.line_index % 7) * 15 AS u0, a.y0 + 3 AS v0, a.x1 + 20 AS u1, a.y1 + 4 AS v1 FROM bx a) SELECT page_id, line_index, CASE WHEN x0 < u1 AND x1 > u0 AND y0 < v1 AND y1 > v0 THEN (least(x1, u1) - greatest(x0, u0)) * (least(y1, v1) - greatest(y0, v0)) / ((x1 - x0) * (y1 - y0) + greatest(0, u1 - u0) * greatest(0, v1 - v0) - (least(x1, u1) - greatest(x0, u0)) * (least(y1, v1) - greatest(y0, v0))) ELSE 0 END AS iou FROM p")
def iou(spark, d):
    b = I.boxes(spark, d)
    a = F.struct("x0", "y0", "x1", "y1")
    c = F.struct((F.col("x0") + (F.col("line_index") % 7) * 15).alias("x0"), (F.col("y0") + 3).alias("y0"), (F.col("x1") + 20).alias("x1"), (F.col("y1") + 4).alias("y1"))
    return b.select("page_id", "line_index", geometry.iou(a, c).alias("iou"))


@query("P16_affine_round_trip")
def affine(spark, d):
    m = geometry.rotation((F.col("line_index") % 36) * 10.0, F.lit(50.0), F.lit(70.0))
    there = geometry.applied(m, F.col("x0"), F.col("y0"))
    back = geometry.applied(geometry.inverse(m), there["x"], there["y"])
    return I.boxes(spark, d).select("page_id", "line_index", (F.abs(back["x"] - F.col("x0")) + F.abs(back["y"] - F.col("y0")) < 1e-6).alias("same"))


_CELLS = "cl AS (SELECT DISTINCT page_id, line_index // 3 AS cell_id, (line_index // 3) % 2 * 200.0::DOUBLE AS x0, (line_index // 3) * 60.0::DOUBLE AS y0, (line_index // 3) % 2 * 200.0::DOUBLE + 240 AS x1, (line_index // 3) * 60.0::DOUBLE + 80 AS y1 FROM bx)"


def cells(spark, d):
    k = F.floor(F.col("line_index") / 3)
    return I.boxes(spark, d).select("page_id", k.alias("cell_id"), (k % 2 * 200.0).alias("x0"), (k * 60.0).alias("y0"), (k % 2 * 200.0 + 240).alias("x1"), (k * 60.0 + 80).alias("y1")).distinct()


@query("J3_lines_in_cells", f"WITH {I.BOXES}, {_CELLS} SELECT c.page_id, c.cell_id, coalesce(string_agg(l.text, chr(10) ORDER BY l.line_index), '') AS text FROM cl c LEFT JOIN bx l ON l.page_id = c.page_id AND (l.x0 + l.x1) / 2 BETWEEN c.x0 AND c.x1 AND (l.y0 + l.y1) / 2 BETWEEN c.y0 AND c.y1 GROUP BY ALL")
def in_cells(spark, d):
    return geometry.lines_in_cells(I.boxes(spark, d).withColumn("confidence", F.lit(1.0)), cells(spark, d)).select("page_id", "cell_id", "text")


@query("J4_outside_tables", f"WITH {I.BOXES}, {_CELLS} SELECT page_id, line_index FROM bx l WHERE NOT EXISTS (SELECT 1 FROM cl c WHERE c.cell_id % 2 = 0 AND l.page_id = c.page_id AND (l.x0 + l.x1) / 2 BETWEEN c.x0 AND c.x1 AND (l.y0 + l.y1) / 2 BETWEEN c.y0 AND c.y1)")
def outside(spark, d):
    return geometry.outside_tables(I.boxes(spark, d), cells(spark, d).where("cell_id % 2 = 0")).select("page_id", "line_index")


@query("J14_nearest_boundary", f"WITH {I.BOXES}, b AS (SELECT DISTINCT page_id, line_index % 4 AS idx, (line_index % 4) * 130.0::DOUBLE AS pos FROM bx), n AS (SELECT l.page_id, l.line_index, b.idx, row_number() OVER (PARTITION BY l.page_id, l.line_index ORDER BY abs(l.x0 - b.pos), b.idx) AS r FROM bx l JOIN b ON b.page_id = l.page_id) SELECT page_id, line_index, idx AS nearest FROM n WHERE r = 1")
def nearest(spark, d):
    b = I.boxes(spark, d)
    bounds = b.select("page_id", (F.col("line_index") % 4).alias("idx"), ((F.col("line_index") % 4) * 130.0).alias("at")).distinct()
    return geometry.nearest_boundary(b.select("page_id", "line_index", "x0"), bounds, "page_id", "x0").select("page_id", "line_index", "nearest")


@query("W7_line_clusters", "WITH v AS (SELECT DISTINCT l_orderkey % 50 AS k, (l_partkey * 7 % 500)::BIGINT AS v FROM lineitem), n AS (SELECT *, CASE WHEN v - lag(v) OVER (PARTITION BY k ORDER BY v) > 4 THEN 1 ELSE 0 END AS new FROM v), c AS (SELECT *, (sum(new) OVER (PARTITION BY k ORDER BY v))::BIGINT AS cluster FROM n) SELECT k, cluster, round_even(avg(v), 0)::BIGINT AS centre FROM c GROUP BY ALL")
def clusters(spark, d):
    v = I.table(spark, d, "lineitem").select((F.col("l_orderkey") % 50).alias("k"), (F.col("l_partkey") * 7 % 500).alias("v")).distinct()
    return geometry.line_clusters(v, "k", "v")


@query("W6_mean_clusters", """WITH RECURSIVE v AS (SELECT l_orderkey % 200 AS k, (l_extendedprice % 1000)::DOUBLE AS v, row_number() OVER (PARTITION BY l_orderkey % 200 ORDER BY l_extendedprice % 1000) AS i FROM lineitem),
f(k, i, cluster, total, n) AS (SELECT k, i, 0, v, 1 FROM v WHERE i = 1 UNION ALL SELECT f.k, v.i, CASE WHEN v.v - total / n <= 1 THEN cluster ELSE cluster + 1 END, CASE WHEN v.v - total / n <= 1 THEN total + v.v ELSE v.v END, CASE WHEN v.v - total / n <= 1 THEN n + 1 ELSE 1 END FROM f JOIN v ON v.k = f.k AND v.i = f.i + 1)
SELECT k, cluster, round_even(arg_max(total / n, i), 6) AS mean, max(n) AS n FROM f GROUP BY k, cluster""")
def means(spark, d):
    v = I.table(spark, d, "lineitem").select((F.col("l_orderkey") % 200).alias("k"), (F.col("l_extendedprice") % 1000).alias("v"))
    return geometry.mean_clusters(v, "k", "v").withColumn("mean", F.bround("mean", 6))


@query("W8_dark_runs", "WITH x AS (SELECT DISTINCT l_orderkey % 20 AS page_id, l_suppkey % 10 AS y, l_partkey % 120 AS x FROM lineitem), n AS (SELECT *, CASE WHEN x - lag(x) OVER (PARTITION BY page_id, y ORDER BY x) > 3 THEN 1 ELSE 0 END AS new FROM x), r AS (SELECT *, sum(new) OVER (PARTITION BY page_id, y ORDER BY x) AS run FROM n), l AS (SELECT page_id, y, run, max(x) - min(x) + 1 AS n FROM r GROUP BY ALL) SELECT page_id, y, max(n) AS longest FROM l GROUP BY ALL")
def dark(spark, d):
    p = I.table(spark, d, "lineitem").select((F.col("l_orderkey") % 20).alias("page_id"), (F.col("l_suppkey") % 10).alias("y"), (F.col("l_partkey") % 120).alias("x"), F.lit(True).alias("dark")).distinct()
    return geometry.dark_runs(p)


# ---- layout

_KIND = "CASE WHEN NOT regexp_matches(text, '^\\s*(?:([-*•▪◦])|(\\d{1,3})[.)])\\s+(.+)$') THEN 'paragraph' WHEN regexp_matches(text, '^\\s*\\d') THEN 'ordered' ELSE 'unordered' END"


@query("W10_list_blocks", f"WITH {I.STYLED}, k AS (SELECT *, {_KIND} AS kind FROM st), n AS (SELECT *, (kind = 'paragraph' OR coalesce(lag(kind) OVER (PARTITION BY page_id ORDER BY ord) <> kind, true))::INT AS new FROM k) SELECT page_id, ord, kind, (sum(new) OVER (PARTITION BY page_id ORDER BY ord) - 1)::BIGINT AS island FROM n")
def lists(spark, d):
    return layout.list_blocks(I.styled(spark, d)).select("page_id", "ord", "kind", F.col("island").cast("long").alias("island"))


@query("W11_layout_headings", f"WITH {I.STYLED}, b AS (SELECT page_id, median(size) AS body FROM st WHERE size > 0 AND trim(text) <> '' GROUP BY page_id), h AS (SELECT st.*, coalesce(body > 0 AND length(text) <= 100 AND size >= body * 1.2::DOUBLE AND (bold >= 0.6::DOUBLE OR size >= body * 1.35::DOUBLE), false) AS h FROM st LEFT JOIN b USING (page_id)) SELECT page_id, ord, CASE WHEN NOT h THEN 'paragraph' WHEN sum(h::INT) OVER (PARTITION BY page_id ORDER BY ord) = 1 THEN 'h1' ELSE 'h2' END AS kind FROM h")
def layout_headings(spark, d):
    return layout.layout_headings(I.styled(spark, d)).select("page_id", "ord", "kind")


_TABS = "tb AS (SELECT page_id, ord, CASE WHEN ord % 5 IN (1, 2, 4) THEN replace(text, ' ', chr(9)) ELSE text END AS text FROM st)"


@query("W12_A9_tab_tables", f"WITH {I.STYLED}, {_TABS}, o AS (SELECT *, contains(text, chr(9)) AS tab, sum((NOT contains(text, chr(9)))::INT) OVER (PARTITION BY page_id ORDER BY ord) AS k FROM tb), n AS (SELECT *, count(*) OVER (PARTITION BY page_id, k) AS n FROM o WHERE tab), r AS (SELECT *, string_split(text, chr(9)) AS c, row_number() OVER (PARTITION BY page_id, k ORDER BY ord) - 1 AS row_index, dense_rank() OVER (PARTITION BY page_id ORDER BY k) - 1 AS tbl FROM n WHERE n >= 2), w AS (SELECT *, max(len(c)) OVER (PARTITION BY page_id, k) AS width FROM r), e AS (SELECT page_id, tbl, row_index, c, unnest(range(width)) AS column_index FROM w) SELECT page_id, tbl AS \"table\", row_index, column_index, coalesce(c[column_index + 1], '') AS text FROM e")
def tab_tables(spark, d):
    s = I.styled(spark, d)
    return layout.tab_tables(s.withColumn("text", F.when((F.col("ord") % 5).isin(1, 2, 4), F.replace("text", F.lit(" "), F.lit("\t"))).otherwise(F.col("text"))))


@query("W13_uncovered_cells", "WITH c AS (SELECT DISTINCT l_orderkey % 100 AS page_id, l_linenumber % 4 AS r, l_suppkey % 4 AS c, 1 + l_partkey % 2 AS rs, 1 + l_partkey % 3 AS cs FROM lineitem), v AS (SELECT page_id, r, c, cs, unnest(generate_series(r, r + rs - 1)) AS rr FROM c), k AS (SELECT page_id, rr, unnest(generate_series(c, c + cs - 1)) AS cc FROM v), g AS (SELECT page_id, r, c FROM (SELECT DISTINCT page_id FROM c), range(5) a(r), range(6) b(c)) SELECT g.page_id, g.r AS row_index, g.c AS column_index FROM g WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.page_id = g.page_id AND k.rr = g.r AND k.cc = g.c)")
def uncovered(spark, d):
    c = I.table(spark, d, "lineitem").select((F.col("l_orderkey") % 100).alias("page_id"), F.lit(0).alias("table"), (F.col("l_linenumber") % 4).alias("row_index"), (F.col("l_suppkey") % 4).alias("column_index"), (1 + F.col("l_partkey") % 2).alias("rowspan"), (1 + F.col("l_partkey") % 3).alias("colspan")).distinct()
    g = c.select("page_id", "table").distinct().withColumn("n_rows", F.lit(5)).withColumn("n_cols", F.lit(6))
    return layout.uncovered(c, g).select("page_id", F.col("row_index").cast("long").alias("row_index"), F.col("column_index").cast("long").alias("column_index"))


@query("H5_structured_text", f"WITH {I.STYLED}, k AS (SELECT *, {_KIND} AS kind FROM st) SELECT page_id, string_agg(CASE kind WHEN 'unordered' THEN '- ' || regexp_extract(text, '^\\s*(?:([-*•▪◦])|(\\d{{1,3}})[.)])\\s+(.+)$', 3) WHEN 'ordered' THEN regexp_extract(text, '(\\d+)', 1)::INT || '. ' || regexp_extract(text, '^\\s*(?:([-*•▪◦])|(\\d{{1,3}})[.)])\\s+(.+)$', 3) ELSE text END, chr(10) ORDER BY ord) AS text FROM k GROUP BY page_id")
def structured(spark, d):
    from pagewright.functions.text import list_marker

    b = layout.list_blocks(I.styled(spark, d)).withColumn("number", list_marker(F.col("text"))["number"])
    return layout.structured_text(b)


_LEVELS = "lv AS (SELECT doc_id, ln // 10 AS page_id, ln AS ord, CASE (doc_id + ln * 3) % 7 WHEN 0 THEN 'h1' WHEN 1 THEN 'h3' WHEN 2 THEN 'h2' END AS level FROM ln)"


def levels(spark, d):
    k = (F.col("doc_id") + F.col("ln") * 3) % 7
    return I.lines(spark, d).select("doc_id", F.floor(F.col("ln") / 10).alias("page_id"), F.col("ln").alias("ord"), F.when(k == 0, "h1").when(k == 1, "h3").when(k == 2, "h2").alias("level"), F.col("line").alias("text"))


@query("W21_heading_tags", f"WITH {I.LINES}, {_LEVELS}, a AS (SELECT *, CASE WHEN level IS NULL THEN 'p' WHEN level = 'h1' THEN CASE WHEN sum((level = 'h1')::INT) OVER (PARTITION BY doc_id ORDER BY page_id, ord) = 1 THEN 'h1' ELSE 'h2' END ELSE level END AS t FROM lv) SELECT doc_id, ord, CASE WHEN t = 'h3' AND coalesce(max((t = 'h2')::INT) OVER (PARTITION BY doc_id, page_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 THEN 'h2' ELSE t END AS tag FROM a")
def tags(spark, d):
    return layout.heading_tags(levels(spark, d)).select("doc_id", "ord", "tag")


_HEADS = _LEVELS + ", hd AS (SELECT doc_id, ord, substr(level, 2)::INT AS level FROM lv WHERE level IS NOT NULL)"


def heads(spark, d):
    return levels(spark, d).where("level is not null").select("doc_id", "ord", F.substring("level", 2, 1).cast("int").alias("level"))


@query("W22_V5_hierarchy_errors", f"WITH {I.LINES}, {_HEADS}, e AS (SELECT *, CASE WHEN level = 1 AND sum((level = 1)::INT) OVER w > 1 THEN 'second_h1' WHEN level > coalesce(lag(level) OVER w, 0) + 1 THEN 'level_jump' END AS error FROM hd WINDOW w AS (PARTITION BY doc_id ORDER BY ord)) SELECT doc_id, ord, level, error FROM e WHERE error IS NOT NULL")
def hierarchy(spark, d):
    return layout.hierarchy_errors(heads(spark, d))


@query("W24_chapters", f"WITH {I.LINES}, {_LEVELS}, b AS (SELECT lv.doc_id, lv.ord, CASE WHEN lv.doc_id % 3 = 0 THEN coalesce(nullif(level, 'h1'), 'p') ELSE coalesce(level, 'p') END AS tag, page_id AS page, line AS text FROM lv JOIN ln ON ln.doc_id = lv.doc_id AND ln.ln = lv.ord), a AS (SELECT *, max((tag = 'h1')::INT) OVER (PARTITION BY doc_id) = 1 AS anyh FROM b), c AS (SELECT *, coalesce(CASE WHEN anyh THEN tag = 'h1' ELSE page <> lag(page) OVER (PARTITION BY doc_id ORDER BY ord) END, false)::INT AS cut FROM a), s AS (SELECT *, sum(cut) OVER (PARTITION BY doc_id ORDER BY ord) AS k FROM c), r AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS chapter FROM s) SELECT doc_id, chapter, substr(coalesce(arg_min(text, ord) FILTER (tag IN ('h1', 'h2', 'h3')), 'หน้า ' || arg_min(page, ord)), 1, 200) AS title, count(*) AS n_blocks FROM r GROUP BY ALL")
def chapters(spark, d):
    b = levels(spark, d).withColumn("tag", F.when(F.col("doc_id") % 3 == 0, F.coalesce(F.nullif("level", F.lit("h1")), F.lit("p"))).otherwise(F.coalesce("level", F.lit("p"))))
    return layout.chapters(b.withColumnRenamed("page_id", "page")).select("doc_id", F.col("chapter").cast("long").alias("chapter"), "title", "n_blocks")


@query("W25_toc_parents", f"WITH {I.LINES}, {_HEADS}, w AS (SELECT *, max(ord) FILTER (level = 1) OVER u AS a, max(ord) FILTER (level = 2) OVER u AS b FROM hd WINDOW u AS (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT doc_id, ord, level, CASE level WHEN 2 THEN a WHEN 3 THEN greatest(a, b) END AS parent FROM w")
def parents(spark, d):
    return layout.toc_levels(heads(spark, d)).select("doc_id", "ord", "level", "parent")


@query("W23_heading_ids", f"WITH {I.LINES}, {_LEVELS}, b AS (SELECT lv.doc_id, lv.ord, coalesce(level, 'p') AS tag, page_id, line AS text, CASE WHEN ord % 4 = 0 THEN 's' || ord WHEN ord % 4 = 1 THEN '9bad' END AS source_id FROM lv JOIN ln ON ln.doc_id = lv.doc_id AND ln.ln = lv.ord), s AS (SELECT *, substr(sha256(tag || '|' || text || '|' || page_id), 1, 12) AS sig FROM b), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, sig ORDER BY ord) AS k FROM s) SELECT doc_id, ord, CASE WHEN regexp_matches(source_id, '^[A-Za-z][A-Za-z0-9_.:-]*$') THEN source_id ELSE 'h-' || sig || CASE WHEN k > 1 THEN '-' || k ELSE '' END END AS id FROM n")
def ids(spark, d):
    b = levels(spark, d).withColumn("tag", F.coalesce("level", F.lit("p"))).withColumnRenamed("page_id", "page")
    b = b.withColumn("source_id", F.when(F.col("ord") % 4 == 0, F.concat(F.lit("s"), F.col("ord").cast("string"))).when(F.col("ord") % 4 == 1, "9bad"))
    return layout.heading_ids(b).select("doc_id", "ord", "id")


# ---- html


def raw_html(spark, d):
    return I.table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), "html")


@query("H1_sanitized_html")
def sanitized(spark, d):
    s = raw_html(spark, d).select("doc_id", html.sanitized("html").alias("html"))
    return s.select("doc_id", F.sha2("html", 256).alias("h"), (~F.lower("html").rlike("<script|onclick=|javascript:")).alias("clean"))


@query("H2_html_blocks")
def html_blocks(spark, d):
    return html.html_blocks(raw_html(spark, d))


@query("H3_W26_html_segments")
def html_segments(spark, d):
    return html.html_segments(raw_html(spark, d))


@query("V7_structure_signature")
def signature(spark, d):
    return html.structure_signature(html.html_segments(raw_html(spark, d)))


@query("H4_J13_rendered_html")
def rendered(spark, d):
    from pagewright.operators.translate import rendered as render

    tokens = html.html_segments(raw_html(spark, d))
    seg = tokens.where("kind = 'segment'").select("doc_id", "id", F.col("text").alias("source_text"), F.upper("text").alias("translated_text"), F.lit(None).cast("string").alias("final_text"))
    return render(tokens, seg).select("doc_id", F.length("html").alias("n"), F.sha2("html", 256).alias("h"))


@query("V4_package_faults", """WITH o AS (SELECT o_custkey AS doc_id, o_orderkey % 7 AS k, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
f AS (SELECT *, 'OEBPS/chapter-' || lpad(i::VARCHAR, 4, '0') || '.xhtml' AS own, 'OEBPS/chapter-' || lpad((i + 1)::VARCHAR, 4, '0') || '.xhtml' AS next FROM o)
SELECT doc_id, CASE k WHEN 0 THEN 'missing_reference: ' || next WHEN 2 THEN 'missing_fragment: ' || own || '#no' WHEN 3 THEN 'external: https://e.org/' || o_orderkey WHEN 4 THEN 'duplicate_anchors: ' || own WHEN 5 THEN 'active_content: ' || own END AS error FROM f WHERE k IN (2, 3, 4, 5) OR k = 0 AND i = n""")
def package_faults(spark, d):
    """A package of each customer, a chapter an order; some chapters aren't as they should be."""
    from pyspark.sql.window import Window

    o = I.table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("key"), (F.col("o_orderkey") % 7).alias("k"))
    o = o.withColumn("i", F.row_number().over(Window.partitionBy("doc_id").orderBy("key")))
    following = F.concat(F.lit("<a href=\"./chapter-"), F.lpad((F.col("i") + 1).cast("string"), 4, "0"), F.lit(".xhtml\">on</a>"))
    body = F.when(F.col("k") == 0, following).when(F.col("k") == 1, '<p id="x">1</p><a href="#x">1</a>').when(F.col("k") == 2, '<a href="#no">1</a>').when(F.col("k") == 3, F.concat(F.lit('<a href="https://e.org/'), F.col("key").cast("string"), F.lit('">1</a>')))
    body = body.when(F.col("k") == 4, '<b id="a">1</b><i id="a">2</i>').when(F.col("k") == 5, '<p onclick="x">1</p>').otherwise("<p>1</p>")
    made = package.packages(o.select("doc_id", (F.col("i") - 1).alias("chapter"), F.concat(F.lit("Order "), F.col("key").cast("string")).alias("title"), body.alias("body")))
    # an inner explode would first be asked for rows with errors, by all that makes them written into one another
    return package.package_errors(made, "package").select("doc_id", F.explode_outer("errors").alias("error")).where("error is not null")


@query("S17_V4_epub_packages")
def epub(spark, d):
    b = levels(spark, d).withColumn("tag", F.coalesce("level", F.lit("p"))).withColumnRenamed("page_id", "page")
    c = layout.chapters(b).select("doc_id", "chapter", "title", "body")
    made = package.packages(c).select("doc_id", F.octet_length("package").alias("n"), F.sha2("package", 256).alias("h"), "package")
    return package.package_errors(made, "package").select("doc_id", "n", "h", F.size("errors").alias("errors"))


@query("J6_J7_line_reconciliation")
def reconciled(spark, d):
    src = I.lines(spark, d).select(F.col("doc_id").alias("page_id"), F.col("ln").alias("ord"), F.col("line").alias("text"), F.concat(F.lit("b"), F.floor(F.col("ln") / 4).cast("string")).alias("block_id"))
    fin = src.where("page_id % 3 = 0 or ord % 6 <> 5").withColumn("text", F.when((F.col("page_id") % 3 != 0) & (F.col("ord") % 4 == 1), F.concat("text", F.lit("x"))).otherwise(F.col("text"))).drop("block_id")
    return html.reconciled_lines(fin, src)


# ---- tables of contents

_TOC = _HEADS + """, te AS (SELECT doc_id, 'e' || ord AS entry_id, CASE WHEN ord % 11 = 0 THEN '' ELSE 'Label' END AS label, level, CASE WHEN level > 1 THEN 'e' || lag(ord) OVER (PARTITION BY doc_id ORDER BY ord) END AS parent_id, 't' || (ord % 13) AS target_id, ord FROM hd)"""


def entries(spark, d):
    from pyspark.sql.window import Window

    before = F.lag("ord").over(Window.partitionBy("doc_id").orderBy("ord"))
    o = F.col("ord")
    return heads(spark, d).select("doc_id", F.concat(F.lit("e"), o.cast("string")).alias("entry_id"), F.when(o % 11 == 0, "").otherwise("Label").alias("label"), "level", F.when(F.col("level") > 1, F.concat(F.lit("e"), before.cast("string"))).alias("parent_id"), F.concat(F.lit("t"), (o % 13).cast("string")).alias("target_id"), "ord")


@query("V3_toc_errors", f"""WITH {I.LINES}, {_TOC}, x AS (SELECT a.*, p.level AS pl, p.ord AS po, count(*) OVER (PARTITION BY a.doc_id, a.target_id) AS nt FROM te a LEFT JOIN te p ON p.doc_id = a.doc_id AND p.entry_id = a.parent_id)
SELECT doc_id, ord, concat_ws(',', CASE WHEN label = '' THEN 'label' END, CASE WHEN level > 1 AND pl IS NULL THEN 'parent_missing' END, CASE WHEN pl <> level - 1 THEN 'parent_level' END, CASE WHEN target_id IN ('t7', 't9') THEN 'target_missing' END, CASE WHEN nt > 1 THEN 'duplicate_target' END) AS errors FROM x""")
def toc_errors(spark, d):
    e = entries(spark, d)
    targets = e.select("doc_id", "target_id").where("target_id not in ('t7', 't9')").distinct()
    return toc.toc_errors(e, targets).select("doc_id", "ord", F.array_join("errors", ",").alias("errors"))


@query("J11_toc_relinking")
def relinked(spark, d):
    e = entries(spark, d).withColumn("match_key", F.concat(F.lit("k"), (F.col("ord") % 5).cast("string")))
    t = e.where("ord % 3 <> 0").select("doc_id", F.when(F.col("ord") % 2 == 0, F.col("target_id")).otherwise(F.concat("target_id", F.lit("n"))).alias("target_id"), "match_key", "ord")
    return toc.relinked(e, t)


_RETAG = f"""WITH {I.LINES}, a AS (SELECT doc_id, ln, CASE WHEN ln = 0 THEN 'h1' WHEN doc_id % 5 = 1 AND ln = 3 THEN 'h1' WHEN doc_id % 5 = 2 AND ln = 1 THEN 'h3' WHEN doc_id % 5 = 3 AND ln = 2 THEN 'div' WHEN ln % 4 = 1 THEN 'h2' ELSE 'p' END AS tag FROM ln WHERE doc_id % 5 <> 4),
w AS (SELECT doc_id, arg_min(CASE WHEN doc_id % 5 = 1 AND ln = 3 THEN 'second_h1' WHEN doc_id % 5 = 2 AND ln = 1 THEN 'hierarchy' WHEN doc_id % 5 = 3 AND ln = 2 THEN 'tag' END, ln) FILTER ((doc_id % 5 = 1 AND ln = 3) OR (doc_id % 5 = 2 AND ln = 1) OR (doc_id % 5 = 3 AND ln = 2)) AS reason FROM a GROUP BY doc_id),
r AS (SELECT l.doc_id, l.ln AS ord, CASE WHEN w.doc_id IS NULL THEN 'no_answer' ELSE w.reason END AS reason, a.tag FROM ln l LEFT JOIN w USING (doc_id) LEFT JOIN a ON a.doc_id = l.doc_id AND a.ln = l.ln)
SELECT doc_id, ord, CASE WHEN reason IS NULL THEN 'ai' ELSE 'basic' END AS mode, reason, CASE WHEN reason IS NULL THEN tag ELSE 'p' END AS tag FROM r"""


@query("H7_retagged_units", _RETAG)
def retagged(spark, d):
    u = I.lines(spark, d).select("doc_id", F.concat(F.lit("u"), F.col("ln").cast("string")).alias("unit"), F.col("ln").alias("ord"), F.lit("p").alias("tag"))
    k, n = F.col("doc_id") % 5, F.col("ord")
    tag = F.when(n == 0, "h1").when((k == 1) & (n == 3), "h1").when((k == 2) & (n == 1), "h3").when((k == 3) & (n == 2), "div").when(n % 4 == 1, " H2").otherwise("p")
    return layout.retagged(u, u.where(k != 4).select("doc_id", "ord", "unit", tag.alias("tag"))).select("doc_id", "ord", "mode", "reason", "tag")
