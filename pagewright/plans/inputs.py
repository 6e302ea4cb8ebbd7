"""Inputs that queries derive from the driver's tables, each as a DataFrame and as a SQL CTE."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def lines(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, ln, line"""
    return table(spark, d, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("ln", "line"))


LINES = "ln AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS ln FROM documents)"


def boxes(spark: SparkSession, d: str) -> DataFrame:
    """page_id, line_index, text, x0, y0, x1, y1: lines with an invented geometry"""
    x0, y0 = (F.col("ln") % 5) * 100.0, F.col("ln") * 20.0 + 40.0 * F.floor(F.col("ln") / (3 + F.col("doc_id") % 4))
    return lines(spark, d).select(F.col("doc_id").alias("page_id"), F.col("ln").alias("line_index"), F.col("line").alias("text"), x0.alias("x0"), y0.alias("y0"), (x0 + 80.0).alias("x1"), (y0 + 10.0 + F.col("ln") % 3).alias("y1"))


BOXES = LINES + """,
bx AS (SELECT doc_id AS page_id, ln AS line_index, line AS text, (ln % 5) * 100.0::DOUBLE AS x0, ln * 20.0::DOUBLE + 40.0::DOUBLE * floor(ln / (3 + doc_id % 4)) AS y0,
  (ln % 5) * 100.0::DOUBLE + 80 AS x1, ln * 20.0::DOUBLE + 40.0::DOUBLE * floor(ln / (3 + doc_id % 4)) + 10 + ln % 3 AS y1 FROM ln)"""


def styled(spark: SparkSession, d: str) -> DataFrame:
    """page_id, ord, text, size, bold: lines with an invented style and marker"""
    size, bold = 10.0 + (F.col("doc_id") + F.col("ln")) % 5, ((F.col("doc_id") * 7 + F.col("ln")) % 10) / 10.0
    k = (F.col("doc_id") + F.col("ln")) % 6
    text = F.concat(F.when(k == 0, "- ").when(k == 1, F.concat((F.col("ln") % 90 + 1).cast("string"), F.lit(". "))).when(k == 2, "* ").otherwise(""), "line")
    return lines(spark, d).select(F.col("doc_id").alias("page_id"), F.col("ln").alias("ord"), text.alias("text"), size.alias("size"), bold.alias("bold"))


STYLED = LINES + """,
st AS (SELECT doc_id AS page_id, ln AS ord, (CASE (doc_id + ln) % 6 WHEN 0 THEN '- ' WHEN 1 THEN (ln % 90 + 1)::VARCHAR || '. ' WHEN 2 THEN '* ' ELSE '' END) || line AS text,
  (10.0 + (doc_id + ln) % 5)::DOUBLE AS size, ((doc_id * 7 + ln) % 10) / 10.0::DOUBLE AS bold FROM ln)"""


def thai(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, ln, line: lines with Thai written into them, errors included"""
    new = F.col("line")
    for old, put in THAI:
        new = F.replace(new, F.lit(old), F.lit(put))
    return lines(spark, d).select("doc_id", "ln", new.alias("line"))


#: What stands for what in the Thai lines.
THAI = (("the ", "ท างาน "), ("er ", "น ้า "), ("la ", "วันที "), ("de ", "ก าลัง​ "), ("die ", "อนุญาติ "), (" and", " บทที่ 1"))
THAI_SQL = LINES + ",\nth AS (SELECT doc_id, ln, " + "replace(" * len(THAI) + "line" + "".join(f", '{a}', '{b}')" for a, b in THAI) + " AS line FROM ln)"


def pages(spark: SparkSession, d: str) -> DataFrame:
    """job_id, page_id, status, route, ai_status, review: jobs and pages out of orders and their line items"""
    li = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("page_id")).agg(F.max("l_linestatus").alias("f"), F.max("l_returnflag").alias("r"), F.sum("l_quantity").alias("q"))
    status = F.when(F.col("f") == "O", F.when(F.col("r") == "N", "queued").otherwise("running")).when(F.col("r") == "A", "completed").when(F.col("r") == "R", "blank").otherwise("failed")
    route = F.when(F.col("q") % 3 == 0, "direct_text").when(F.col("q") % 3 == 1, "ocr_image").otherwise("hybrid")
    return li.select("job_id", "page_id", status.alias("status"), route.alias("route"), F.when(F.col("q") % 2 == 0, "completed").otherwise("none").alias("ai_status"))


PAGES = """pg0 AS (SELECT l_orderkey AS job_id, l_linenumber AS page_id, max(l_linestatus) AS f, max(l_returnflag) AS r, sum(l_quantity) AS q FROM lineitem GROUP BY ALL),
pg AS (SELECT job_id, page_id, CASE WHEN f = 'O' THEN CASE WHEN r = 'N' THEN 'queued' ELSE 'running' END WHEN r = 'A' THEN 'completed' WHEN r = 'R' THEN 'blank' ELSE 'failed' END AS status,
  CASE q % 3 WHEN 0 THEN 'direct_text' WHEN 1 THEN 'ocr_image' ELSE 'hybrid' END AS route, CASE WHEN q % 2 = 0 THEN 'completed' ELSE 'none' END AS ai_status FROM pg0)"""


def jobs(spark: SparkSession, d: str) -> DataFrame:
    """job_id, status, created_at, updated_at (text) of orders"""
    s = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "queued").otherwise("running")
    day = F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"), s.alias("status"), day.alias("created_at"), F.when(F.col("o_orderkey") % 50 == 0, "soon").otherwise(day).alias("updated_at"))


JOBS = """jb AS (SELECT o_orderkey AS job_id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'queued' ELSE 'running' END AS status, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS created_at,
  CASE WHEN o_orderkey % 50 = 0 THEN 'soon' ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS updated_at FROM orders)"""


def words(spark: SparkSession, d: str) -> DataFrame:
    """page_id, line_index, word_index, text, x0, x1: the words of each line, some far apart"""
    w = lines(spark, d).select(F.col("doc_id").alias("page_id"), F.col("ln").alias("line_index"), F.posexplode(F.split("line", " ", -1)).alias("word_index", "text"))
    x0 = F.col("word_index") * 60.0
    return w.select("*", x0.alias("x0"), (x0 + F.when(F.col("word_index") % 4 == 3, 20.0).otherwise(50.0)).alias("x1"))


WORDS = LINES + """,
wd AS (SELECT page_id, line_index, word_index, text, word_index * 60.0::DOUBLE AS x0, word_index * 60.0::DOUBLE + CASE WHEN word_index % 4 = 3 THEN 20 ELSE 50 END AS x1
  FROM (SELECT doc_id AS page_id, ln AS line_index, unnest(string_split(line, ' ')) AS text, generate_subscripts(string_split(line, ' '), 1) - 1 AS word_index FROM ln))"""


def spans(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, ord, block_id, line_index, start, end: where each line is in its document"""
    from pyspark.sql.window import Window

    own = Window.partitionBy("doc_id").orderBy("ln").rowsBetween(Window.unboundedPreceding, -1)
    n = lines(spark, d).select("doc_id", "ln", F.length("line").alias("n"))  # lengths alone are sorted
    start = F.coalesce(F.sum(F.col("n") + 1).over(own), F.lit(0))
    return n.select("doc_id", F.col("ln").alias("ord"), F.concat(F.lit("b"), F.floor(F.col("ln") / 4).cast("string")).alias("block_id"), (F.col("ln") % 4).alias("line_index"), start.alias("start"), (start + F.col("n")).alias("end"))


SPANS = LINES + """,
sp AS (SELECT doc_id, ln AS ord, 'b' || (ln // 4) AS block_id, ln % 4 AS line_index, s AS "start", s + length(line) AS "end"
  FROM (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY ln ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s FROM ln))"""


def proposals(spark: SparkSession, d: str) -> DataFrame:
    """Proposals on the third word of every second line; some out of place, too far, or of an unknown block"""
    from pyspark.sql.window import Window

    s = spans(spark, d).join(lines(spark, d).select("doc_id", F.col("ln").alias("ord"), "line"), ["doc_id", "ord"])
    w = F.split("line", " ", -1)
    third = F.try_element_at(w, F.lit(3))
    s = s.where((F.col("ord") % 2 == 0) & F.coalesce(F.length(third) > 0, F.lit(False)))
    start = F.col("start") + F.length(w[0]) + F.length(w[1]) + 2 + F.when(F.col("ord") % 7 == 6, 1).otherwise(0)
    new = F.when(F.col("ord") % 3 == 0, F.concat(third, F.lit("s"))).when(F.col("ord") % 3 == 1, F.concat(third, F.lit("much longer"))).otherwise(F.reverse(third))
    return s.select("doc_id", F.concat(F.lit("c"), F.col("ord").cast("string")).alias("change_id"), F.when(F.col("ord") % 10 == 8, "none").otherwise(F.col("block_id")).alias("block_id"), start.cast("int").alias("start"), (start + F.length(third)).cast("int").alias("end"), third.alias("original"), new.alias("corrected"), F.lit("spelling").alias("category"), F.lit("").alias("reason"), F.when(F.col("ord") % 4 == 0, "accepted").otherwise("pending").alias("status"))


PROPOSALS = SPANS + """,
pr AS (SELECT doc_id, 'c' || ord AS change_id, CASE WHEN ord % 10 = 8 THEN 'none' ELSE block_id END AS block_id, p AS "start", p + length(w[3]) AS "end", w[3] AS original,
  CASE ord % 3 WHEN 0 THEN w[3] || 's' WHEN 1 THEN w[3] || 'much longer' ELSE reverse(w[3]) END AS corrected, 'spelling' AS category, '' AS reason, CASE WHEN ord % 4 = 0 THEN 'accepted' ELSE 'pending' END AS status
  FROM (SELECT *, s0 + length(w[1]) + length(w[2]) + 2 + CASE WHEN ord % 7 = 6 THEN 1 ELSE 0 END AS p FROM (SELECT sp.doc_id, sp.ord, sp.block_id, sp."start" AS s0, string_split(line, ' ') AS w FROM sp JOIN ln ON ln.doc_id = sp.doc_id AND ln.ln = sp.ord)
    WHERE ord % 2 = 0 AND coalesce(length(w[3]), 0) > 0))"""


def segments(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, pos, id, text, size, group_id, status, page, series: lines as translation segments"""
    k = F.col("ln") % 9
    group = F.when(k.isin(3, 4), F.concat(F.lit("row-"), F.floor(F.col("ln") / 9).cast("string")))
    return lines(spark, d).select("doc_id", F.col("ln").alias("pos"), F.concat(F.lit("seg-"), F.col("ln").cast("string")).alias("id"), F.col("line").alias("text"), F.length("line").alias("size"), group.alias("group_id"), F.when(k == 8, "preserved").otherwise("pending").alias("status"))


SEGMENTS = LINES + """,
sg AS (SELECT doc_id, ln AS pos, 'seg-' || ln AS id, line AS text, length(line) AS size, CASE WHEN ln % 9 IN (3, 4) THEN 'row-' || (ln // 9) END AS group_id, CASE WHEN ln % 9 = 8 THEN 'preserved' ELSE 'pending' END AS status FROM ln)"""


#: The characters beyond ASCII that the documents hold, and the ASCII ones, which they don't hold, that stand for them.
BEYOND = "ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöü"
_SPARE = [n for n in range(1, 32) if n not in (9, 10, 13)]


def one_byte(sql: str) -> str:
    """The expression with a byte a character: the oracle's edit distance counts bytes, Spark's characters."""
    return f"translate({sql}, '{BEYOND}', {' || '.join(f'chr({n})' for n in _SPARE[: len(BEYOND)])})"


def page_images(spark: SparkSession, d: str) -> DataFrame:
    """page_id, content: a PNG of each page, its table ruled as the page's length says.

    Every fifth page is empty, every fifth has two faint specks; the others have
    ``n % 4 + 3`` rows and ``page_id % 3 + 3`` columns (n: characters), lines of one to
    three pixels, some with gaps of two, some in colour; all are stored turned.
    """
    import numpy as np
    import pyarrow as pa

    from pagewright.sources import raster

    def drawn(page: int, n: int) -> np.ndarray:
        rows, columns, thick, kind = 3 + n % 4, 3 + page % 3, 1 + page % 3, page % 5
        image = np.full((15 * rows + 20, 20 * columns + 20), 250, np.uint8)
        if kind == 1:
            image[5, 5:7] = 240
        elif kind:
            for r in range(rows + 1):
                image[10 + 15 * r : 10 + 15 * r + thick, 10 : 10 + 20 * columns + thick] = 40
            for c in range(columns + 1):
                image[10 : 10 + 15 * rows + thick, 10 + 20 * c : 10 + 20 * c + thick] = 40
        if kind == 4:
            image[:, 17::20] = image[:, 18::20] = 250  # between the columns
        return np.repeat(image[:, :, None], 3, axis=2) if kind == 3 else image

    def stored(page: int, n: int) -> bytes:
        # turned so that looking at it with its orientation gives what was drawn
        image, o = drawn(page, n), 1 + page % 8
        back = {6: 8, 8: 6}.get(o, o)
        planes = [raster.turned(p, back) for p in (np.moveaxis(image, 2, 0) if image.ndim == 3 else [image])]
        return raster.written(np.stack(planes, axis=2) if image.ndim == 3 else planes[0], orientation=o)

    def run(batches):
        for b in batches:
            pages, sizes = (b.column(i).to_pylist() for i in (0, 1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([stored(p, n) for p, n in zip(pages, sizes, strict=True)], pa.binary())], ["page_id", "content"])

    return table(spark, d, "pages").select("page_id", F.coalesce(F.length("html"), F.lit(0)).cast("long").alias("n")).mapInArrow(run, "page_id long, content binary")


PAGE_IMAGES = """im AS (SELECT page_id, 3 + coalesce(length(html), 0) % 4 AS nr, 3 + page_id % 3 AS nc, 1 + page_id % 3 AS thick, page_id % 5 AS kind, 1 + page_id % 8 AS orientation FROM pages),
sz AS (SELECT *, 20 * nc + 20 AS width, 15 * nr + 20 AS height FROM im)"""
