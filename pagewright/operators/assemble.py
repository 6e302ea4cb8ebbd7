"""Lines to blocks, reading order, page text and its character spans.

Tables: line(page_id, line_index, text, x0, y0, x1, y1), block(page_id, block_id,
ord, x0, y0, x1, y1), word(page_id, line_index, word_index, text, x0, x1).  All
windows partition by page, so a page is never split and never meets another one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagewright.functions import text as T

def page_window():
    return Window.partitionBy("page_id")


def ordered_concat(key, order, value, separator: str):
    """An aggregate that joins strings in the order of ``order``."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))), lambda x: x["v"]), separator)


def lines_to_blocks(lines: DataFrame, gap: float = 1.5) -> DataFrame:
    """Adds block (from 0) and line_in_block: a block ends where the gap to the
    next line exceeds ``gap`` times that line's height.  Lines without a box drop out."""
    own = lines.where("x0 is not null and y0 is not null and x1 is not null and y1 is not null")
    order = page_window().orderBy("line_index")
    new = (F.col("y0") - F.lag("y1").over(order)) > gap * F.greatest(F.lit(1.0), F.col("y1") - F.col("y0"))
    own = own.withColumn("block", F.sum(F.coalesce(new, F.lit(False)).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return own.withColumn("line_in_block", F.row_number().over(Window.partitionBy("page_id", "block").orderBy("line_index")) - 1)


def block_boxes(lines: DataFrame) -> DataFrame:
    """block(page_id, block, n_lines, text, x0, y0, x1, y1) of lines with their block."""
    box = [F.bround(f("%s" % c), 2).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))]
    return lines.groupBy("page_id", "block").agg(F.count("*").alias("n_lines"), ordered_concat("block", "line_index", "text", "\n").alias("text"), *box)


def reading_order(blocks: DataFrame, strict: bool = False) -> DataFrame:
    """Adds position (from 0).

    Two columns are read left, then right, if 85 percent of the blocks lie wholly
    in one half and each half has two; else blocks go by bands of 15 units.
    Blocks that straddle the middle of two columns follow at the end, by height;
    ``strict`` drops them.
    """
    mid = (F.min("x0").over(page_window()) + F.max("x1").over(page_window())) / 2
    left, right = F.col("x1") <= F.col("_mid"), F.col("x0") >= F.col("_mid")
    out = blocks.withColumn("_mid", mid).withColumn("_side", F.when(left, 0).when(right, 1).otherwise(2))
    n = lambda side: F.sum((F.col("_side") == side).cast("int")).over(page_window())
    two = (n(0) + n(1) >= 0.85 * F.count("*").over(page_window())) & (n(0) >= 2) & (n(1) >= 2)
    out = out.withColumn("_two", two)
    if strict:
        out = out.where(~F.col("_two") | (F.col("_side") < 2))
    band = F.bround(F.col("y0") / 15)
    keys = [F.when(F.col("_two"), F.col("_side")).otherwise(0), F.when(F.col("_two"), F.col("y0")).otherwise(band), F.col("x0"), F.col("ord")]
    return out.withColumn("position", F.row_number().over(page_window().orderBy(*keys)) - 1).drop("_mid", "_side", "_two")


def char_spans(lines: DataFrame) -> DataFrame:
    """Spans of a page's trimmed lines in its assembled text.

    lines: page_id, block (its position), line_in_block, text; a row with null
    text stands for a block without lines.  A line feed precedes every line but
    the one numbered 0 of a block, two follow every block but the last, be it
    empty or not.
    """
    rows = lines.withColumn("t", T.strip(F.coalesce("text", F.lit(""))))
    order = page_window().orderBy("block", "line_in_block")
    shown = F.col("t") != ""
    before = F.when(shown & (F.col("line_in_block") > 0), 1).otherwise(0)
    # what earlier blocks add between themselves and this line
    rows = rows.withColumn("_before", before).withColumn("_rank", F.dense_rank().over(page_window().orderBy("block")) - 1)
    used = F.sum(F.col("_before") + F.length("t")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    start = F.coalesce(used, F.lit(0)) + F.col("_before") + 2 * F.col("_rank")
    return rows.where(shown).select("page_id", "block", "line_in_block", start.cast("long").alias("start"), (start + F.length("t")).cast("long").alias("end"), F.col("t").alias("text"))


def page_text(lines: DataFrame) -> DataFrame:
    """page_id, text: the assembled text that ``char_spans`` maps."""
    rows = lines.withColumn("t", T.strip(F.coalesce("text", F.lit(""))))
    part = F.when(F.col("t") == "", "").otherwise(F.concat(F.when(F.col("line_in_block") > 0, "\n").otherwise(""), F.col("t")))
    blocks = rows.withColumn("part", part).groupBy("page_id", "block").agg(ordered_concat("block", "line_in_block", "part", "").alias("t"))
    return blocks.groupBy("page_id").agg(ordered_concat("page_id", "block", "t", "\n\n").alias("text"))


def tabbed_lines(words: DataFrame, gap: float = 30.0) -> DataFrame:
    """page_id, line_index, parts, text: a tab where words are further apart than ``gap``."""
    own = Window.partitionBy("page_id", "line_index").orderBy("x0", "word_index")
    rows = words.withColumn("cut", F.coalesce((F.col("x0") - F.lag("x1").over(own) > gap).cast("int"), F.lit(0)))
    rows = rows.withColumn("part", F.sum("cut").over(own.rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.row_number().over(own))
    parts = rows.groupBy("page_id", "line_index", "part").agg(ordered_concat("part", "n", "text", " ").alias("t"))
    return parts.groupBy("page_id", "line_index").agg(F.count("*").alias("parts"), ordered_concat("line_index", "part", "t", "\t").alias("text"))


def body_size(lines: DataFrame, default: float = 14.0) -> DataFrame:
    """page_id, body: the median size, each line as often as it has characters."""
    own = lines.where((F.col("size") > 0) & (F.length(T.strip(F.col("text"))) > 0))
    sized = own.groupBy("page_id").agg(F.expr("percentile(size, 0.5, length(text))").alias("body"))
    return lines.select("page_id").distinct().join(sized, "page_id", "left").select("page_id", F.coalesce(F.bround("body", 2), F.lit(default)).alias("body"))


def block_style(lines: DataFrame) -> DataFrame:
    """page_id, block, size_median, size_max, bold_ratio, italic_ratio, fonts of lines as
    ``line_style`` gives them, with their block: the plain mean of the lines' ratios, the
    median of the sizes above zero (0 where there is none), fonts as first seen."""
    # ratios have four digits: whole numbers add up alike in any order
    mean = lambda c: (F.bround(F.sum(F.round(F.col(c) * 10_000).cast("long")) / (F.count(c) * 100)) / 100).alias(c)
    seen = F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("line_index", "fonts"))), lambda x: x["fonts"])))
    median = F.coalesce(F.bround(F.median(F.when(F.col("size_median") > 0, F.col("size_median"))), 2), F.lit(0.0))
    return lines.groupBy("page_id", "block").agg(median.alias("size_median"), F.bround(F.max("size_max"), 2).alias("size_max"), mean("bold_ratio"), mean("italic_ratio"), seen.alias("fonts"))


def line_style(spans: DataFrame) -> DataFrame:
    """page_id, line_index, size_median, size_max, bold_ratio, italic_ratio, fonts of spans(text, size, flags, font, ord)."""
    chars = F.length("text")
    named = lambda *names: F.lower("font").rlike("|".join(names))
    bold = (F.col("flags").bitwiseAND(16) != 0) | named("bold")
    italic = (F.col("flags").bitwiseAND(2) != 0) | named("italic", "oblique")
    ratio = lambda c: F.bround(F.sum(F.when(c, chars).otherwise(0)) / F.greatest(F.sum(chars), F.lit(1)), 4)
    return spans.groupBy("page_id", "line_index").agg(
        F.expr("percentile(size, 0.5, length(text))").alias("size_median"),
        F.max("size").alias("size_max"),
        ratio(bold).alias("bold_ratio"),
        ratio(italic).alias("italic_ratio"),
        F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("ord", "font"))), lambda x: x["font"])).alias("fonts"),
    )


def native_lines(blocks: DataFrame, dpi: int = 300) -> DataFrame:
    """Lines of text blocks in points: pixels, and boxes of equal height for the lines that aren't blank."""
    scale = dpi / 72
    rows = blocks.where(F.col("text").isNotNull() & (T.strip(F.col("text")) != "")).select("page_id", "block_id", "x0", "y0", "x1", "y1", F.posexplode(F.filter(F.split("text", "\n", -1), lambda x: T.strip(x) != "")).alias("line_index", "text"))
    height = (F.col("y1") - F.col("y0")) * scale / F.count("*").over(Window.partitionBy("page_id", "block_id"))
    top = F.col("y0") * scale + F.col("line_index") * height
    return rows.select("page_id", "block_id", "line_index", "text", *(F.bround(F.col(c) * scale, 2).alias(c) for c in ("x0", "x1")), F.bround(top, 2).alias("y0"), F.bround(top + height, 2).alias("y1"))


def job_text(pages: DataFrame, headers: bool = False) -> DataFrame:
    """job_id, text: pages in order between form feeds; failed and cancelled pages leave a marker."""
    body = F.when(F.col("status") == "failed", F.concat(F.lit("[Page "), F.col("page_id").cast("string"), F.lit(" FAILED]"))).when(F.col("status") == "cancelled", F.concat(F.lit("[Page "), F.col("page_id").cast("string"), F.lit(" CANCELLED]"))).otherwise(F.coalesce("final_text", "raw_text", F.lit("")))
    if headers:
        body = F.concat(F.lit("--- Page "), F.col("page_id").cast("string"), F.lit(" ---\n"), body)
    return pages.withColumn("body", body).groupBy("job_id").agg(ordered_concat("job_id", "page_id", "body", "\n\f\n").alias("text"))


def blocks_in_order(blocks: DataFrame, most: int = 100_000) -> DataFrame:
    """Blocks (page_id, line_index, x0, y0, ...) with position: by top, then left, then
    as they came; the first ``most`` of a page."""
    nth = F.row_number().over(Window.partitionBy("page_id").orderBy("y0", "x0", "line_index"))
    return blocks.withColumn("position", nth - 1).where(F.col("position") < most)


def united_blocks(native: DataFrame, recognised: DataFrame) -> DataFrame:
    """All blocks of both origins in one reading order."""
    both = native.withColumn("origin", F.lit("native")).unionByName(recognised.withColumn("origin", F.lit("ocr")))
    nth = F.row_number().over(Window.partitionBy("page_id").orderBy("y0", "x0", "origin", "line_index"))
    return both.withColumn("position", nth - 1)
