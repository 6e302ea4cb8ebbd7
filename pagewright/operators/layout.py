"""Lists, headings and tables from lines; structured text out of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagewright.functions import text as T

def in_page():
    return Window.partitionBy("page_id").orderBy("ord")


def so_far():
    return in_page().rowsBetween(Window.unboundedPreceding, 0)


def list_blocks(lines: DataFrame) -> DataFrame:
    """Lines (page_id, ord, text) with kind and island: consecutive marked lines of one kind are a list."""
    rows = lines.withColumn("_m", T.list_marker(F.col("text"))).withColumn("kind", F.coalesce("_m.kind", F.lit("paragraph")))
    new = (F.col("kind") == "paragraph") | F.coalesce(F.lag("kind").over(in_page()) != F.col("kind"), F.lit(True))
    return rows.withColumn("island", F.sum(new.cast("int")).over(so_far()) - 1).withColumn("body", F.coalesce("_m.body", "text")).drop("_m")


def layout_headings(lines: DataFrame) -> DataFrame:
    """Lines (page_id, ord, text, size, bold) with kind: h1, h2 or paragraph."""
    sized = lines.where("size > 0 and trim(text) <> ''").groupBy("page_id").agg(F.median("size").alias("_body"))
    rows = lines.join(sized, "page_id", "left")
    big = (F.col("_body") > 0) & (F.length("text") <= 100) & (F.col("size") >= F.col("_body") * 1.2) & ((F.col("bold") >= 0.6) | (F.col("size") >= F.col("_body") * 1.35))
    rows = rows.withColumn("_h", F.coalesce(big, F.lit(False)))
    nth = F.sum(F.col("_h").cast("int")).over(so_far())
    return rows.withColumn("kind", F.when(~F.col("_h"), "paragraph").when(nth == 1, "h1").otherwise("h2")).drop("_h", "_body")


def tab_tables(lines: DataFrame) -> DataFrame:
    """page_id, table, row_index, column_index, text: two or more consecutive lines with tabs, padded to one width."""
    rows = lines.withColumn("_tab", F.contains("text", F.lit("\t"))).withColumn("_out", F.sum((~F.col("_tab")).cast("int")).over(so_far())).where("_tab")
    run = Window.partitionBy("page_id", "_out")
    rows = rows.withColumn("_n", F.count("*").over(run)).where("_n >= 2").withColumn("_cells", F.split("text", "\t", -1))
    rows = rows.withColumn("_width", F.max(F.size("_cells")).over(run)).withColumn("row_index", F.row_number().over(run.orderBy("ord")) - 1)
    rows = rows.withColumn("table", F.dense_rank().over(Window.partitionBy("page_id").orderBy("_out")) - 1)
    padded = F.concat("_cells", F.array_repeat(F.lit(""), F.col("_width") - F.size("_cells")))
    return rows.select("page_id", "table", "row_index", F.posexplode(padded).alias("column_index", "text"))


def uncovered(cells: DataFrame, grids: DataFrame) -> DataFrame:
    """page_id, table, row_index, column_index of grid places (grids: n_rows, n_cols) that no cell covers."""
    covers = cells.select("page_id", "table", F.explode(F.sequence(F.col("row_index"), F.col("row_index") + F.col("rowspan") - 1)).alias("row_index"), "column_index", "colspan")
    covers = covers.select("page_id", "table", "row_index", F.explode(F.sequence(F.col("column_index"), F.col("column_index") + F.col("colspan") - 1)).alias("column_index"))
    places = grids.select("page_id", "table", F.explode(F.sequence(F.lit(0), F.col("n_rows") - 1)).alias("row_index"), "n_cols").select("page_id", "table", "row_index", F.explode(F.sequence(F.lit(0), F.col("n_cols") - 1)).alias("column_index"))
    return places.join(covers, ["page_id", "table", "row_index", "column_index"], "left_anti")


def structured_text(blocks: DataFrame) -> DataFrame:
    """page_id, text: headings, paragraphs, list items (kind, number, body) one a line, in order."""
    line = F.when(F.col("kind") == "unordered", F.concat(F.lit("- "), F.col("body"))).when(F.col("kind") == "ordered", F.concat(F.col("number").cast("string"), F.lit(". "), F.col("body"))).otherwise(F.col("body"))
    from .assemble import ordered_concat

    return blocks.withColumn("_l", line).groupBy("page_id").agg(ordered_concat("page_id", "ord", "_l", "\n").alias("text"))


def heading_tags(lines: DataFrame) -> DataFrame:
    """Lines (doc_id, page_id, ord, level) with tag: one h1 a document, later candidates are h2, an h3 needs an h2 before it on its page."""
    book = Window.partitionBy("doc_id").orderBy("page_id", "ord").rowsBetween(Window.unboundedPreceding, 0)
    page = Window.partitionBy("doc_id", "page_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    nth = F.sum((F.col("level") == "h1").cast("int")).over(book)
    rows = lines.withColumn("_tag", F.when(F.col("level").isNull(), "p").when((F.col("level") == "h1") & (nth == 1), "h1").when(F.col("level") == "h1", "h2").otherwise(F.col("level")))
    had = F.coalesce(F.max((F.col("_tag") == "h2").cast("int")).over(page), F.lit(0))
    return rows.withColumn("tag", F.when((F.col("_tag") == "h3") & (had == 0), "h2").otherwise(F.col("_tag"))).drop("_tag")


def hierarchy_errors(headings: DataFrame) -> DataFrame:
    """doc_id, ord, error of headings (doc_id, ord, level 1-3): a jump of more than one level, a second level 1."""
    own = Window.partitionBy("doc_id").orderBy("ord")
    before = F.lag("level").over(own)
    nth = F.sum((F.col("level") == 1).cast("int")).over(own.rowsBetween(Window.unboundedPreceding, 0))
    error = F.when((F.col("level") == 1) & (nth > 1), "second_h1").when(F.col("level") > F.coalesce(before, F.lit(0)) + 1, "level_jump")
    return headings.withColumn("error", error).where("error is not null").select("doc_id", "ord", "level", "error")


def chapters(blocks: DataFrame, title: str = "Book") -> DataFrame:
    """doc_id, chapter, title, n_blocks, body (XHTML) of blocks (doc_id, ord, tag, page, text): cut at h1 where there is one, else at pages.
    A chapter is called by its first heading, its page, the book if it's the first, or its number."""
    # one order for all windows, so texts are sorted once
    order = Window.partitionBy("doc_id").orderBy("ord")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = blocks.withColumn("_any", F.max((F.col("tag") == "h1").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) == 1)
    cut = F.when(F.col("_any"), F.col("tag") == "h1").otherwise(F.col("page") != F.lag("page").over(order))
    rows = rows.withColumn("_cut", F.coalesce(cut, F.lit(False)).cast("int"))
    rows = rows.withColumn("chapter", (F.sum("_cut").over(so_far) - F.first("_cut").over(so_far)).cast("int"))
    head = F.when(F.col("tag").isin("h1", "h2", "h3"), F.struct("ord", "text"))
    html = F.concat(F.lit("<"), "tag", F.lit(">"), T.escape_html(F.coalesce("text", F.lit(""))), F.lit("</"), "tag", F.lit(">"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", html.alias("html")))), lambda x: x["html"]), "\n")
    page, nth = F.min(F.when(F.col("page").isNotNull(), F.struct("ord", "page")))["page"], (F.col("chapter") + 1).cast("string")
    named = F.coalesce(F.min(head)["text"], F.concat(F.lit(PAGE_TITLE), page.cast("string")), F.when(F.col("chapter") == 0, F.lit(title)).otherwise(F.concat(F.lit(PART_TITLE), nth)))
    return rows.groupBy("doc_id", "chapter").agg(F.substring(named, 1, 200).alias("title"), F.count("*").alias("n_blocks"), body.alias("body"))


#: What a chapter without a heading is called, by its page or else its number.
PAGE_TITLE, PART_TITLE = "หน้า ", "ส่วนที่ "


def toc_levels(headings: DataFrame) -> DataFrame:
    """doc_id, ord, level, parent: a heading's parent is the last one before it of a smaller level; levels never skip one."""
    ups = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    last = lambda k: F.max(F.when(F.col("level") == k, F.col("ord"))).over(ups)
    rows = headings.select("doc_id", "ord", "level", last(1).alias("_1"), last(2).alias("_2"))
    parent = F.when(F.col("level") == 2, F.col("_1")).when(F.col("level") == 3, F.greatest("_1", "_2"))
    rows = rows.withColumn("parent", parent)
    depth = F.when(F.col("parent").isNull(), 1).when((F.col("level") == 3) & (F.col("_2") > F.coalesce("_1", F.lit(-1))), F.when(F.col("_1").isNull(), 2).otherwise(3)).otherwise(2)
    return rows.select("doc_id", "ord", "level", "parent", depth.cast("int").alias("depth"))


def heading_ids(blocks: DataFrame) -> DataFrame:
    """Blocks with id: their own where valid, else a hash of tag, text and page with a number for repeats."""
    sig = F.substring(F.sha2(F.concat_ws("|", "tag", "text", F.col("page").cast("string")), 256), 1, 12)
    rows = blocks.withColumn("_sig", sig)
    nth = F.row_number().over(Window.partitionBy("doc_id", "_sig").orderBy("ord"))
    made = F.concat(F.lit("h-"), F.col("_sig"), F.when(nth > 1, F.concat(F.lit("-"), nth.cast("string"))).otherwise(""))
    return rows.withColumn("id", F.when(F.col("source_id").rlike("^[A-Za-z][A-Za-z0-9_.:-]*$"), F.col("source_id")).otherwise(made)).drop("_sig")


def _bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it is looked at."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _longest_by_line(runs: Column, gap: int = 2) -> Column:
    """array<struct<line, longest>> of runs(line, first, last) in order: the longest run of
    each line once gaps of up to ``gap`` pixels are bridged."""
    done = "array<struct<line:int,longest:int>>"
    state = f"struct<done:{done},line:int,first:int,last:int,longest:int>"
    zero = F.struct(F.array().cast(done).alias("done"), *(F.lit(None).cast("int").alias(n) for n in ("line", "first", "last", "longest"))).cast(state)
    closed = lambda acc: F.when(acc["line"].isNull(), acc["done"]).otherwise(F.array_append(acc["done"], F.struct(acc["line"].alias("line"), acc["longest"].alias("longest"))))

    def step(acc: Column, r: Column) -> Column:
        on = F.coalesce(acc["line"] == r["line"], F.lit(False))
        first = F.when(on & (r["first"] - acc["last"] <= gap + 1), acc["first"]).otherwise(r["first"])
        n = r["last"] - first + 1
        return F.struct(F.when(on, acc["done"]).otherwise(closed(acc)).alias("done"), r["line"].alias("line"), first.alias("first"), r["last"].alias("last"), F.when(on, F.greatest(acc["longest"], n)).otherwise(n).alias("longest"))

    return F.aggregate(runs, zero, step, closed)


def _merged_lines(lines: Column, gap: int = 4) -> Column:
    """Centres of sorted places that stand no more than ``gap`` apart."""
    state = "array<struct<total:bigint,n:int,last:int>>"

    def step(acc: Column, v: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        grown = F.array_append(F.slice(acc, F.lit(1), F.size(acc) - 1), F.struct((last["total"] + v).alias("total"), (last["n"] + 1).alias("n"), v.alias("last")))
        return F.when(F.size(acc) == 0, F.array(F.struct(v.cast("bigint").alias("total"), F.lit(1).alias("n"), v.alias("last")))).when(v - last["last"] <= gap, grown).otherwise(F.array_append(acc, F.struct(v.cast("bigint").alias("total"), F.lit(1).alias("n"), v.alias("last"))))

    return F.transform(F.aggregate(lines, F.array().cast(state), step), lambda c: F.bround(c["total"] / c["n"]).cast("bigint"))


def grid_cells(pages: DataFrame, wide: float = 0.18, tall: float = 0.05, crossing: float = 0.7, most: int = 20_001) -> DataFrame:
    """page_id, row_index, column_index, x0, y0, x1, y1: the cells of a page's ruled table.

    pages has page_id, width, height and the runs of dark pixels by row and by column
    (rows, columns: line, first, last), as ``sources.raster`` gives them.  A row with a
    run of ``wide`` of the width, and a column with one of ``tall`` of the height, is a
    ruled line, thick ones merged.  Three of each axis may make a grid: of the rows stay
    those that meet ``crossing`` of the columns within two pixels, then of the columns
    those that meet as much of the rows left; again three of each are needed, and ``most``
    intersections at most.  A page is one row throughout, so nothing is shuffled.
    """
    ruled = lambda runs, share, side: _merged_lines(F.transform(F.filter(_longest_by_line(F.col(runs)), lambda x: x["longest"] >= share * F.col(side)), lambda x: x["line"]))
    none = F.array().cast("array<bigint>")
    crosses = lambda near, x: F.exists(near, lambda r: (r["first"] <= x + 2) & (r["last"] >= x - 2))

    def met(p: Column) -> Column:
        """Each row with the columns that it meets: a run crosses (x, y) if it lies within
        two rows of y and reaches within two pixels of x."""
        near = lambda y: F.filter(p["runs"], lambda r: F.abs(r["line"] - y) <= 2)
        return F.transform(p["ys"], lambda y: F.struct(y.alias("y"), _bound(near(y), lambda n: F.filter(p["xs"], lambda x: crosses(n, x))).alias("xs")))

    def kept(p: Column) -> Column:
        rows = F.filter(met(p), lambda m: F.size(m["xs"]) >= crossing * F.size(p["xs"]))
        columns = lambda ms: F.filter(p["xs"], lambda x: F.size(F.filter(ms, lambda m: F.array_contains(m["xs"], x))) >= crossing * F.size(ms))
        return _bound(rows, lambda ms: F.struct(F.transform(ms, lambda m: m["y"]).alias("ys"), columns(ms).alias("xs")))

    def grid(p: Column) -> Column:
        enough = lambda g: (F.size(g["ys"]) >= 3) & (F.size(g["xs"]) >= 3)
        empty = F.struct(none.alias("ys"), none.alias("xs"))
        return F.when(enough(p), _bound(kept(p), lambda g: F.when(enough(g) & (F.size(g["ys"]) * F.size(g["xs"]) <= most), g).otherwise(empty))).otherwise(empty)

    page = F.struct(ruled("rows", wide, "width").alias("ys"), ruled("columns", tall, "height").alias("xs"), F.col("rows").alias("runs"))
    got = pages.where(F.col("width").isNotNull()).select("page_id", _bound(page, grid).alias("g"))
    between = lambda c, a, b: F.posexplode(F.transform(F.slice(c, F.lit(1), F.greatest(F.size(c) - 1, F.lit(0))), lambda v, i: F.struct(v.alias(a), F.get(c, i + 1).alias(b))))
    rows = got.select("page_id", F.col("g.xs").alias("xs"), between(F.col("g.ys"), "y0", "y1").alias("row_index", "r"))
    cells = rows.select("page_id", "row_index", "r", between(F.col("xs"), "x0", "x1").alias("column_index", "c"))
    return cells.select("page_id", "row_index", "column_index", "c.x0", "r.y0", "c.x1", "r.y1")


def zipped(left: DataFrame, right: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of one key paired by position, both in their order; what is beyond the shorter drops out."""
    own = Window.partitionBy(key).orderBy(order)
    nth = lambda df: df.withColumn("_n", F.row_number().over(own))
    other = nth(right).select(F.col(key).alias("_k"), F.col("_n").alias("_m"), *(F.col(c).alias(f"right_{c}") for c in right.columns if c != key))
    return nth(left).join(other, (F.col(key) == F.col("_k")) & (F.col("_n") == F.col("_m"))).drop("_k", "_m").withColumn("position", F.col("_n") - 1).drop("_n")


def page_sections(pages: DataFrame) -> DataFrame:
    """job_id, html: a section a page in order; failed and blank pages have a marker instead of text."""
    from .assemble import ordered_concat

    text = T.escape_html(F.coalesce("text", F.lit("")), quotes=True)
    paragraphs = F.array_join(F.transform(F.filter(F.split(text, "\n", -1), lambda x: T.strip(x) != ""), lambda x: F.concat(F.lit("<p>"), x, F.lit("</p>"))), "")
    body = F.when(F.col("status") == "failed", '<p class="failed">failed</p>').when((F.col("status") == "blank") | (paragraphs == ""), '<p class="blank">blank</p>').otherwise(paragraphs)
    page = F.concat(F.lit('<section data-page="'), F.col("page_id").cast("string"), F.lit('">'), body, F.lit("</section>"))
    return pages.withColumn("_s", page).groupBy("job_id").agg(ordered_concat("job_id", "page_id", "_s", "").alias("html"))


def confidences(words: DataFrame) -> DataFrame:
    """page_id, line_index, confidence: the mean over a line's words, null without any."""
    return words.groupBy("page_id", "line_index").agg(F.bround(F.avg("confidence"), 4).alias("confidence"))


def unresolved_counts(cells: DataFrame) -> DataFrame:
    """page_id, unresolved: how many cells have something to review, private-use glyphs included."""
    odd = F.col("unresolved") | F.col("text").rlike(r"[\x{E000}-\x{F8FF}]")
    return cells.groupBy("page_id").agg(F.count_if(odd).alias("unresolved"))


def retagged(units: DataFrame, answers: DataFrame) -> DataFrame:
    """units(doc_id, unit, ord, tag, text) with the tags of a model's answers(doc_id,
    ord, unit, tag), and mode and reason: a document whose answer breaks a rule, or
    that has none, keeps all its own tags (mode basic).  Only tags ever change."""
    order = Window.partitionBy("doc_id").orderBy("ord")
    tag = F.lower(F.trim("tag"))
    known = units.select("doc_id", "unit", F.lit(True).alias("_known"))
    rows = answers.select("doc_id", "ord", "unit", tag.alias("new")).join(known, ["doc_id", "unit"], "left")
    level = F.when(F.col("new").isin("h1", "h2", "h3"), F.substring("new", 2, 1).cast("int"))
    before = F.last(level, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    nth = F.row_number().over(Window.partitionBy("doc_id", "unit").orderBy("ord"))
    h1s = F.count(F.when(F.col("new") == "h1", 1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rules = ((F.col("_known").isNull(), "unknown_unit"), (nth > 1, "duplicate_unit"), (~F.col("new").isin("p", "h1", "h2", "h3"), "tag"), ((F.col("new") == "h1") & (h1s > 1), "second_h1"), (level - before > 1, "hierarchy"))
    judged = rows.withColumn("wrong", F.coalesce(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for c, n in rules)))
    of = judged.groupBy("doc_id").agg(F.min_by("wrong", F.when(F.col("wrong").isNotNull(), F.col("ord"))).alias("reason"), F.lit(True).alias("_any"))
    new = judged.where("wrong is null").select("doc_id", "unit", "new")
    out = units.join(of, "doc_id", "left").join(new, ["doc_id", "unit"], "left")
    reason = F.when(F.col("_any").isNull(), "no_answer").otherwise(F.col("reason"))
    return out.withColumn("reason", reason).withColumn("mode", F.when(F.col("reason").isNull(), "ai").otherwise("basic")).withColumn("tag", F.when(F.col("mode") == "ai", F.coalesce("new", "tag")).otherwise(F.col("tag"))).drop("_any", "new")
