"""Correction proposals: provenance, validation, application and reversal.

Tables: text(doc_id, text), span(doc_id, ord, block_id, line_index, start, end),
proposal(doc_id, change_id, block_id, line_index, start, end, original,
corrected, category, reason, status).  Offsets are code points, end exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagewright.functions import text as T


def located(proposals: DataFrame, spans: DataFrame) -> DataFrame:
    """Proposals with line: that of the first span of their block that contains
    them, else of the first that contains their start, else null."""
    p = proposals.alias("p")
    s = spans.select(*(F.col(c).alias(f"s_{c}") for c in ("doc_id", "ord", "block_id", "line_index", "start", "end"))).alias("s")
    inside = (F.col("s_start") <= F.col("p.start")) & (F.col("p.end") <= F.col("s_end"))
    begins = (F.col("s_start") <= F.col("p.start")) & (F.col("p.start") < F.col("s_end"))
    near = p.join(s, (F.col("p.doc_id") == F.col("s_doc_id")) & (F.col("p.block_id") == F.col("s_block_id")) & (inside | begins))
    found = near.groupBy("p.doc_id", "p.change_id").agg(F.min(F.struct((~inside).alias("late"), "s_ord", F.col("s_line_index").alias("line")))["line"].alias("line"))
    return proposals.join(found, ["doc_id", "change_id"], "left")


def span_at(points: DataFrame, spans: DataFrame) -> DataFrame:
    """points(doc_id, start, end) with the block and line of the first span that
    contains their start or lies in them."""
    p = points.alias("p")
    s = spans.select(*(F.col(c).alias(f"s_{c}") for c in ("doc_id", "ord", "block_id", "line_index", "start", "end"))).alias("s")
    hit = ((F.col("s_start") <= F.col("p.start")) & (F.col("p.start") < F.col("s_end"))) | ((F.col("p.start") <= F.col("s_start")) & (F.col("s_end") <= F.col("p.end")))
    got = p.join(s, (F.col("p.doc_id") == F.col("s_doc_id")) & hit).groupBy("p.doc_id", "p.start", "p.end").agg(F.min(F.struct("s_ord", "s_block_id", "s_line_index")).alias("f"))
    return got.select("doc_id", "start", "end", F.col("f.s_block_id").alias("block_id"), F.col("f.s_line_index").alias("line_index"))


def row_verdict(text: Column) -> tuple[Column, Column]:
    """The first failing rule before the overlap test, and the first after it; null if none fails."""
    start, end, old, new = F.col("start"), F.col("end"), F.col("original"), F.col("corrected")
    before = F.when((start < 0) | (end > F.length(text)) | (start >= end), "out_of_bounds").when(F.substring(text, start + 1, end - start) != old, "content_mismatch")
    words = F.length(T.strip(old)) - F.length(F.replace(T.strip(old), F.lit(" "), F.lit("")))
    far = F.greatest(F.lit(2), F.floor(F.length(old) / 2))
    after = (
        F.when(~F.col("known_block"), "invalid_block")
        .when(F.col("line").isNull(), "mapping_mismatch")
        .when((F.length(old) > 25) | (words > 1), "phrase_level")
        .when((F.levenshtein(old, new) > far) | (F.abs(F.length(old) - F.length(new)) > 3), "edit_distance")
        .when(T.injected(new) | T.injected(F.coalesce("reason", F.lit(""))), "injection")
    )
    return before, after


def greedy_spans(items: Column) -> Column:
    """Of array<struct<start,end,ok,...>> in order of (start, end): each with free,
    whether it starts at or after the end of the last one that was ok and free."""
    kind = "struct<last:int,out:array<struct<start:int,end:int,id:string,ok:boolean,free:boolean>>>"
    zero = F.from_json(F.lit('{"last":-1,"out":[]}'), kind)

    def step(acc: Column, x: Column) -> Column:
        free = x["start"] >= acc["last"]
        one = F.struct(x["start"].alias("start"), x["end"].alias("end"), x["id"].alias("id"), x["ok"].alias("ok"), free.alias("free"))
        return F.struct(F.when(free & x["ok"], x["end"]).otherwise(acc["last"]).alias("last"), F.concat(acc["out"], F.array(one)).alias("out"))

    return F.aggregate(F.array_sort(items), zero, step, lambda acc: acc["out"])


def validated(proposals: DataFrame, texts: DataFrame, spans: DataFrame) -> DataFrame:
    """Proposals with verdict (accepted or the first rule they break) and flagged (touches a number or a name).

    Rows are judged one by one in columns; only the test for overlap with the
    last accepted proposal is a fold, over a document's proposals.
    """
    blocks = spans.select("doc_id", "block_id").distinct().withColumn("known_block", F.lit(True))
    rows = located(proposals, spans).join(blocks, ["doc_id", "block_id"], "left").withColumn("known_block", F.coalesce("known_block", F.lit(False))).join(texts.select("doc_id", "text"), "doc_id")
    before, after = row_verdict(F.col("text"))
    rows = rows.withColumn("_before", before).withColumn("_after", after).drop("text")
    item = F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), F.col("change_id").cast("string").alias("id"), F.col("_after").isNull().alias("ok"))
    folded = rows.where("_before is null").groupBy("doc_id").agg(greedy_spans(F.collect_list(item)).alias("o")).select("doc_id", F.explode("o").alias("o")).select("doc_id", F.col("o.id").alias("_id"), F.col("o.free").alias("_free"))
    out = rows.join(folded.withColumnRenamed("doc_id", "_doc"), (F.col("doc_id") == F.col("_doc")) & (F.col("change_id").cast("string") == F.col("_id")), "left")
    verdict = F.coalesce("_before", F.when(~F.col("_free"), "overlap"), "_after", F.lit("accepted"))
    number = T.has_digit(F.col("original")) | T.has_digit(F.col("corrected")) | F.col("category").isin("number", "named_entity")
    return out.withColumn("verdict", verdict).withColumn("flagged", (verdict == "accepted") & number).drop("_before", "_after", "_doc", "_id", "_free")


def stale(proposals: DataFrame, source: Column, current: Column) -> DataFrame:
    """Proposals made for another revision are stale, all at once."""
    return proposals.withColumn("status", F.when(source != current, "stale").otherwise(F.col("status")))


def applied(texts: DataFrame, proposals: DataFrame) -> DataFrame:
    """doc_id, text with the active proposals put in from right to left."""
    live = proposals.where(~F.col("status").isin("stale", "rejected"))
    change = F.struct((-F.col("start").cast("int")).alias("o"), F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "corrected")
    by = live.groupBy("doc_id").agg(F.array_sort(F.collect_list(change)).alias("_c"))
    put = lambda acc, c: F.concat(F.substring(acc, F.lit(1), c["start"]), c["corrected"], F.substring(acc, c["end"] + 1, F.length(acc)))
    return texts.join(by, "doc_id", "left").select("doc_id", F.when(F.col("_c").isNull(), F.col("text")).otherwise(F.aggregate("_c", F.col("text"), put)).alias("text"))


def reverted(texts: DataFrame, proposals: DataFrame, change_ids: DataFrame) -> DataFrame:
    """The text with all proposals but those of ``change_ids`` (doc_id, change_id)."""
    return applied(texts, proposals.join(change_ids, ["doc_id", "change_id"], "left_anti"))


def rebuilt(texts: DataFrame, proposals: DataFrame) -> DataFrame:
    """As ``applied``, but a proposal whose original isn't there, or that overlaps one right of it, is passed over."""
    change = F.struct((-F.col("start").cast("int")).alias("o"), F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "original", "corrected")
    by = proposals.groupBy("doc_id").agg(F.array_sort(F.collect_list(change)).alias("_c"))

    def step(acc: Column, c: Column) -> Column:
        fits = (c["end"] <= acc["edge"]) & (F.substring(acc["text"], c["start"] + 1, c["end"] - c["start"]) == c["original"])
        put = F.concat(F.substring(acc["text"], F.lit(1), c["start"]), c["corrected"], F.substring(acc["text"], c["end"] + 1, F.length(acc["text"])))
        return F.struct(F.when(fits, put).otherwise(acc["text"]).alias("text"), F.when(fits, c["start"]).otherwise(acc["edge"]).alias("edge"))

    zero = F.struct(F.col("text").alias("text"), F.length("text").alias("edge"))
    return texts.join(by, "doc_id", "left").select("doc_id", F.when(F.col("_c").isNull(), F.col("text")).otherwise(F.aggregate("_c", zero, step, lambda a: a["text"])).alias("text"))


def shifted(proposals: DataFrame) -> DataFrame:
    """Proposals with shift: by how much the accepted ones that end before them move them."""
    own = Window.partitionBy("doc_id").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    grow = F.when(F.col("status") == "accepted", F.length("corrected") - F.length("original")).otherwise(0)
    return proposals.withColumn("shift", F.coalesce(F.sum(grow).over(own), F.lit(0)))


def counters(proposals: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    return proposals.groupBy("doc_id").agg(F.count("*").alias("total"), *map(n, ("pending", "accepted", "rejected", "stale")))


def candidates(model: DataFrame, texts: DataFrame) -> DataFrame:
    """Model output to proposals: stripped, empty and unchanged ones dropped, unknown
    categories are spelling, missing offsets are those of the first occurrence."""
    known = ("spelling", "vowel_tone", "spacing", "punctuation", "number", "named_entity")
    rows = model.withColumn("original", T.strip(F.col("original"))).withColumn("corrected", T.strip(F.col("corrected"))).where("original <> '' and corrected <> '' and original <> corrected").join(texts.select("doc_id", "text"), "doc_id")
    at = F.coalesce(F.col("start"), F.expr("locate(original, text)") - 1)
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("ord")) - 1
    return rows.withColumn("start", at).where("start >= 0").select("doc_id", F.concat(F.lit("chg_"), nth.cast("string")).alias("change_id"), F.col("start").cast("int").alias("start"), (F.col("start") + F.length("original")).cast("int").alias("end"), "original", "corrected", F.when(F.col("category").isin(*known), F.col("category")).otherwise("spelling").alias("category"))


def highlight(text: Column, start: Column, end: Column) -> Column:
    """struct(start, end, base): a span of marks alone grows back to its consonant."""
    own, before = F.substring(text, start + 1, end - start), F.substring(text, F.lit(1), start)
    tail = F.regexp_extract(before, r"([กขฃคฅฆงจฉชซฌญฎฏฐฑฒณดตถทธนบปผฝพฟภมยรลวศษสหฬอฮ][^กขฃคฅฆงจฉชซฌญฎฏฐฑฒณดตถทธนบปผฝพฟภมยรลวศษสหฬอฮ \t\r\n]*)$", 1)
    grows = own.rlike(T.THAI_MARKS) & (tail != "")
    return F.struct(F.when(grows, start - F.length(tail)).otherwise(start).alias("start"), end.alias("end"), F.when(grows, F.substring(tail, 1, 1)).alias("base"))


def replace_near(texts: DataFrame) -> DataFrame:
    """Rows (text, needle, replacement, expected) with out: the occurrence of needle
    nearest to expected replaced, null if there is none or two are as near.

    The text is split before each occurrence, overlapping ones too, so the pieces'
    lengths add up to their places; a fold keeps the nearest and whether it is alone.
    """
    quoted = F.concat(F.lit("(?=\\Q"), F.replace("needle", F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E)"))
    pieces = F.split("text", quoted, -1)
    zero = F.struct(F.lit(0).alias("at"), F.lit(None).cast("int").alias("best"), F.lit(False).alias("tie"))

    def step(acc: Column, piece: Column) -> Column:
        here, old = F.abs(acc["at"] - F.col("expected")), F.abs(acc["best"] - F.col("expected"))
        hit = F.startswith(piece, F.col("needle"))
        better = hit & (acc["best"].isNull() | (here < old))
        return F.struct((acc["at"] + F.length(piece)).alias("at"), F.when(better, acc["at"]).otherwise(acc["best"]).alias("best"), F.when(better, F.lit(False)).otherwise(acc["tie"] | (hit & F.coalesce(here == old, F.lit(False)))).alias("tie"))

    near = F.aggregate(pieces, zero, step, lambda acc: F.when(~acc["tie"], acc["best"]))
    put = F.concat(F.substring("text", F.lit(1), F.col("_at")), "replacement", F.substring("text", F.col("_at") + F.length("needle") + 1, F.length("text")))
    return texts.withColumn("_at", F.when(F.col("needle") != "", near)).withColumn("out", put).drop("_at")


def suspicious(texts: DataFrame) -> DataFrame:
    """Spots (start, end, matched, reason) that look like recognition errors in the
    texts, a row each, with the correction of those that have a certain one."""
    rows = texts.select(*(c for c in texts.columns if c != "text"), F.explode(T.suspicious_spots(F.col("text"))).alias("s"))
    return rows.select(*(c for c in texts.columns if c != "text"), "s.start", "s.end", "s.matched", "s.reason", T.known_correction(F.col("s.matched"))["corrected"].alias("suggested"))


def right_to_left(proposals: DataFrame) -> DataFrame:
    """Proposals with turn: the order in which they can be put in without moving each other."""
    return proposals.withColumn("turn", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("start"))) - 1)


def all_proposals(rules: DataFrame, model: DataFrame) -> DataFrame:
    """Both sets in one order by document: those of rules first, then the model's."""
    both = rules.withColumn("_o", F.lit(0)).unionByName(model.withColumn("_o", F.lit(1)))
    return both.withColumn("ord", F.row_number().over(Window.partitionBy("doc_id").orderBy("_o", "start", "end", "change_id")) - 1).drop("_o")


def changed(raw: Column, corrected: Column, final: Column) -> Column:
    """Whether a page's corrected or final text differs from the raw one; one that is absent doesn't."""
    return F.coalesce(final != raw, F.lit(False)) | F.coalesce(corrected != raw, F.lit(False))


def source_revision(files: DataFrame) -> DataFrame:
    """source, revision of files(source, ord, label, text): the digest of the labelled
    files' digests in order, so no text is moved to another."""
    from .assemble import ordered_concat

    one = files.withColumn("_d", F.sha2(F.concat("label", F.lit("\n"), F.coalesce("text", F.lit(""))), 256))
    return one.groupBy("source").agg(F.sha2(ordered_concat("source", "ord", "_d", "|"), 256).alias("revision"))


def context(texts: DataFrame, spots: DataFrame, most: int = 10, around: int = 40) -> DataFrame:
    """The first ``most`` spots (doc_id, start, end) of each document with what surrounds them."""
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("start", "end"))
    rows = spots.withColumn("n", nth).where(F.col("n") <= most).join(texts.select("doc_id", "text"), "doc_id")
    low = F.greatest(F.lit(0), F.col("start") - around)
    return rows.select("doc_id", "n", "start", "end", F.substring("text", low + 1, F.col("end") + around - low).alias("context"))
