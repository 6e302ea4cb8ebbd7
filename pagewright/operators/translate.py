"""Segments for translation: batches, units, chunks, glossary and quality checks.

Sequential rules are folds over a document's own rows (``aggregate`` over a sorted
array), so documents stay independent and nothing leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagewright.functions import text as T
from pagewright.functions.arrow import exploded, first_grams


def packed_groups(segments: DataFrame, most_size: int = 5000, most_segments: int = 8) -> DataFrame:
    """doc_id, pos, batch of segments(doc_id, pos, size, group_id, status).

    Preserved and unresolved segments are passed over.  Consecutive segments of
    one group stay together; a batch closes before a group that would exceed
    either limit, so a longer group has a batch to itself.
    """
    rows = segments.where(~F.col("status").isin("preserved", "unresolved"))
    order = Window.partitionBy("doc_id").orderBy("pos")
    new = F.col("group_id").isNull() | ~F.coalesce(F.lag("group_id").over(order) == F.col("group_id"), F.lit(False))
    rows = rows.withColumn("_g", F.sum(new.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    groups = rows.groupBy("doc_id", "_g").agg(F.sum("size").alias("s"), F.count("*").alias("n"))
    zero = F.from_json(F.lit('{"batch":-1,"s":0,"n":0,"out":[]}'), "struct<batch:int,s:bigint,n:bigint,out:array<struct<g:bigint,batch:int>>>")

    def step(acc: Column, g: Column) -> Column:
        close = (acc["n"] == 0) | (acc["s"] + g["s"] > most_size) | (acc["n"] + g["n"] > most_segments)
        batch = F.when(close, acc["batch"] + 1).otherwise(acc["batch"])
        return F.struct(batch.alias("batch"), (F.when(close, 0).otherwise(acc["s"]) + g["s"]).alias("s"), (F.when(close, 0).otherwise(acc["n"]) + g["n"]).alias("n"), F.concat(acc["out"], F.array(F.struct(g["g"].alias("g"), batch.alias("batch")))).alias("out"))

    item = F.struct(F.col("_g").cast("bigint").alias("g"), F.col("s").cast("bigint").alias("s"), F.col("n").cast("bigint").alias("n"))
    placed = groups.groupBy("doc_id").agg(F.aggregate(F.array_sort(F.collect_list(item)), zero, step, lambda a: a["out"]).alias("o")).select("doc_id", F.explode("o").alias("o")).select("doc_id", F.col("o.g").alias("_g"), F.col("o.batch").alias("batch"))
    return rows.join(placed, ["doc_id", "_g"]).select("doc_id", "pos", "batch")


def packed_bytes(units: DataFrame, most_bytes: int = 5500, most_units: int = 25) -> DataFrame:
    """As ``packed_groups`` for units of their own, measured in UTF-8 bytes."""
    own = units.select("doc_id", "pos", F.octet_length("text").alias("size"), F.lit(None).cast("string").alias("group_id"), F.lit("pending").alias("status"))
    return packed_groups(own, most_bytes, most_units)


def assembled_units(segments: DataFrame, most_members: int = 8, most_size: int = 3500) -> DataFrame:
    """doc_id, unit, members, text, spans, rules: consecutive lines of one (page,
    series) read as one text, hyphens at line ends resolved."""
    order = Window.partitionBy("doc_id").orderBy("pos")
    rows = segments.withColumn("_new", ~F.coalesce((F.lag("page").over(order).eqNullSafe(F.col("page"))) & (F.lag("series").over(order) == F.col("series")), F.lit(False)))
    rows = rows.withColumn("_run", F.sum(F.col("_new").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))).where("series is not null")
    unit = "struct<pos:bigint,members:array<bigint>,size:int,text:string,spans:array<struct<start:int,end:int>>,rules:array<string>>"
    item = F.struct(F.col("pos").cast("bigint").alias("pos"), F.col("text").alias("text"))

    def step(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        fresh = F.struct(x["pos"].alias("pos"), F.array(x["pos"]).alias("members"), F.length(x["text"]).alias("size"), x["text"].alias("text"), F.array(F.struct(F.lit(0).alias("start"), F.length(x["text"]).alias("end"))).alias("spans"), F.array().cast("array<string>").alias("rules"))
        how = T.dehyphenation(last["text"], x["text"])
        joined = T.joined_lines(last["text"], x["text"])
        span = F.struct((F.length(joined) - F.length(x["text"])).alias("start"), F.length(joined).alias("end"))
        grown = F.struct(last["pos"].alias("pos"), F.concat(last["members"], F.array(x["pos"])).alias("members"), (last["size"] + F.length(x["text"])).alias("size"), joined.alias("text"), F.concat(last["spans"], F.array(span)).alias("spans"), F.concat(last["rules"], F.array(how["rule"])).alias("rules"))
        close = (F.size(acc) == 0) | (F.size(last["members"]) >= most_members) | (last["size"] + F.length(x["text"]) > most_size)
        return F.when(close, F.concat(acc, F.array(fresh))).otherwise(F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(grown)))

    runs = rows.groupBy("doc_id", "_run").agg(F.aggregate(F.array_sort(F.collect_list(item)), F.array().cast(f"array<{unit}>"), step).alias("u"))
    return runs.select("doc_id", F.explode("u").alias("u")).select("doc_id", F.col("u.pos").alias("unit"), F.col("u.members").alias("members"), F.col("u.text").alias("text"), F.col("u.spans").alias("spans"), F.col("u.rules").alias("rules"))


def text_chunks(docs: DataFrame, size: int = 1500, overlap: int = 200) -> DataFrame:
    """doc_id, chunk, start, end, prefix_overlap, text: whole lines up to ``size``
    characters, each chunk stepping back by about ``overlap``."""

    pieces = lambda text: [(i, s, e, p, text[s:e]) for i, (s, e, p) in enumerate(chunk_bounds(text, size, overlap))]
    return exploded(docs, "text", "chunk int, start int, end int, prefix_overlap int, text string", pieces)


def chunk_bounds(text: str, size: int, overlap: int) -> list[tuple[int, int, int]]:
    """(start, end, estimated overlap with the chunk before) of each chunk."""
    if len(text) <= size:
        return [(0, len(text), 0)] if text else []
    ends = [0]
    for line in text.splitlines(keepends=True):
        ends.append(ends[-1] + len(line))
    n, first, out = len(ends) - 1, 0, []
    while True:
        last = next((k for k in range(first, n) if ends[k + 1] - ends[first] >= size), n - 1)
        lines = last - first + 1
        guess = ends[first + max(1, lines // 4)] - ends[first] if out and lines > 1 else 0
        out.append((ends[first], ends[last + 1], guess))
        if last == n - 1:
            return out
        back = next((k for k in range(last, first, -1) if ends[last + 1] - ends[k] >= overlap), first + 1)
        first = max(first + 1, back)


def rejoined(chunks: DataFrame) -> DataFrame:
    """doc_id, text of chunks: what each adds beyond the one before it."""
    from .assemble import ordered_concat

    order = Window.partitionBy("doc_id").orderBy("start")
    done = F.coalesce(F.lag("end").over(order), F.lit(0))
    rows = chunks.withColumn("_t", F.substring("text", F.greatest(F.lit(0), done - F.col("start")) + 1, F.length("text")))
    return rows.groupBy("doc_id").agg(ordered_concat("doc_id", "start", "_t", "").alias("text"))


def detected_language(segments: DataFrame) -> DataFrame:
    """doc_id, language, confidence from the first 100,000 characters of the segments joined by blanks."""
    from .assemble import ordered_concat

    joined = segments.groupBy("doc_id").agg(F.substring(ordered_concat("doc_id", "pos", "text", " "), 1, 100_000).alias("t"))
    name, share = T.main_script(*T.script_counts(F.col("t")))
    return joined.select("doc_id", name.alias("language"), share.alias("confidence"))


def token_changes(pairs: DataFrame, kinds=tuple(T.CRITICAL)) -> DataFrame:
    """pair_id, kind, token, missing, unexpected: how often a critical token of the source is short in the target, and beyond it."""
    def side(column: str, sign: int) -> DataFrame:
        return pairs.select("pair_id", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), T.critical(F.col(column), k).alias("v")) for k in kinds))).alias("x")).select("pair_id", "x.kind", F.explode("x.v").alias("token"), F.lit(sign).alias("n"))

    both = side("source", 1).unionByName(side("target", -1)).groupBy("pair_id", "kind", "token").agg(F.sum("n").alias("n")).where("n <> 0")
    return both.select("pair_id", "kind", "token", F.greatest("n", F.lit(0)).alias("missing"), F.greatest(-F.col("n"), F.lit(0)).alias("unexpected"))


#: Up to so many first grams of a glossary's terms, each is looked for in every text.
FEW_GRAMS = 100


def term_states(pairs: DataFrame, glossary: DataFrame) -> DataFrame:
    """pair_id, term, expected, state for glossary terms that the source holds.

    A containment join has no key, so texts meet terms by the trigrams (or shorter
    whole terms) that these begin with, an equi-join for a glossary of any length.
    """
    low = lambda c, own: F.when(F.col("case_sensitive"), c).otherwise(F.lower(c)) if own else c
    holds = F.contains(F.when(F.col("case_sensitive"), F.col("source")).otherwise(F.lower("source")), F.when(F.col("case_sensitive"), F.col("term")).otherwise(F.lower("term")))
    g = glossary.withColumnRenamed("source", "term").withColumnRenamed("target", "wanted")
    gram = F.substring(F.lower("term"), 1, 3)
    own = F.lower("source")
    # a short list of grams is looked for in each text, a long one meets the text's own grams
    every = g.where("term <> ''").agg(F.collect_set(gram).alias("_every"))
    few = F.size("_every") <= FEW_GRAMS
    grams = F.when(few, F.filter("_every", lambda x: F.contains(F.col("_own"), x))).otherwise(F.array_intersect("_every", first_grams(F.when(~few, F.col("_own")))))
    texts = pairs.select("pair_id", own.alias("_own")).crossJoin(F.broadcast(every))
    # only ids and grams are multiplied; a text comes back for the few terms that may be in it
    may = texts.select("pair_id", F.explode(grams).alias("_g")).join(g.withColumn("_g", gram), "_g").drop("_g")
    rows = pairs.join(may, "pair_id").where(holds)
    expected = F.when(F.col("do_not_translate"), F.col("term")).otherwise(F.col("wanted"))
    present = F.contains(low(F.col("target"), True), low(expected, True))
    return rows.select("pair_id", "term", expected.alias("expected"), F.when(present, F.col("mode")).otherwise("missing").alias("state"))


def glossary_errors(entries: DataFrame, source_language: str = "auto", target_language: str = "auto") -> DataFrame:
    """entries with errors: an array of the rules they break."""
    own = F.when(F.col("case_sensitive"), F.col("source")).otherwise(F.lower("source"))
    twice = F.row_number().over(Window.partitionBy("set_id", own).orderBy("ord")) > 1
    rules = (
        (F.trim("source") == "", "empty_source"),
        (~F.col("do_not_translate") & (F.trim("target") == ""), "empty_target"),
        (~F.col("mode").isin("translated", "preserved", "transliterated"), "mode"),
        (F.col("do_not_translate") & (F.col("mode") != "preserved"), "preserve_mode"),
        (~T.term_fits_language(F.col("source"), source_language), "source_language"),
        (~F.col("do_not_translate") & ~T.term_fits_language(F.col("target"), target_language), "target_language"),
        (twice, "duplicate"),
    )
    return entries.withColumn("errors", F.array_compact(F.array(*(F.when(c, F.lit(n)) for c, n in rules))))


def carried_over(new: DataFrame, old: DataFrame) -> DataFrame:
    """New segments with the manual edit of the old one of the same id and source text."""
    edits = old.where("manual_edited").select("doc_id", "id", F.col("source_text").alias("_s"), F.col("final_text").alias("_f"))
    got = new.join(edits, ["doc_id", "id"], "left")
    same = F.col("_s") == F.col("source_text")
    return got.withColumn("final_text", F.when(same, F.col("_f")).otherwise(F.col("final_text"))).withColumn("carried", F.coalesce(same, F.lit(False))).drop("_s", "_f")


def resumed(new: DataFrame, saved: DataFrame) -> DataFrame:
    """New segments, those done before with an unchanged text taken as they were saved."""
    done = saved.where(F.col("status").isin("translated", "final", "preserved", "flagged")).select("doc_id", "id", F.col("source_text").alias("_s"), F.col("translated_text").alias("_t"), F.col("status").alias("_st"))
    got = new.join(done, ["doc_id", "id"], "left")
    same = F.coalesce(F.col("_s") == F.col("source_text"), F.lit(False))
    return got.withColumn("translated_text", F.when(same, F.col("_t")).otherwise(F.col("translated_text"))).withColumn("status", F.when(same, F.col("_st")).otherwise(F.col("status"))).drop("_s", "_t", "_st")


def answer_parity(asked: DataFrame, answered: DataFrame) -> DataFrame:
    """batch, ok: whether the answer has just the ids asked, each once, in order."""
    both = asked.select("batch", "pos", F.col("id").alias("a")).join(answered.select("batch", "pos", F.col("id").alias("b")), ["batch", "pos"], "full")
    return both.groupBy("batch").agg(F.bool_and(F.coalesce(F.col("a") == F.col("b"), F.lit(False))).alias("ok"))


def unit_status(members: DataFrame) -> DataFrame:
    """doc_id, unit, status of members(status, manual_edited): flagged, then manual, then done, else queued; and distinct warnings in first-seen order."""
    status = F.when(F.bool_or(F.col("status") == "flagged"), "flagged").when(F.bool_or("manual_edited"), "manual_final").when(F.bool_and(F.col("status").isin("translated", "final", "preserved")), "translated").otherwise("queued")
    warnings = F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "warnings"))), lambda x: x["warnings"])))
    return members.groupBy("doc_id", "unit").agg(status.alias("status"), warnings.alias("warnings"))


def cost(segments: DataFrame, price: float, hybrid: bool = False) -> DataFrame:
    """doc_id, chars, cost: what translating the segments that aren't preserved would cost by the million."""
    n = F.sum(F.when(F.col("status") != "preserved", F.length("text")).otherwise(0)) * (2 if hybrid else 1)
    return segments.groupBy("doc_id").agg(n.alias("chars"), F.bround(n / 1e6 * price, 6).alias("cost"))


def rendered(tokens: DataFrame, segments: DataFrame) -> DataFrame:
    """doc_id, html: raw tokens as they are, segments as escaped output between their blanks."""
    from .assemble import ordered_concat

    texts = segments.select(F.col("doc_id").alias("_d"), F.col("id").alias("_id"), T.output_text(F.col("final_text"), F.col("translated_text"), F.col("source_text")).alias("_t"))
    got = tokens.select("doc_id", "pos", "kind", "value", "id", "leading", "trailing").join(texts, (F.col("doc_id") == F.col("_d")) & (F.col("id") == F.col("_id")), "left")
    part = F.when(F.col("kind") == "raw", F.col("value")).otherwise(F.concat(F.col("leading"), T.escape_html(F.col("_t")), F.col("trailing")))
    return got.withColumn("_p", part).groupBy("doc_id").agg(ordered_concat("doc_id", "pos", "_p", "").alias("html"))


def protected_terms(text: Column, glossary) -> Column:
    """array<struct<term, meant, exact>>: what a translator must not touch in a text.

    ``glossary``: (source, target, case_sensitive, do_not_translate) entries, each
    with both of its forms; and the text's critical tokens as they are.
    """
    entries = {(form, source if keep else target, exact) for source, target, exact, keep in glossary for form in (source, source if keep else target) if form}
    one = lambda term, meant, exact: F.struct(term.alias("term"), meant.alias("meant"), exact.alias("exact"))
    fixed = F.array(*(one(F.lit(t), F.lit(m), F.lit(e)) for t, m, e in sorted(entries)))
    critical = F.array_distinct(F.flatten(F.array(*(T.critical(text, k) for k in T.CRITICAL))))
    return F.concat(fixed, F.transform(critical, lambda t: one(t, t, F.lit(True))))


def translation_warnings(pairs: DataFrame, glossary: DataFrame, language: str, kinds=tuple(T.CRITICAL)) -> DataFrame:
    """pair_id, warnings of pairs(pair_id, source, target): critical tokens that are
    short or beyond the source's (five of a kind are named), glossary terms that are
    missing, and a target in the wrong script; an empty array where all is well."""
    tokens = token_changes(pairs, kinds)
    named = lambda c: F.concat_ws(", ", F.slice(F.flatten(F.array_sort(F.collect_list(F.array_repeat("token", F.col(c).cast("int"))))), 1, 5))
    by = tokens.groupBy("pair_id", "kind").agg(named("missing").alias("m"), named("unexpected").alias("u"), F.sum("missing").alias("nm"), F.sum("unexpected").alias("nu"))
    note = lambda rank, text: F.struct(rank.alias("rank"), text.alias("text"))
    rank = F.array_position(F.array(*map(F.lit, kinds)), F.col("kind")) * 2
    of_tokens = by.select("pair_id", F.explode(F.array_compact(F.array(F.when(F.col("nm") > 0, note(rank, F.concat(F.lit("critical_"), "kind", F.lit("_changed: "), "m"))), F.when(F.col("nu") > 0, note(rank + 1, F.concat(F.lit("critical_"), "kind", F.lit("_unexpected: "), "u")))))).alias("w"))
    of_terms = term_states(pairs, glossary).where("state = 'missing'").select("pair_id", note(F.lit(1000).cast("long"), F.concat(F.lit("glossary_term_changed: "), "term")).alias("w"))
    of_script = pairs.where(T.target_script_missing(F.col("source"), F.col("target"), language)).select("pair_id", note(F.lit(2000).cast("long"), F.lit("target_language_mismatch")).alias("w"))
    found = of_tokens.unionByName(of_terms).unionByName(of_script).groupBy("pair_id").agg(F.transform(F.array_sort(F.collect_list("w")), lambda w: w["text"]).alias("warnings"))
    return pairs.select("pair_id").join(found, "pair_id", "left").withColumn("warnings", F.coalesce("warnings", F.array().cast("array<string>")))


def validator_metrics(segments: DataFrame) -> DataFrame:
    """doc_id, total, flagged, status, kinds of segments(doc_id, status, warnings): a
    document with a flagged segment is partial, else completed; kinds: what its
    warnings begin with, each once, in order."""
    flagged = F.col("status").isin("flagged_for_human_review", "unresolved") | (F.size(F.coalesce("warnings", F.array().cast("array<string>"))) > 0)
    kinds = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.transform(F.coalesce("warnings", F.array().cast("array<string>")), lambda w: F.substring_index(w, ":", 1))))))
    by = segments.groupBy("doc_id").agg(F.count("*").alias("total"), F.count_if(flagged).alias("flagged"), kinds.alias("kinds"))
    return by.withColumn("status", F.when(F.col("flagged") > 0, "partial").otherwise("completed"))


def translation_saved(models: DataFrame, segments: DataFrame, edits: DataFrame, glossary: DataFrame, language: str, kinds=tuple(T.CRITICAL)) -> tuple[DataFrame, DataFrame]:
    """Manual finals put into translations, all edits of a document or none.

    models(doc_id, revision, stale), segments(doc_id, id, source_text, final_text,
    status, warnings), edits(doc_id, id, text, base_revision).  First: doc_id,
    outcome (the first of not_found, source_changed, revision_conflict,
    unknown_segment, unresolved_segment, else saved), total, flagged, status and
    published, which only a document without flagged segments is.  Second: the
    segments afterwards; those edited are judged anew.
    """
    there = segments.select("doc_id", "id", F.col("status").alias("_s"), "source_text")
    got = edits.join(models, "doc_id", "left").join(there, ["doc_id", "id"], "left")
    faults = ((F.col("revision").isNull(), "1 not_found"), (F.col("stale"), "2 source_changed"), (F.col("base_revision") != F.col("revision"), "3 revision_conflict"), (F.col("_s").isNull(), "4 unknown_segment"), (F.col("_s") == "unresolved", "5 unresolved_segment"))
    fault = F.coalesce(*(F.when(c, F.lit(n)) for c, n in faults), F.lit("6 saved"))
    outcome = got.groupBy("doc_id").agg(F.substring(F.min(fault), 3, 40).alias("outcome"))
    good = got.join(outcome.where("outcome = 'saved'"), "doc_id", "left_semi").select("doc_id", "id", F.col("text").alias("_t"), "source_text")
    key = F.to_json(F.struct("doc_id", "id"))
    warned = translation_warnings(good.select(key.alias("pair_id"), F.col("source_text").alias("source"), F.col("_t").alias("target")), glossary, language, kinds)
    good = good.drop("source_text").withColumn("pair_id", key).join(warned.withColumnRenamed("warnings", "_w"), "pair_id", "left").drop("pair_id")
    after = segments.join(good, ["doc_id", "id"], "left")
    new = F.col("_t").isNotNull()
    after = after.withColumn("final_text", F.when(new, F.col("_t")).otherwise(F.col("final_text"))).withColumn("status", F.when(new, "manual-final").otherwise(F.col("status"))).withColumn("warnings", F.when(new, F.col("_w")).otherwise(F.col("warnings"))).withColumn("manual_edited", new).drop("_t", "_w")
    metrics = validator_metrics(after.join(outcome.where("outcome = 'saved'"), "doc_id", "left_semi")).select("doc_id", "total", "flagged", "status")
    return outcome.join(metrics, "doc_id", "left").withColumn("published", F.coalesce(F.col("flagged") == 0, F.lit(False))), after
