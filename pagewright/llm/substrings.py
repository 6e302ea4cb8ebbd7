"""Repeated substrings removed by suffix arrays of shared passages.

A byte goes where a string of ``LENGTH`` bytes covers it that also starts in a
document with a smaller id.  Every string of that length is filed under one
anchor, the 20-byte gram of it with the smallest hash (the leftmost of equals).
Equal strings have equal anchors, so all that can match meets under one anchor.

1. Whole copies of a smaller document's text go at once.  One pass deals the
   anchors of all documents into buckets of hashes, packed, and each bucket names
   the anchors that more than one document has.
2. Neighbouring strings of a document under one such anchor are a run; its bytes are
   the run's content.  Equal contents are aggregated to the smallest and the
   largest document that hold them, those of frequent anchors before any shuffle.
3. The distinct contents, dealt by anchor, are concatenated to texts of about
   ``TEXT`` bytes, and each text gets its suffix array by two-stage sorting: the
   suffixes that are smaller than their successors are sorted directly, the others
   are induced from them by scans over the buckets of first bytes.  Common
   prefixes of neighbours then show which strings are equal, and the smallest
   document of each group of equal strings which of them go.
4. Contents under an anchor with more than ``CROWD`` distinct ones (the edges of a
   passage that very many documents share) are cut into their strings, and each
   string is dealt by its own hash; so no anchor is gathered in one place.
5. What goes is joined back to the runs, and the runs' ranges to the documents.

Only strings that start in a content count, never those that would cross from one
content into the next.  Suffixes are ordered by their first 56 bytes, enough for
strings of 50.

Defined cases: a null text is an empty one and loses nothing; a null id neither
loses nor takes anything; rows that repeat an id don't take from each other, with
equal or different texts; texts shorter than a string lose nothing; ties (equal
strings in one document) stay; a very long text is read in segments; other columns
are ignored, whatever they are called, and ``without_repeats`` returns them; an
empty table gives an empty result.
"""

from __future__ import annotations

import gc
import time
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, documents_only, materialize, mix64, slices, trim, utf8

LENGTH = 50
GRAM = 20
#: Grams of a string; their minimum is its anchor.
WINDOW = LENGTH - GRAM + 1
#: Strings of a run at most, and strings of a document looked at in one go.
RUN, SEGMENT = 64, 1 << 17
#: Anchors of a bucket, about; distinct contents of an anchor from which it is crowded.
BUCKET, CROWD = 1 << 20, 4096
#: Bytes of contents that are suffix-sorted together, about.
TEXT = 1 << 21

_RANDOM = np.random.default_rng(50).integers(0, 1 << 32, 256, dtype=np.uint32)
_M1, _M2 = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B)
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def _gram_hashes(raw: np.ndarray) -> np.ndarray:
    """32-bit hashes of all grams: hashes of 2, 4, 8, 16 and then GRAM bytes."""
    x = _RANDOM[raw]
    for step in (1, 2, 4, 8, GRAM - 16):
        y = x[:-step] * _M1
        y ^= y >> np.uint32(15)
        y += x[step:]
        y *= _M2
        y ^= y >> np.uint32(13)
        x = y
    return x


def _anchors(raw: np.ndarray) -> np.ndarray:
    """For each string of ``raw`` where its anchor begins."""
    x = _gram_hashes(raw).astype(np.uint64) << np.uint64(32)
    x |= np.arange(len(x), dtype=np.uint64)
    have = 1
    while have < WINDOW:
        step = min(have, WINDOW - have)
        x = np.minimum(x[:-step], x[step:])
        have += step
    return x.astype(np.uint32)  # the low half


class Runs(NamedTuple):
    """Runs of the texts of a slice: the text's number, the first string's place in it,
    the strings, the key, and where the first string is in ``raw``."""

    text: np.ndarray
    first: np.ndarray
    n: np.ndarray
    key: np.ndarray
    at: np.ndarray
    raw: np.ndarray


def segments(texts: list[bytes]) -> Iterator[list[tuple[int, int, bytes]]]:
    """Texts in lots of about SEGMENT bytes, as (number, place, part); a longer text is
    cut into parts that overlap by a string less one byte."""
    held: list[tuple[int, int, bytes]] = []
    size = 0
    for i, text in enumerate(texts):
        for base in range(0, max(1, len(text) - LENGTH + 1), SEGMENT):
            part = text[base : base + SEGMENT + LENGTH - 1]
            if held and size + len(part) > SEGMENT:
                yield held
                held, size = [], 0
            held.append((i, base, part))
            size += len(part)
    if held:
        yield held


def runs(texts: list[bytes]) -> Iterator[Runs]:
    """The runs of texts, lot by lot."""
    for lot in segments(texts):
        raw = np.frombuffer(b"".join(p for *_, p in lot), np.uint8)
        if len(raw) < LENGTH:
            continue
        at = _anchors(raw)
        sizes = np.array([len(p) for *_, p in lot])
        ends = np.cumsum(sizes)
        owner = np.repeat(np.arange(len(lot)), sizes)[: len(at)]
        inside = np.arange(len(at)) + LENGTH <= ends[owner]  # no string crosses into the next text
        edge = np.ones(len(at), bool)
        apart = (owner[1:] != owner[:-1]) | (inside[1:] != inside[:-1])
        np.logical_or(at[1:] != at[:-1], apart, out=edge[1:])
        first = np.flatnonzero(edge)
        words = np.lib.stride_tricks.sliding_window_view(raw, GRAM)[at[first]].view(np.uint32).astype(np.uint64)
        key = np.zeros(len(first), np.uint64)
        for k in range(GRAM // 4):
            key = mix64(key * _PRIME + words[:, k])
        new = np.ones(len(first), bool)  # a gram that repeats at once goes on
        np.logical_or(key[1:] != key[:-1], apart[first[1:] - 1], out=new[1:])
        first, key = first[new], key[new]
        n = np.diff(np.append(first, len(at)))
        keep = inside[first]
        first, key, n = first[keep], key[keep], n[keep]
        if len(n) and n.max() > RUN:
            parts = -(-n // RUN)
            inner = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            first, key, n = np.repeat(first, parts) + RUN * inner, np.repeat(key, parts), np.minimum(np.repeat(n, parts) - RUN * inner, RUN)
        number, base = np.array([i for i, *_ in lot]), np.array([b for _, b, _ in lot])
        own = owner[first]
        yield Runs(number[own], first - (ends - sizes)[own] + base[own], n, key, first, raw)


def _place(key: np.ndarray, bits: int) -> np.ndarray:
    """Bucket and 32 bits of the key within it, as one number.  Buckets grow with the
    input, so different grams that share a number are equally rare at every size."""
    bucket = key >> np.uint64(64 - bits) if bits else np.zeros(len(key), np.uint64)
    return (bucket << np.uint64(32)) | (key & np.uint64(0xFFFFFFFF))


def _dealt(bits: int):
    """bucket, h, docs: the anchors of a slice of documents, packed by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            ids = np.array(batch.column(0).to_pylist(), np.int64)
            found = [(_place(r.key, bits), ids[r.text]) for r in runs(utf8(batch.column(1)))]
            if not found:
                continue
            place, doc = (np.concatenate(x) for x in zip(*found, strict=True))
            bucket = (place >> np.uint64(32)).astype(np.uint32)
            order = np.argsort(bucket, kind="stable")
            bucket, h, doc = bucket[order], place[order].astype(np.uint32), doc[order]
            at = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
            ends = np.concatenate((at[1:], [len(bucket)]))
            spans = list(zip(at.tolist(), ends.tolist(), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(bucket[at].astype(np.int64)), pa.array([h[a:b].tobytes() for a, b in spans], pa.binary()), pa.array([doc[a:b].tobytes() for a, b in spans], pa.binary())], ["bucket", "h", "docs"])

    return run


def _shared(crowd: int):
    """doc, places: of a bucket, for each document the anchors that others have too;
    the lowest bit tells whether one occurs ``crowd`` times or more."""

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        h = np.frombuffer(b"".join(table.column("h").to_pylist()), np.uint32)
        doc = np.frombuffer(b"".join(table.column("docs").to_pylist()), np.int64)
        order = np.argsort(h, kind="stable")
        h, doc = h[order], doc[order]
        at = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        n = np.diff(np.concatenate((at, [len(h)])))
        several = np.minimum.reduceat(doc, at) < np.maximum.reduceat(doc, at)
        keep = np.repeat(several, n)
        place = (((np.uint64(bucket) << np.uint64(32)) | h[keep].astype(np.uint64)) << np.uint64(1)) | np.repeat(n >= crowd, n)[keep]
        doc = doc[keep]
        order = np.argsort(doc, kind="stable")
        doc, place = doc[order], place[order]
        at = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1]))) if len(doc) else np.zeros(0, np.int64)
        ends = np.concatenate((at[1:], [len(doc)]))
        return pa.table({"doc": pa.array(doc[at]), "places": pa.array([place[a:b].tobytes() for a, b in zip(at.tolist(), ends.tolist(), strict=True)] if len(at) else [], pa.binary())})

    return run


def _candidates(bits: int):
    """doc, th, at, m, busy, content: the runs of documents under anchors that others have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            doc, th = (np.array(batch.column(k).to_pylist(), np.int64) for k in (0, 2))
            # an anchor that one document shares is shared by each that has it, so the slice's are taken together
            wanted = np.unique(np.frombuffer(b"".join(x for xs in batch.column(3).to_pylist() for x in xs), np.uint64))
            known = wanted >> np.uint64(1)
            for r in runs(utf8(batch.column(1))):
                place = _place(r.key, bits)
                at = np.minimum(np.searchsorted(known, place), len(known) - 1)
                hit = np.flatnonzero(known[at] == place)
                content = binaries(r.raw, r.at[hit], r.n[hit] + LENGTH - 1)
                own = r.text[hit]
                busy = (wanted[at[hit]] & np.uint64(1)).astype(bool)
                yield pa.RecordBatch.from_arrays([pa.array(doc[own]), pa.array(th[own]), pa.array(r.first[hit].astype(np.int32)), pa.array(r.key[hit].view(np.int64)), pa.array(busy), content], ["doc", "th", "at", "m", "busy", "content"])

    return run


def gathered(raw: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of ``raw`` from ``at`` on, ``size`` of each, one after another, and where each begins and the last ends."""
    ends = np.concatenate(([0], np.cumsum(size)))
    return raw[np.repeat(at - ends[:-1], size) + np.arange(ends[-1])], ends


def binaries(raw: np.ndarray, at: np.ndarray, size: np.ndarray) -> pa.Array:
    data, ends = gathered(raw, at, size)
    return pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])


def _words(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The first 56 bytes of the suffixes ``at`` as seven numbers that sort like them."""
    padded = np.concatenate((text, np.zeros(56, np.uint8)))
    return np.lib.stride_tricks.sliding_window_view(padded, 56)[at].view(">u8").astype(np.uint64)


def suffix_order(text: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The suffixes of ``text`` marked in ``wanted``, sorted by 56 bytes or more, in two stages.

    A suffix that is smaller than its successor is sorted directly.  One that is
    larger follows from its successor: within the bucket of its first byte such
    suffixes come first, in the order of their successors, which all stand in
    earlier places of the scan.  So besides those wanted only the successors of
    larger ones are sorted, up to the next smaller one.
    """
    n = len(text)
    turn = np.flatnonzero(text[1:] != text[:-1])  # the last places of runs of one byte
    smaller = np.zeros(n, bool)
    smaller[: turn[-1] + 1 if len(turn) else 0] = np.repeat(text[turn + 1] > text[turn], np.diff(np.concatenate(([-1], turn))))
    # a larger suffix needs its successor: from each wanted place on to the next smaller one, that included
    place = np.arange(n)
    stops = np.flatnonzero(smaller)
    at = np.flatnonzero(wanted & ~smaller)
    i = np.searchsorted(stops, at)
    ends = np.append(stops, n - 1)[i]
    cover = np.zeros(n + 1, np.int32)
    np.add.at(cover, at, 1)
    np.add.at(cover, ends + 1, -1)
    needed = wanted | (np.cumsum(cover[:-1]) > 0)

    direct = place[needed & smaller]
    words = _words(text, direct)
    direct = direct[np.lexsort(words.T[::-1])]
    del words
    edge = np.searchsorted(text[direct], np.arange(257))
    larger = needed & ~smaller
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    if larger[n - 1]:  # the end of the text is smaller than any suffix
        waiting[text[n - 1]].append(np.array([n - 1]))
    out: list[np.ndarray] = []
    for c in range(256):
        part = waiting[c]
        fresh = np.concatenate(part) if part else None
        while fresh is not None and len(fresh):  # runs of the byte itself
            before = fresh[fresh > 0] - 1
            fresh = before[larger[before] & (text[before] == c)]
            part.append(fresh)
        part.append(direct[edge[c] : edge[c + 1]])
        whole = np.concatenate(part)
        if not len(whole):
            continue
        out.append(whole)
        before = whole[whole > 0] - 1
        before = before[larger[before] & (text[before] > c)]
        head = text[before]
        order = np.argsort(head, kind="stable")
        before, head = before[order], head[order]
        for one in np.split(before, np.flatnonzero(head[1:] != head[:-1]) + 1) if len(head) else ():
            waiting[text[one[0]]].append(one)
    order = np.concatenate(out)
    return order[wanted[order]]


def common_prefixes(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Bytes, 56 at most, that each suffix of ``order`` shares with the one before it; 0 for the first."""
    words = _words(text, order)
    differ = words[1:] ^ words[:-1]
    first = (differ != 0).argmax(axis=1)
    x = differ[np.arange(len(differ)), first]
    same = np.zeros(len(x), np.int64)
    for k in range(1, 9):
        same += (x >> np.uint64(64 - 8 * k)) == 0
    return np.concatenate(([0], np.where(x == 0, 56, 8 * first + same)))


def judged(text: np.ndarray, sizes: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What goes of contents that stand one after another in ``text``: the number of the
    content, the first and the end of the places where a string starts that a content of
    a smaller document has, too; in order."""
    start = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(sizes)), sizes)
    wanted = np.arange(len(text)) + LENGTH <= np.repeat(start + sizes, sizes)
    order = suffix_order(text, wanted)
    group = np.flatnonzero(common_prefixes(text, order) < LENGTH)
    own = docs[owner[order]]
    least = np.repeat(np.minimum.reduceat(own, group), np.diff(np.append(group, len(order))))
    gone = np.sort(order[least < own])
    new = np.ones(len(gone), bool)
    new[1:] = (np.diff(gone) > 1) | (owner[gone[1:]] != owner[gone[:-1]])
    at = np.flatnonzero(new)
    whose = owner[gone[at]]
    last = gone[np.append(at[1:], len(gone)) - 1] if len(gone) else gone
    return whose, gone[at] - start[whose], last - start[whose] + 1


def _judged_rows(rows: pa.Table) -> pa.RecordBatch:
    """m, d, lo, hi, gone of the rows (key, m, d, off, lo, hi, content) of whole keys, in order."""
    key, off, lo = (rows.column(c).to_numpy() for c in ("key", "off", "lo"))
    content = rows.column("content").chunk(0)
    ends = np.frombuffer(content.buffers()[1], np.int32)[content.offset : content.offset + len(content) + 1].astype(np.int64)
    raw = np.frombuffer(content.buffers()[2], np.uint8) if content.buffers()[2] else np.zeros(0, np.uint8)
    same = key[1:] == key[:-1]
    several = np.flatnonzero(np.append(same, False) | np.append(False, same))  # the only content of a key has no string of another
    n, gone = np.zeros(len(key), np.int64), np.zeros(0, np.int32)
    if len(several):
        sizes = (ends[1:] - ends[:-1])[several]
        whose, first, end = judged(gathered(raw, ends[:-1][several], sizes)[0], sizes, lo[several])
        whose = several[whose]
        n = 2 * np.bincount(whose, minlength=len(key))
        gone = np.stack((first + off[whose], end + off[whose]), axis=1).ravel().astype(np.int32)
    told = pa.array((n > 0) | rows.column("hi").is_valid().to_numpy())
    ranges = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32)), pa.array(gone))
    trim()
    return pa.RecordBatch.from_arrays([*(rows.column(c).chunk(0) for c in ("m", "d", "lo", "hi")), ranges], ["m", "d", "lo", "hi", "gone"]).filter(told)


def _sorted_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """m, d, lo, hi, gone: contents that something goes of; rows of a key come together."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.column(6).nbytes
        if size < TEXT:
            continue
        rows = pa.Table.from_batches(held).combine_chunks()
        key = rows.column("key").to_numpy()
        cut = int(np.searchsorted(key, key[-1]))  # the last key may go on
        if cut:
            yield _judged_rows(rows.slice(0, cut).combine_chunks())
        held = rows.slice(cut).combine_chunks().to_batches()
        size = sum(b.column(6).nbytes for b in held) if cut else 0  # a key larger than a text is looked at again when it has doubled
    if held and sum(b.num_rows for b in held):
        yield _judged_rows(pa.Table.from_batches(held).combine_chunks())


def _sums(texts: DataFrame) -> DataFrame:
    """doc_id, th, n, lo of each row: hash and bytes of its text, and the smallest document that has it."""
    rows = texts.select("doc_id", "th", F.octet_length("text").alias("n"), F.sha2("text", 256).alias("sum"))
    least = rows.groupBy("sum").agg(F.min("doc_id").alias("lo"))
    return materialize(rows.join(least, "sum").select("doc_id", "th", "n", "lo"), "sums")


def _runs(texts: DataFrame, sums: DataFrame, crowd: int) -> DataFrame:
    """doc, th, at, m, busy, content: the runs under anchors that several documents have."""
    size = sums.agg(F.sum("n")).first()[0] or 0
    bits = max(int(size * 2 / (WINDOW + 1)) // BUCKET, 2 * int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))).bit_length()
    dealt = texts.select("doc_id", "text").mapInArrow(_dealt(bits), "bucket long, h binary, docs binary")
    shared = dealt.groupBy("bucket").applyInArrow(_shared(crowd), "doc long, places binary")
    # whole copies go without a look inside
    first = sums.groupBy("doc_id").agg(F.max("lo").alias("lo")).where("lo = doc_id").select("doc_id")
    asked = shared.groupBy(F.col("doc").alias("doc_id")).agg(F.collect_list("places").alias("places")).join(first, "doc_id")
    some = texts.join(asked, "doc_id").select("doc_id", "text", "th", "places")
    found = some.mapInArrow(_candidates(bits), "doc long, th long, at int, m long, busy boolean, content binary")
    return materialize(found, "runs")


def _gone(found: DataFrame, crowd: int) -> DataFrame:
    """m, d, lo, hi, gone: for contents (d: their hash) that something goes of, their
    smallest document, their largest if it is another, and the places whose strings a
    smaller one has."""

    def distinct(runs: DataFrame) -> DataFrame:
        rows = runs.groupBy("m", "content").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"))
        return rows.withColumn("hi", F.when(F.col("hi") > F.col("lo"), F.col("hi"))).withColumn("d", F.xxhash64("content"))

    def judged_by_key(rows: DataFrame) -> DataFrame:
        return rows.select("key", "m", "d", "off", "lo", "hi", "content").sortWithinPartitions("key").mapInArrow(_sorted_texts, "m long, d long, lo long, hi long, gone array<int>")

    # dealt once, by anchor, which has few runs; equal contents meet there
    few = distinct(found.where("not busy").select("m", "content", "doc").repartition("m")).withColumns({"key": F.col("m"), "off": F.lit(0)})
    # aggregated where they are before they are dealt by content, then by anchor or string
    many = distinct(found.where("busy"))
    crowded = many.groupBy("m").count().where(F.col("count") > crowd).select("m", F.lit(True).alias("crowded"))
    many = many.join(crowded, "m", "left")
    offs = F.when(F.col("crowded"), F.sequence(F.lit(0), F.octet_length("content") - LENGTH)).otherwise(F.array(F.lit(0)))
    many = many.withColumn("off", F.explode(offs)).withColumn("content", F.when(F.col("crowded"), F.substring("content", F.col("off") + 1, F.lit(LENGTH))).otherwise(F.col("content")))
    many = many.withColumn("key", F.when(F.col("crowded"), F.xxhash64("content")).otherwise(F.col("m"))).withColumn("hi", F.when(F.col("off") == 0, F.col("hi")))  # told once
    return materialize(judged_by_key(few).unionByName(judged_by_key(many.repartition("key"))), "gone")


def _ranges_of(found: DataFrame, gone: DataFrame) -> DataFrame:
    runs_ = found.select("doc", "th", "at", "m", F.xxhash64("content").alias("d"), F.octet_length("content").alias("n"))
    met = runs_.join(gone, ["m", "d"]).where((F.col("doc") == F.col("lo")) & (F.size("gone") > 0) | (F.col("doc") > F.col("lo")) & F.col("hi").isNotNull())
    # a string's range ends LENGTH - 1 bytes after the last place where one starts
    inner = F.transform("gone", lambda x, i: x + F.col("at") + F.when(i % 2 == 1, LENGTH - 1).otherwise(0))
    met = met.select(F.col("doc").alias("doc_id"), "th", F.when(F.col("doc") == F.col("lo"), inner).otherwise(F.array("at", F.col("at") + F.col("n"))).alias("r"))
    return materialize(met.groupBy("doc_id", "th").agg(F.flatten(F.collect_list("r")).alias("ranges")), "ranges")


def repeated_ranges(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """doc_id, th (hash of the text), ranges (first, end, first, end ... in bytes, in
    any order, overlapping): what goes of each document that loses anything."""
    spark = docs.sparkSession
    texts = documents_only(docs).where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= LENGTH)).withColumn("th", F.xxhash64("text"))
    sums = _sums(texts)
    found = _runs(texts, sums, crowd)
    free_shuffles(spark)
    gone = _gone(found, crowd)
    free_shuffles(spark)
    out = _ranges_of(found, gone)
    discard(found, gone)
    free_shuffles(spark)
    copies = sums.where("lo < doc_id").select("doc_id", "th", F.array(F.lit(0), "n").alias("ranges")).distinct()
    return out.join(copies, ["doc_id", "th"], "left_anti").unionByName(copies)


def free_shuffles(spark: SparkSession) -> None:
    """Lets executors delete what finished jobs have shuffled: they keep it as long as
    the driver has a plan of such a job, so those that nobody uses are collected.  The
    driver's Python lets go of its side first, which takes the JVM a moment."""
    for _ in range(3):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def spans(ranges: list[int] | None) -> np.ndarray:
    """Ranges merged where they touch: rows (first, end) in order."""
    r = np.array(ranges or [], np.int64).reshape(-1, 2)
    if not len(r):
        return r
    r = r[np.argsort(r[:, 0], kind="stable")]
    end = np.maximum.accumulate(r[:, 1])
    new = np.concatenate(([True], r[1:, 0] > end[:-1]))
    at = np.flatnonzero(new)
    return np.stack((r[at, 0], end[np.concatenate((at[1:] - 1, [len(r) - 1]))]), axis=1)


def kept(text: bytes, gone: np.ndarray) -> bytes:
    """What is left of a text; part of a character may stay, as bytes are what is judged."""
    cut = [0, *gone.ravel().tolist(), len(text)]
    return b"".join(text[a:b] for a, b in zip(cut[::2], cut[1::2], strict=True))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        rows = []
        for doc, text, ranges in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), batch.column(2).to_pylist(), strict=True):
            gone = spans(ranges)
            rows.append((doc, len(text), int((gone[:, 1] - gone[:, 0]).sum()), len(gone), kept(text, gone)))
        kinds = (*[pa.int64()] * 4, pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def without_repeats(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (bytes) of each row of ``docs``."""
    texts = documents_only(docs).withColumn("th", F.xxhash64("text"))
    gone = repeated_ranges(docs, crowd)
    return texts.join(gone, ["doc_id", "th"], "left").select("doc_id", "text", "ranges").mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op13_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    """The contract's columns for all documents."""
    found = without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


OP13_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
b AS (SELECT doc_id, unnest(range(0, greatest(length(x) // 2, 1), 256)) AS base, x FROM d),
s AS (SELECT doc_id, base, substr(x, 2 * base + 1, 610) AS s FROM b),
w AS (SELECT doc_id, base + o AS p, substr(s, 2 * o + 1, 100) AS w FROM (SELECT doc_id, base, s, unnest(range(0, least(256, length(s) // 2))) AS o FROM s)),
m AS (SELECT w, min(doc_id) AS m FROM w WHERE length(w) = 100 GROUP BY w),
f AS (SELECT w.doc_id, w.p, w.p + 50 AS e FROM w JOIN m USING (w) WHERE m.m < w.doc_id),
g AS (SELECT doc_id, p, e, max(e) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM f),
i AS (SELECT doc_id, p, e, sum(CASE WHEN before >= p THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY p) AS i FROM g),
r AS (SELECT doc_id, min(p) AS p, max(e) AS e FROM i GROUP BY doc_id, i),
c AS (SELECT doc_id, p, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY p), 0) AS after FROM r),
k AS (SELECT c.doc_id, count(*) AS n_spans, sum(e - p)::BIGINT AS n_removed, string_agg(substr(d.x, 2 * after + 1, 2 * (p - after)), '' ORDER BY p) AS head, max(e) AS tail FROM c JOIN d USING (doc_id) GROUP BY c.doc_id)
SELECT doc_id, length(x) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(x, 2 * coalesce(tail, 0) + 1))) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""
