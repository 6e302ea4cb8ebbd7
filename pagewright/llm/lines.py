"""Near-duplicate lines by a segment-partition edit join.

A line is what stands between line feeds; it is compared stripped of blanks and
lower-cased (A-Z), as UTF-8, and its edit distance counts bytes.  Lines of fewer
than ``MIN_BYTES`` bytes are linked only where they are equal: two edits are too
large a part of them.  Blank lines are never linked and never removed.

1. Occurrences are counted by the lines' 128-bit hashes, so equal lines are one
   and have one number.
2. Each distinct line is cut into ``edits + 1`` even segments.  Two lines within
   ``edits`` share one of them at nearly the same place, so a line's segments are
   indexed under (length, segment number, bytes), and a line probes the lengths up
   to ``edits`` shorter at just the places that a minimal alignment allows.  Keys
   and line hashes travel as arrays, a block of them a row, and each reducer
   sorts its blocks to find the keys that meet.  A key that many lines of one
   slice share has met there already: its lines go past the reducers, which get
   three of them for the lines of other slices to meet.
3. Lines that share a key are verified by a bit-parallel automaton whose
   ``edits + 1`` state words cover only the band of ``2 * edits + 1`` diagonals,
   after equal ends are cut off; pairs already connected aren't verified again.
   Under a key of more than ``MOST`` lines, what stands beside the shared segment
   is cut into segments in its turn, for it has to be within ``edits`` too: the
   lines must share a second key, and a third, until groups are small.  Groups
   whose rests are too short to cut are compared in pairs of blocks.
4. Of every class of linked lines the first occurrence, by document and line,
   stays.  The others are removed where the class occurs ``repeats`` times or more.

Defined cases: null and empty texts have no lines to remove; rows that repeat an
id and a text are one document; of tied occurrences the one in the smallest
document and line is the first; a very long text is one row of one batch, and a
very long line is compared whole; a document that loses all its lines and keeps
nothing but blanks is left with an empty text, and ``drop_repeated_lines`` drops
it; other columns, whatever they are called, are returned as they are; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, documents_only, materialize, mix64, slices, utf8
from .components import connected_components

MIN_BYTES = 24
EDITS = 2
#: Input bytes for which one reducer of keys is set up.
REDUCER_BYTES = 4 << 20


#: Lines under one key that are verified as one group, and lines of one slice from
#: which on a key counts as met.
MOST = 1024
SHARED = 64
_LOW = (1 << 64) - 1


def line_hash(line: bytes) -> int:
    """The lower half of the line's 128-bit hash, signed."""
    return (xxhash.xxh3_128_intdigest(line) & _LOW) - (1 << 63)


def line_hashes(line: bytes) -> tuple[int, int]:
    both = xxhash.xxh3_128_intdigest(line)
    return (both & _LOW) - (1 << 63), (both >> 64) - (1 << 63)


def normal(text: bytes) -> list[bytes]:
    return [x.strip() for x in text.lower().split(b"\n")]


def segments(size: int, edits: int) -> list[tuple[int, int]]:
    """(start, length) of the even segments; the later ones take the rest."""
    n = edits + 1
    short, longer = size // n, size % n
    out, at = [], 0
    for i in range(n):
        k = short + (i >= n - longer)
        out.append((at, k))
        at += k
    return out


_plans: dict[tuple[int, int], list[tuple[int, int, int, int]]] = {}


def probes(size: int, edits: int) -> list[tuple[int, int, int, int]]:
    """(indexed length, segment, start, length) of what a line of ``size`` bytes
    looks up; the first edits + 1 are its own segments."""
    plan = _plans.get((size, edits))
    if plan is None:
        plan = [(size, i, p, k) for i, (p, k) in enumerate(segments(size, edits))]
        own = set(plan)
        for short in range(edits + 1):
            for i, (p, k) in enumerate(segments(size - short, edits)):
                # errors left of the segment are i at most, right of it edits - i
                low = max(p - i, p + short - (edits - i), 0)
                high = min(p + i, p + short + (edits - i), size - k)
                plan += [x for at in range(low, high + 1) if (x := (size - short, i, at, k)) not in own]
        if len(_plans) < 2_000:
            _plans[size, edits] = plan
    return plan


def within(a: bytes, b: bytes, edits: int) -> bool:
    """Whether the edit distance of two byte strings is ``edits`` at most."""
    if abs(len(a) - len(b)) > edits:
        return False
    n = min(len(a), len(b))
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    differ = np.flatnonzero(x[:n] != y[:n])
    if not len(differ):
        return True
    at = int(differ[0])
    rest = n - at
    back = np.flatnonzero(x[len(a) - rest :][::-1] != y[len(b) - rest :][::-1])
    end = int(back[0]) if len(back) else rest
    return banded(a[at : len(a) - end], b[at : len(b) - end], edits)


def banded(a: bytes, b: bytes, edits: int) -> bool:
    """The automaton: bit o of state e says that the first j + o - edits bytes of
    ``a`` match the first j of ``b`` with e errors at most."""
    band = (1 << (2 * edits + 1)) - 1
    state = [sum(1 << (edits + p) for p in range(min(e, len(a)) + 1)) for e in range(edits + 1)]
    for j, c in enumerate(b):
        low = j - edits
        same = 0
        for p in range(max(low, 0), min(j + edits + 1, len(a))):
            same |= (a[p] == c) << (p - low)
        old, state = state, [state[0] & same]
        for e in range(1, edits + 1):
            state.append((old[e] & same | old[e - 1] | old[e - 1] >> 1 | state[e - 1] << 1) & band)
        if not state[-1]:
            return False
    o = len(a) - len(b) + edits
    return 0 <= o <= 2 * edits and bool(state[edits] >> o & 1)


def occurrences(docs: DataFrame) -> DataFrame:
    """doc_id, th (the text's hash), line, h, g (the line's): each line that isn't blank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            at, low, high = [], [], []
            for t in utf8(b.column(1)):
                own = [(i, *line_hashes(x)) for i, x in enumerate(normal(t)) if x]
                for held, k in ((at, 0), (low, 1), (high, 2)):
                    held.append([r[k] for r in own])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(at, pa.list_(pa.int32())), pa.array(low, pa.list_(pa.int64())), pa.array(high, pa.list_(pa.int64()))], ["doc_id", "th", "at", "hs", "gs"])

    found = docs.mapInArrow(run, "doc_id long, th long, at array<int>, hs array<long>, gs array<long>")
    return found.select("doc_id", "th", F.explode(F.arrays_zip("at", "hs", "gs")).alias("x")).select("doc_id", "th", F.col("x.at").alias("line"), F.col("x.hs").alias("h"), F.col("x.gs").alias("g"))


#: A key, whose lowest bit tells a line's own (indexed) key from a probe, and the line's hash.
_KEY = np.dtype([("k", "<u8"), ("h", "<i8")])
_OWN = np.uint64(1)


def key_blocks(docs: DataFrame, edits: int, least: int, reducers: int) -> DataFrame:
    """(part, block): keys of the lines, dealt by key; a line once a task and slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in slices(batches, "text"):
            if len(seen) > 200_000:
                seen.clear()
            ks, hs, owns = [], [], []
            digest = xxhash.xxh3_64_intdigest
            for t in utf8(b.column(1)):
                for x in normal(t):
                    if len(x) < least or (h := line_hash(x)) in seen:
                        continue
                    seen.add(h)
                    plan = probes(len(x), edits)
                    ks += [digest(x[p : p + k], size * 31 + i) for size, i, p, k in plan]
                    hs.append(h)
                    owns.append(len(plan))
            out = np.empty(len(ks), _KEY)
            ends = np.cumsum(owns)
            own = np.arange(len(ks)) - np.repeat(ends - owns, owns) <= edits if len(owns) else np.zeros(0, bool)
            out["k"] = np.array(ks, np.uint64) & ~_OWN | own.astype(np.uint64)
            out["h"] = np.repeat(np.array(hs, np.int64), owns)
            out, part = shared_apart(out, reducers)
            order = np.argsort(part, kind="stable")
            cuts = np.flatnonzero(np.diff(part[order])) + 1
            groups = [g for g in np.split(order, cuts) if len(g)]
            yield pa.RecordBatch.from_arrays([pa.array([int(part[g[0]]) for g in groups], pa.int64()), pa.array([out[g].tobytes() for g in groups], pa.binary())], ["part", "block"])

    return docs.mapInArrow(run, "part long, block binary")


def shared_apart(out: np.ndarray, reducers: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and the parts they go to: by key, or by line for those that more than
    SHARED lines of this slice share; of these an indexed line, if there is one, and
    two different lines stand in for all the others."""
    out = out[np.lexsort((out["h"], out["k"] | _OWN))]
    key = out["k"] | _OWN
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(out) else np.zeros(0, np.int64)
    size = np.diff(np.r_[first, len(out)])
    part = (mix64(key) % np.uint64(reducers)).astype(np.int64)
    hot = np.repeat(size > SHARED, size)
    if not hot.any():
        return out, part
    stand = []
    for at, n in zip(first[size > SHARED].tolist(), size[size > SHARED].tolist(), strict=True):
        stand += [at, at + n - 1, at + int(np.argmax(out["k"][at : at + n] & _OWN))]
    part[hot] = reducers + (mix64(out["h"][hot].view(np.uint64)) % np.uint64(reducers)).astype(np.int64)
    again = np.array(sorted(set(stand)), np.int64)
    return np.concatenate((out, out[again])), np.concatenate((part, (mix64(key[again]) % np.uint64(reducers)).astype(np.int64)))


def _meeting(reducers: int):
    """k, h of the keys under which an indexed line meets another one."""

    def run(table: pa.Table) -> pa.Table:
        x = np.frombuffer(b"".join(table.column("block").to_pylist()), _KEY)
        x = x[np.lexsort((x["h"], x["k"] | _OWN))]
        key, own = x["k"] | _OWN, (x["k"] & _OWN).astype(np.int64)
        again = np.zeros(len(x), bool)
        # the same line from several tasks; one line doesn't probe its own keys
        again[1:] = (key[1:] == key[:-1]) & (x["h"][1:] == x["h"][:-1])
        met = table.column("part")[0].as_py() >= reducers
        if not met:
            own = np.maximum.reduceat(own, np.flatnonzero(~again)) if len(own) else own
        x, key = x[~again], key[~again]
        if len(x) and not met:
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            count = np.diff(np.r_[first, len(x)])
            keep = np.repeat((count > 1) & (np.add.reduceat(own, first) > 0), count)
            x, key = x[keep], key[keep]
        return pa.table({"k": key.view(np.int64), "h": x["h"]})

    return run


def texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """h, cls, x: the bytes of the wanted lines (doc_id, th, line, h, cls)."""
    wanted = wanted.groupBy(F.col("doc_id").alias("_d"), F.col("th").alias("_h")).agg(F.collect_list(F.struct("line", "h", "cls")).alias("lines"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            rows = []
            for t, lines in zip(utf8(b.column(0)), b.column(1).to_pylist(), strict=True):
                own = normal(t)
                rows += [(r["h"], r["cls"], own[r["line"]]) for r in lines]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], ["h", "cls", "x"])

    # rows that repeat an id and a text give their lines again
    return docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("th") == F.col("_h"))).select("text", "lines").mapInArrow(run, "h long, cls long, x binary").dropDuplicates(["cls"])


def _verify(edits: int):
    """Links of the lines under one key, or of two blocks of them; a pair of one
    component isn't verified again."""

    def run(table: pa.Table) -> pa.Table:
        apart = table.column("i")[0].as_py() != table.column("j")[0].as_py()
        lines = sorted(set(zip(table.column("cls").to_pylist(), table.column("x").to_pylist(), table.column("own").to_pylist(), strict=True)), key=lambda r: (len(r[1]), r))
        up = list(range(len(lines)))

        def top(i: int) -> int:
            while up[i] != i:
                up[i] = up[up[i]]
                i = up[i]
            return i

        sizes, block = np.array([len(x) for _, x, _ in lines]), np.array([o for _, _, o in lines])
        # an edit changes two bins of a histogram by one at most
        bins = np.array([np.bincount(np.frombuffer(x, np.uint8) & 63, minlength=64) for _, x, _ in lines], np.int32)
        out = []
        for i in range(1, len(lines)):
            low = int(np.searchsorted(sizes, sizes[i] - edits))
            near = np.abs(bins[low:i] - bins[i]).sum(axis=1) <= 2 * edits
            if apart:
                near &= block[low:i] != block[i]
            for j in (low + np.flatnonzero(near)).tolist():
                a, b = top(i), top(j)
                if a != b and within(lines[i][1], lines[j][1], edits):
                    up[a] = b
                    out.append((lines[i][0], lines[j][0]))
        return pa.table({"u": pa.array([u for u, _ in out], pa.int64()), "v": pa.array([v for _, v in out], pa.int64())})

    return run


def verified(members: DataFrame, edits: int) -> DataFrame:
    """u, v: links of the lines (k, cls, x, blocks) of each key, in pairs of its blocks."""
    rows = members.withColumn("own", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("k", "cls", "x", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    return rows.groupBy("k", "i", "j").applyInArrow(_verify(edits), "u long, v long")


def _rests(edits: int, located: bool):
    """k, own, cls, rest of each line's next segments; ``located``: of the places
    where its key stands, as the first cut found it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for b in slices(batches, "x"):
            rows = set()
            for k, cls, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                for at, (size, i, p, n) in enumerate(probes(len(x), edits)):
                    if located:
                        if (digest(x[p : p + n], size * 31 + i) | 1) == k & _LOW:
                            rows.add((k, True, cls, x[:p] + x[p + n :]))
                    else:
                        found = digest(x[p : p + n] + k.to_bytes(8, "little", signed=True), size * 31 + i) - (1 << 63)
                        rows.add((found, at <= edits, cls, x[:p] + x[p + n :]))
            k, own, cls, rest = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(own, pa.bool_()), pa.array(cls, pa.int64()), pa.array(rest, pa.binary())], ["k", "own", "cls", "rest"])

    return run


def crowded(members: DataFrame, texts: DataFrame, edits: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Tables of links under the keys of more than MOST lines (k, cls, x), and scratch tables."""
    found, scratch = [], []
    rows = materialize(members.select("k", "cls", "x").mapInArrow(_rests(edits, True), "k long, own boolean, cls long, rest binary"), "crowded")
    while True:
        scratch.append(rows)
        sizes = rows.groupBy("k").agg(F.countDistinct("cls").alias("n"), F.max("own").alias("own"), F.max(F.length("rest")).alias("left")).where("n > 1 and own")
        # what can't be cut any more, and what is few enough, is compared
        done = (F.col("n") <= MOST) | (F.col("left") < 3 * (edits + 1))
        few = sizes.where(done).select("k", F.ceil(F.col("n") / MOST).cast("int").alias("blocks"))
        links = verified(rows.select("k", "cls").distinct().join(few, "k").join(texts.select("cls", "x"), "cls"), edits)
        found.append(materialize(links.hint("rebalance"), "links"))
        many = rows.join(sizes.where(~done).select("k"), "k", "left_semi")
        if many.isEmpty():
            return found, scratch
        rows = materialize(many.select("k", "cls", F.col("rest").alias("x")).mapInArrow(_rests(edits, False), "k long, own boolean, cls long, rest binary"), "crowded")


def with_text_hash(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return documents_only(docs, id_col, text_col).withColumn("th", F.xxhash64("text"))


def repeated_lines(docs: DataFrame, edits: int = EDITS, repeats: int = 2, least: int = MIN_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, th, lines: the numbers of the lines to remove from each document
    that has any, counted from 0."""
    docs = with_text_hash(docs, id_col, text_col)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    reducers = max(8, int(total // REDUCER_BYTES) + 1)
    lines = materialize(occurrences(docs), "lines")
    counted = lines.groupBy("h", "g").agg(F.min(F.struct("doc_id", "th", "line")).alias("at"), F.count("*").alias("n"))
    # the numbers are read back as written, so they are the same wherever they are used
    first = materialize(counted.select(F.monotonically_increasing_id().alias("cls"), "h", "g", "at", "n"), "first")

    n = first.count()
    met = materialize(key_blocks(docs, edits, least, reducers).groupBy("part").applyInArrow(_meeting(reducers), "k long, h long"), "keys")
    wanted = met.select("h").distinct().join(first, "h").select("at.*", "h", "cls")
    texts = materialize(texts_of(docs, wanted), "texts", 4 * n)
    sizes = met.groupBy("k").agg(F.count("*").alias("n")).where(F.col("n") > MOST).select("k")
    many = materialize(sizes, "many", n)
    scratch = [met, texts, many]
    members = met.join(texts, "h").select("k", "cls", "x")
    if many.isEmpty():
        links = verified(members.withColumn("blocks", F.lit(1)), edits)
    else:
        links = verified(members.join(many, "k", "left_anti").withColumn("blocks", F.lit(1)), edits)
        found, more = crowded(members.join(many, "k"), texts, edits)
        scratch += found + more
        for one in found:
            links = links.unionByName(one)
    links = materialize(links.hint("rebalance"), "links")
    components = connected_components(links, n)
    discard(links, *scratch)
    classes = components.withColumnRenamed("node", "cls")

    by = first.join(classes, "cls", "left").select("h", "g", "at", "n", F.coalesce("component", "cls").alias("c"))
    several = by.groupBy("c").agg(F.min("at").alias("keep"), F.sum("n").alias("n")).where(F.col("n") >= max(2, repeats))
    gone = by.select("h", "g", "c").join(several, "c").select("h", "g", "keep")
    out = lines.join(gone, ["h", "g"]).where(F.struct("doc_id", "th", "line") != F.col("keep"))
    return out.groupBy("doc_id", "th").agg(F.array_sort(F.collect_set("line")).alias("lines"))


def cleaned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """All columns of ``docs`` as column row, lines (numbers removed, or null) and clean (the text without them)."""
    gone = repeated_lines(docs, id_col=id_col, text_col=text_col, **how).select(F.col("doc_id").alias("_d"), F.col("th").alias("_h"), "lines")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(id_col).cast("long").alias("_i"), F.col(text_col).cast("string").alias("_t"))
    rows = rows.join(gone, F.col("_i").eqNullSafe(F.col("_d")) & (F.xxhash64("_t") == F.col("_h")), "left")
    left = F.array_join(F.filter(F.split("_t", "\n", -1), lambda _, i: ~F.array_contains("lines", i)), "\n")
    return rows.select("row", "lines", F.when(F.col("lines").isNull(), F.col("_t")).otherwise(left).alias("clean"))


def drop_repeated_lines(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with the repeated lines taken out of text, n_chars (if there) set
    anew, and without the documents of which nothing is left."""
    out = cleaned(docs, **how).where("lines is null or trim(BOTH from replace(clean, '\n', '')) <> ''")
    columns = [F.col("clean").alias(c) if c == "text" else F.when(F.col("lines").isNull(), F.col(f"row.`{c}`")).otherwise(F.length("clean")).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    return out.select(*columns)


def op6_segment_line_dedup(spark, sf_dir: str) -> DataFrame:
    """For each document: how many lines it has, which are removed, and the digest of what is left."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = cleaned(docs)
    return out.select(
        F.col("row.doc_id").alias("doc_id"),
        F.size(F.split(F.coalesce("row.text", F.lit("")), "\n", -1)).cast("long").alias("n_lines"),
        F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(F.array_join(F.col("lines").cast("array<string>"), ","), F.lit("")).alias("removed"),
        F.sha2(F.coalesce("clean", F.lit("")), 256).alias("text_sha256"),
    )


OP6_SQL = r"""
WITH RECURSIVE l AS (SELECT doc_id, i - 1 AS line, trim(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), E' \t\n\r\x0b\x0c') AS x
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), E'\n')) AS x, generate_subscripts(string_split(coalesce(text, ''), E'\n'), 1) AS i FROM documents)),
o AS (SELECT * FROM l WHERE x <> ''),
d AS (SELECT x, row_number() OVER (ORDER BY x) AS id, strlen(x) AS n FROM (SELECT DISTINCT x FROM o)),
p AS (SELECT a.id AS u, b.id AS v FROM d a JOIN d b ON a.n >= 24 AND b.n BETWEEN a.n AND a.n + 2 AND a.id <> b.id AND levenshtein(a.x, b.x) <= 2),
e AS (SELECT u, v FROM p UNION SELECT v, u FROM p),
r(node, root) AS (SELECT id, id FROM d UNION SELECT e.v, r.root FROM r JOIN e ON e.u = r.node),
c AS (SELECT node, min(root) AS c FROM r GROUP BY node),
k AS (SELECT o.doc_id, o.line, c.c, row_number() OVER (PARTITION BY c.c ORDER BY o.doc_id, o.line) AS n FROM o JOIN d USING (x) JOIN c ON c.node = d.id),
g AS (SELECT doc_id, list(line ORDER BY line) AS lines FROM k WHERE n > 1 GROUP BY doc_id),
s AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), E'\n') AS a, coalesce(lines, []) AS lines FROM documents LEFT JOIN g USING (doc_id))
SELECT doc_id, len(a)::BIGINT AS n_lines, len(lines)::BIGINT AS n_removed, array_to_string(lines, ',') AS removed,
  sha256(array_to_string(list_transform(list_filter(range(1, len(a) + 1), lambda i: NOT list_contains(lines, i - 1)), lambda i: a[i]), E'\n')) AS text_sha256 FROM s
"""
