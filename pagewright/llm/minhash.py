"""Near-duplicate documents by b-bit MinHash, confirmed on full shingle sets.

1. One pass gives each document the size and digest of its set of 5-word
   shingles, the keys of its bands of minima, and a packed signature that
   retains the low bits of every minimum.
2. Equal sets (equal digests of 128 bits) are one class with a number of its own;
   one row of each goes on, under that number.
3. In each band bucket every document is compared with the smallest of the
   bucket.  The packed signatures' bit counts, corrected for chance collisions,
   estimate the similarity; pairs that can't reach the threshold, with a margin
   of six standard deviations, are left; the others are confirmed on the sets,
   which are made again from the texts of just these documents.
4. Buckets whose members are by then in more than one component are compared in
   full, but only between components and only where the estimate allows; that
   keeps the result exact for all pairs that share a bucket without listing the
   pairs of a group of copies.
5. Components come from the distributed star algorithm in ``components``.

``bands_for`` picks the number of bands so that a pair at the threshold misses
all of them with probability ``MISS`` at most.

Defined cases: null or empty texts have an empty set and are linked with
nothing; with fewer than five words the whole sequence is one shingle; rows with
an equal id are one document, so what any of its texts is linked with is linked
with it, and each row has its own n_shingles; a null id is linked with nothing
and kept; ties need no order, as a component's name is its smallest id; a very
long text is one row of one batch; other columns are ignored, whatever they are
called, and drop_near_duplicates returns them; an empty table gives an empty
result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, documents_only, materialize, mix64, slices, utf8
from .components import connected_components

SHINGLE = 5
ROWS = 5
BITS = 4
MISS = 1e-6
#: Documents of one bucket that a task compares; larger buckets are dealt in block pairs.
BLOCK = 4096
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


class WordHashes(dict):
    """A 64-bit hash by word; each worker remembers the latest words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        got = xxhash.xxh3_64_intdigest(word)
        if len(word) < 64:
            self[word] = got
        return got


_words = WordHashes()


def shingles(text: bytes) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's 5-word shingles."""
    words = text.lower().split()
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    if not len(h):
        return h
    if len(h) < SHINGLE:
        return mix64(np.array([(h * _ODD[: len(h)]).sum() + np.uint64(len(h))], np.uint64))
    n = len(h) - SHINGLE + 1
    s = h[:n] * _ODD[0]
    for i in range(1, SHINGLE):
        s += h[i : i + n] * _ODD[i]
    return np.unique(mix64(s))


def bands_for(percent: int) -> int:
    return math.ceil(math.log(MISS) / math.log(1 - (percent / 100) ** ROWS))


def permutations(bands: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_131)
    k = bands * ROWS
    return rng.integers(0, 1 << 32, (k, 1), dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, (k, 1), dtype=np.uint32)


def minima(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (s >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 4096):
        np.minimum(out, (a * x[None, i : i + 4096] + b).min(axis=1), out=out)
    return out


def packed(low: np.ndarray) -> np.ndarray:
    """Signature words: 16 retained values of BITS bits in each signed 64-bit word."""
    per = 64 // BITS
    v = np.zeros(-(-len(low) // per) * per, np.uint64)
    v[: len(low)] = low & np.uint32((1 << BITS) - 1)
    return (v.reshape(-1, per) << (np.arange(per, dtype=np.uint64) * np.uint64(BITS))).sum(axis=1, dtype=np.uint64).view(np.int64)


def features(docs: DataFrame, bands: int) -> DataFrame:
    """doc_id, th (the text's hash), n_shingles, digest, bands, sig of each document."""
    a, b = permutations(bands)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            n, digest, keys, sigs = [], [], [], []
            for text in utf8(batch.column(1)):
                s = shingles(text)
                n.append(len(s))
                if len(s):
                    m = minima(s, a, b)
                    digest.append(xxhash.xxh3_128_digest(s.tobytes()))
                    keys.append([xxhash.xxh3_64_intdigest(m[i : i + ROWS].tobytes()) - (1 << 63) for i in range(0, len(m), ROWS)])
                    sigs.append(packed(m).tolist())
                else:
                    digest.append(None), keys.append(None), sigs.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sigs, pa.list_(pa.int64()))], ["doc_id", "th", "n_shingles", "digest", "bands", "sig"])

    return with_text_hash(docs).mapInArrow(run, "doc_id long, th long, n_shingles long, digest binary, bands array<long>, sig array<long>")


def with_text_hash(docs: DataFrame) -> DataFrame:
    return documents_only(docs).withColumn("th", F.xxhash64("text"))


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """cls, s: the shingle sets, as bytes, of the classes in ``wanted`` (cls, doc_id,
    th, digest), made again from the text that stands for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = [shingles(t).tobytes() for t in utf8(batch.column(0))]
            ours = [xxhash.xxh3_128_digest(x) == d for x, d in zip(sets, batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(sets, pa.binary())], ["cls", "s"]).filter(pa.array(ours, pa.bool_()))

    found = with_text_hash(docs).join(wanted, ["doc_id", "th"]).select("text", "cls", "digest").mapInArrow(run, "cls long, s binary")
    return found.dropDuplicates(["cls"])


def least_match(percent: int, k: int) -> int:
    """Equal retained values that a pair at the threshold has at least: its
    expectation, chance collisions included, less six standard deviations."""
    p = percent / 100 + (1 - percent / 100) / (1 << BITS)
    return max(1, math.floor(k * p - 6 * math.sqrt(k * p * (1 - p))))


def _ones() -> int:
    return int(sum(1 << (BITS * i) for i in range(64 // BITS)))


def equal_values(x: Column, y: Column, k: int) -> Column:
    """Retained values that two signatures share, by bit counts of their difference."""

    def differing(a: Column, b: Column) -> Column:
        z = a.bitwiseXOR(b)
        for step in (1, 2):
            z = z.bitwiseOR(F.shiftrightunsigned(z, step))
        return F.bit_count(z.bitwiseAND(F.lit(_ones())))

    return F.lit(k) - F.aggregate(F.zip_with(x, y, differing), F.lit(0), lambda acc, d: acc + d.cast("int"))


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, in whole numbers."""
    small = min(len(x), len(y))
    if not small or 100 * small < percent * max(len(x), len(y)):
        return False
    both = np.sort(np.concatenate((x, y)))
    inter = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * inter >= percent * (len(x) + len(y) - inter)


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["u", "v"]).filter(pa.array(ok, pa.bool_()))

    return run


def _eligible(t: dict, least: int, k: int):
    """For each row, the rows before it that it may be similar to: another
    component, an estimate that allows it, and no earlier band in common."""
    sig, keys = np.array(t["sig"], np.int64).view(np.uint64), np.array(t["bands"], np.int64)
    label, block, band = np.array(t["label"], np.int64), np.array(t["own"]), int(t["band"][0])
    ones, apart = np.uint64(_ones()), t["i"][0] != t["j"][0]
    for i in range(1, len(sig)):
        z = sig[:i] ^ sig[i]
        z |= z >> np.uint64(1)
        z |= z >> np.uint64(2)
        match = k - np.bitwise_count(z & ones).sum(axis=1, dtype=np.int64)
        ok = (match >= least) & (label[:i] != label[i])
        if apart:
            ok &= block[:i] != block[i]
        at = np.flatnonzero(ok)
        if len(at) and band:
            at = at[~(keys[at, :band] == keys[i, :band]).any(axis=1)]
        if len(at):
            yield i, at[np.argsort(-match[at], kind="stable")]


def _participants(least: int, k: int):
    def run(table: pa.Table) -> pa.Table:
        t = table.to_pydict()
        hit: set[int] = set()
        for i, at in _eligible(t, least, k):
            hit |= {i, *at.tolist()}
        return table.take(pa.array(sorted(hit), pa.int64()))

    return run


def _links(least: int, k: int, percent: int):
    """Confirm pairs, likeliest first, skipping those already connected."""

    def run(table: pa.Table) -> pa.Table:
        t = table.to_pydict()
        ids, label = t["cls"], t["label"]
        up = {x: x for x in label}

        def top(x: int) -> int:
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        s, out = [np.frombuffer(x, np.uint64) for x in t["s"]], []
        for i, at in _eligible(t, least, k):
            for j in at.tolist():
                a, b = top(label[i]), top(label[j])
                if a != b and similar(s[i], s[j], percent):
                    up[max(a, b)] = min(a, b)
                    out.append((ids[i], ids[j]))
        return pa.table({"u": pa.array([min(x) for x in out], pa.int64()), "v": pa.array([max(x) for x in out], pa.int64())})

    return run


def near_duplicates(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component of each row of ``docs``.

    Documents are linked whose sets have a Jaccard similarity of ``percent`` or
    more; component is the smallest id reachable.
    """
    docs = documents_only(docs, id_col, text_col)
    bands = bands_for(percent)
    k, least = bands * ROWS, least_match(percent, bands * ROWS)
    f = materialize(features(docs, bands), "minhash")
    n = f.count()
    full = f.where("n_shingles > 0 and doc_id is not null")
    # written, so that both sides of the joins are dealt for them alone and a set with many copies can be split
    first = full.groupBy("digest").agg(F.min(F.struct("doc_id", "th")).alias("at"))
    classes = materialize(first.select("digest", F.col("at.doc_id").alias("rep"), "at.th"), "classes", n)
    copies = full.select("doc_id", "digest").join(classes, "digest").select(F.col("rep").alias("u"), F.col("doc_id").alias("v")).where("u < v")
    reps = full.join(classes.withColumnRenamed("rep", "doc_id"), ["doc_id", "th", "digest"], "left_semi").dropDuplicates(["digest"])
    # the numbers are read back as written, so they are the same wherever they are used
    reps = materialize(reps.select(F.monotonically_increasing_id().alias("cls"), "doc_id", "th", "digest", "bands", "sig"), "reps", n)
    home = reps.select("cls", "doc_id", "th", "digest")

    keys = reps.select("cls", F.posexplode("bands").alias("band", "key"))
    hubs = keys.groupBy("band", "key").agg(F.min("cls").alias("u"), F.count("*").alias("n")).where("n > 1").drop("n")
    pairs = keys.join(hubs, ["band", "key"]).where("u < cls").select("u", F.col("cls").alias("v")).distinct()
    sig = reps.select("cls", "sig")
    pairs = pairs.join(sig.select(F.col("cls").alias("v"), F.col("sig").alias("y")), "v").join(sig.select(F.col("cls").alias("u"), F.col("sig").alias("x")), "u")
    pairs = materialize(pairs.where(equal_values(F.col("x"), F.col("y"), k) >= least).select("u", "v"), "pairs", 4 * n)
    ids = pairs.select(F.explode(F.array("u", "v")).alias("cls")).distinct()
    sets = materialize(sets_of(docs, home.join(ids, "cls", "left_semi")), "sets")
    both = pairs.join(sets.select(F.col("cls").alias("v"), F.col("s").alias("y")), "v").join(sets.select(F.col("cls").alias("u"), F.col("s").alias("x")), "u").select("u", "v", "x", "y")
    stars = materialize(both.mapInArrow(_confirm(percent), "u long, v long").hint("rebalance"), "stars")

    linked = connected_components(stars, n)
    label = reps.join(linked.withColumnRenamed("node", "cls"), "cls", "left").withColumn("label", F.coalesce("component", "cls")).drop("component")
    # numbers and labels alone are dealt by bucket; what is compared joins the few that are left
    narrow = label.select("cls", "label", F.posexplode("bands").alias("band", "key"))
    open_ = narrow.groupBy("band", "key").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.count("*").alias("n")).where("a <> b").select("band", "key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    left = materialize(narrow.join(open_, ["band", "key"]), "buckets", 8 * n)
    scratch = [classes, reps, pairs, sets, stars, left]
    edges = linked.select(F.col("component").alias("u"), F.col("node").alias("v"))
    if not left.isEmpty():
        rows = left.join(reps.select("cls", "bands", "sig"), "cls")
        rows = rows.withColumn("own", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        rows = rows.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("other", "blocks")
        group = ["band", "key", "i", "j"]
        some = materialize(rows.groupBy(*group).applyInArrow(_participants(least, k), rows.schema).hint("rebalance"), "open")
        more = some.join(sets_of(docs, home.join(some.select("cls").distinct(), "cls", "left_semi")), "cls")
        # written before the next Python step: chained, each would keep a worker of its own alive beside the heap
        more = materialize(more.groupBy(*group).applyInArrow(_links(least, k, percent), "u long, v long").hint("rebalance"), "links")
        scratch += [some, more]
        edges = edges.unionByName(more)
    ids_of = lambda c: home.select(F.col("cls").alias(c), F.col("doc_id").alias(f"{c}_id"))
    edges = edges.join(ids_of("u"), "u").join(ids_of("v"), "v").select(F.col("u_id").alias("u"), F.col("v_id").alias("v"))
    cc = connected_components(edges.unionByName(copies), n)
    discard(*scratch)
    return f.select("doc_id", "n_shingles").join(cc.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))


def drop_near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """``docs`` with one document, that of the smallest id, of each group."""
    found = near_duplicates(docs, percent)
    gone = found.where("doc_id <> component").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")


def op3_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """The contract's columns for all documents at 85 percent."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), 85)
    return found.select("doc_id", "n_shingles", F.col("component").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("component"), F.lit(True)).alias("kept"))


OP3_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS s FROM w),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS u, b.doc_id AS v FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
  HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))),
e AS (SELECT u, v FROM p UNION ALL SELECT v, u FROM p),
r(node, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.v, r.root FROM r JOIN e ON e.u = r.node),
c AS (SELECT node, min(root) AS component_id FROM r GROUP BY node)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept FROM s JOIN c ON c.node = s.doc_id
"""
