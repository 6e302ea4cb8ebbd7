"""Fill-in-middle transformation with cuts found by a parallel automaton scan.

A token is a run of blanks with the run of other characters behind it (or the
blanks that end a text).  The automaton that finds the tokens has two states:
before it lies nothing or a blank (``OPEN``), or a character that isn't blank
(``WORD``).  A token begins where a blank comes in state ``WORD``, and at the
start of the text.

A chunk of text is scanned without knowing the state that it is entered in: it
emits its transition function (the state it is left in, for each state it may be
entered in), the tokens that begin in it for each of the two, and its code
points.  Such summaries compose associatively.  A document of one chunk is
resolved where it is read.  A longer one is dealt out as chunks: the summaries of
its chunks are composed in order, which resolves every chunk's entry state and
the tokens and code points before it; the two cuts are then selected by rank, and
only the chunks that hold them are asked for the place.

The text itself never leaves the JVM for the transformation: prefix, middle and
suffix are substrings at the two cuts.

Defined cases: a null text is an empty one and stays as it is (form plain, no
tokens); a null id is hashed like an empty one; rows that repeat an id and a text
come out alike, ids with several texts are rows of their own; two equal cuts give
an empty middle; a very long text is cut in chunks of ``CHUNK`` bytes wherever a
character begins; other columns are ignored, whatever they are called, and
``fill_in_middle`` returns them; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructType

from .common import boxed, slices, unboxed, utf8

#: Bytes of a chunk; longer texts are dealt out.
CHUNK = 1 << 16
#: The seed of the cuts, the sentinels, percent that stay plain, percent of the others that are spm.
SEED, PREFIX, SUFFIX, MIDDLE = 42, "<P>", "<S>", "<M>"
PLAIN_FROM, SPM_UNDER = 50, 80
OPEN, WORD = 0, 1

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def starts(chunk: bytes, entry: int) -> np.ndarray:
    """Offsets in bytes where tokens begin, for a chunk entered in state ``entry``."""
    blank = _BLANK[np.frombuffer(chunk, np.uint8)]
    before = np.concatenate(([entry == OPEN], blank[:-1])) if len(blank) else blank
    return np.flatnonzero(blank & ~before)


def points(chunk: bytes) -> int:
    """Code points of UTF-8: bytes that don't continue a character."""
    return int(np.count_nonzero((np.frombuffer(chunk, np.uint8) & 0xC0) != 0x80))


def summary(chunk: bytes) -> tuple[int, int, int, int, int]:
    """The state a chunk is left in and the tokens beginning in it, for either state
    it may be entered in; its code points."""
    if not chunk:
        return OPEN, WORD, 0, 0, 0
    last = OPEN if _BLANK[chunk[-1]] else WORD
    inner = len(starts(chunk, OPEN))
    return last, last, inner, inner + int(_BLANK[chunk[0]]), points(chunk)


def compose(f: tuple, g: tuple) -> tuple:
    """The summary of two neighbouring chunks."""
    return g[f[0]], g[f[1]], f[2] + g[2 + f[0]], f[3] + g[2 + f[1]], f[4] + g[4]


def place(chunk: bytes, entry: int, rank: int) -> int:
    """Code points before the token that is the ``rank``-th to begin in a chunk, from 0."""
    return points(chunk[: starts(chunk, entry)[rank]])


def pieces(text: bytes, size: int) -> Iterator[bytes]:
    """A text in chunks of about ``size`` bytes that begin where a character does."""
    at = 0
    while at < len(text):
        end = at + size
        while end < len(text) and text[end] & 0xC0 == 0x80:
            end += 1
        yield text[at:end]
        at = end


def cuts_of(text: bytes, h1: int, h2: int) -> tuple[int, int, int]:
    """Tokens of a text of one chunk and the code points before its two cuts."""
    _, _, begun, _, chars = summary(text)
    n = begun + bool(text)  # the first token begins with the text, whatever it begins with
    found = []
    for rank in sorted((h1 % (n + 1), h2 % (n + 1))):
        found.append(0 if rank == 0 else chars if rank == n else place(text, OPEN, rank - 1))
    return n, *found


# types as objects: workers have no session to parse names with
_CUTS = StructType().add("n", LongType()).add("a", LongType()).add("b", LongType())
_SUMMARY = StructType().add("open", IntegerType()).add("word", IntegerType()).add("n_open", LongType()).add("n_word", LongType()).add("chars", LongType())

_PART = StructType().add("i", LongType()).add("state", IntegerType()).add("before", LongType()).add("tokens", LongType()).add("chars_before", LongType())
_RESOLVED = StructType().add("n", LongType()).add("chars", LongType()).add("parts", ArrayType(_PART))


@arrow_udf(_CUTS)
def _own_cuts(text: pa.Array, h1: pa.Array, h2: pa.Array) -> pa.Array:
    got = [cuts_of(t, x, y) for t, x, y in zip(utf8(text), h1.to_pylist(), h2.to_pylist(), strict=True)]
    return pa.StructArray.from_arrays([pa.array([g[i] for g in got], pa.int64()) for i in range(3)], ["n", "a", "b"])


def _chunks(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = [(key, i, piece) for key, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True) for i, piece in enumerate(pieces(text, size))]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*found, strict=True), (pa.string(), pa.int64(), pa.binary()), strict=True)], ["key", "i", "chunk"])

    return run


@arrow_udf(_SUMMARY)
def _summaries(chunk: pa.Array) -> pa.Array:
    got = [summary(c) for c in utf8(chunk)]
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
    return pa.StructArray.from_arrays([pa.array([g[i] for g in got], k) for i, k in enumerate(kinds)], ["open", "word", "n_open", "n_word", "chars"])


@arrow_udf(LongType())
def _places(chunk: pa.Array, entry: pa.Array, rank: pa.Array) -> pa.Array:
    return pa.array([place(c, e, r) for c, e, r in zip(utf8(chunk), entry.to_pylist(), rank.to_pylist(), strict=True)], pa.int64())


@arrow_udf(_RESOLVED)
def _resolved(parts: pa.Array) -> pa.Array:
    """For each document its chunks' summaries, in order, composed from the left."""
    out = []
    for chunks in parts.to_pylist():
        total, found = summary(b""), []
        for c in chunks:
            s = tuple(c["s"].values())
            after = compose(total, s)
            found.append({"i": c["i"], "state": total[OPEN], "before": total[2], "tokens": after[2] - total[2], "chars_before": total[4]})
            total = after
        out.append({"n": total[2] + 1, "chars": total[4], "parts": found})
    return pa.array(out, to_arrow_type(_RESOLVED))


def entries(of: DataFrame) -> DataFrame:
    """key, n, chars, parts: the summaries s of chunks (key, i, s) composed in order.
    parts has for every chunk its entry state and the tokens and code points before
    it: some 40 bytes for each chunk of a document."""
    found = of.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("i", "s"))).alias("c"))
    return found.select("key", _resolved("c").alias("f")).select("key", "f.n", "f.chars", "f.parts")


def dealt_cuts(long: DataFrame, size: int) -> DataFrame:
    """key, cuts: of the texts (key, h1, h2, text) of several chunks, scanned chunk by chunk."""
    texts = long.dropDuplicates(["key"])
    chunks = texts.select("key", "text").mapInArrow(_chunks(size), "key string, i long, chunk binary").repartition("key", "i")
    composed = entries(chunks.select("key", "i", _summaries("chunk").alias("s"))).join(texts.select("key", "h1", "h2"), "key")
    ranks = F.array_sort(F.array(F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1)))
    wanted = composed.select("key", "n", "chars", "parts", F.posexplode(ranks).alias("cut", "rank"))
    # the token of rank r, from 1, is the (r - before)-th to begin in the chunk that covers r
    holds = lambda p: (F.col("rank") > p["before"]) & (F.col("rank") <= p["before"] + p["tokens"])
    at = F.filter("parts", holds)[0]
    wanted = wanted.select("key", "n", "chars", "cut", "rank", F.when((F.col("rank") > 0) & (F.col("rank") < F.col("n")), at).alias("p"))
    inner = wanted.where("p is not null").select("key", "cut", F.col("p.i").alias("i"), "p.state", F.col("p.chars_before").alias("base"), (F.col("rank") - F.col("p.before") - 1).alias("local"))
    found = inner.join(chunks, ["key", "i"]).select("key", "cut", (F.col("base") + _places("chunk", "state", "local")).alias("place"))
    every = wanted.join(found, ["key", "cut"], "left").withColumn("place", F.when(F.col("rank") == 0, F.lit(0)).when(F.col("rank") == F.col("n"), F.col("chars")).otherwise(F.col("place")))
    of = lambda cut: F.max(F.when(F.col("cut") == cut, F.col("place")))
    return every.groupBy("key").agg(F.struct(F.max("n").alias("n"), of(0).alias("a"), of(1).alias("b")).alias("cuts"))


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = CHUNK) -> DataFrame:
    """``docs`` with a struct ``fim``: n (tokens), form (plain, spm or psm), a and b
    (code points before the two cuts) and the output text."""
    columns = docs.columns
    rows = docs.select(boxed(docs), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    digest = F.sha2(F.concat(F.lit(f"{SEED}:"), "id"), 256)
    rows = rows.select("row", "id", "text", *(F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)))
    short = F.octet_length("text") <= size
    near = rows.where(short).withColumn("cuts", _own_cuts("text", "h1", "h2"))
    far = rows.where(~short).withColumn("key", F.concat_ws(":", F.sha2("text", 256), "id"))
    far = far.join(dealt_cuts(far.select("key", "h1", "h2", "text"), size), "key").select(*near.columns)
    every = near.unionByName(far)
    marked = F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    plain = (F.col("text") == "") | marked | (F.col("h3") % 100 >= PLAIN_FROM)
    every = every.withColumn("form", F.when(plain, "plain").when(F.col("h4") % 100 < SPM_UNDER, "spm").otherwise("psm"))
    a, b = F.col("cuts.a").cast("int"), F.col("cuts.b").cast("int")
    prefix, middle, suffix = F.substring("text", F.lit(1), a), F.substring("text", a + 1, b - a), F.substring("text", b + 1, F.length("text"))
    made = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)).otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
    fim = F.struct(F.col("cuts.n").alias("n"), "form", F.col("cuts.a").alias("a"), F.col("cuts.b").alias("b"), made.alias("output"))
    return every.select("row", fim.alias("fim")).select(*unboxed([c for c in columns if c != "fim"]), "fim")


def restored(output: Column, form: Column) -> Column:
    """The text that an output and its form stand for."""
    part = F.split(output, "<[PSM]>", -1)
    return F.when(form == "plain", output).when(form == "psm", F.concat(part[1], part[3], part[2])).otherwise(F.concat(part[2], part[3], part[1]))


def op12_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    """The contract's columns for all documents."""
    found = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    form, a, b = F.col("fim.form"), F.col("fim.a"), F.col("fim.b")
    hashed = lambda c: F.sha2(c, 256)
    cut = lambda c: F.when(form != "plain", c)
    return found.select("doc_id", F.col("fim.n").alias("n"), form.alias("form"), cut(a).alias("prefix_chars"), cut(b - a).alias("middle_chars"), hashed(F.col("fim.output")).alias("output_sha256"), hashed(restored(F.col("fim.output"), form)).alias("restored_sha256"))


OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || doc_id) AS h FROM documents),
t AS (SELECT doc_id, text, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS t,
  list_transform([0, 1, 2, 3], lambda i: list_reduce(list_transform(range(1, 9), lambda k: (strpos('0123456789abcdef', substr(h, 8 * i + k, 1)) - 1)::BIGINT), lambda x, y: 16 * x + y)) AS h FROM d),
c AS (SELECT *, len(t) AS n, least(h[1] % (len(t) + 1), h[2] % (len(t) + 1)) AS a, greatest(h[1] % (len(t) + 1), h[2] % (len(t) + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 50 THEN 'plain' WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM t),
p AS (SELECT *, array_to_string(t[:a], '') AS p, array_to_string(t[a + 1:b], '') AS m, array_to_string(t[b + 1:], '') AS s FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256 FROM p
"""
