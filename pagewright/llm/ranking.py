"""Ranked lexical search over a hierarchical max tree of document ranges.

The index is a table of blocks.  A block has documents in order of their ids, up
to ``BLOCK`` of them or as many as keep its tree within ``CELLS`` numbers, and the
postings of the terms that the queries ask for.  Above its
documents stands, for each term, a tree of maxima: ranges of ``FAN`` documents,
ranges of ``FAN`` such ranges, up to the whole block.

A query is searched best first.  The bound of a range is the sum of its terms'
weights times their maxima there; the range with the highest bound is opened, and
a document's bound is its score.  The search ends where no bound reaches the
score of rank k; ranges whose bound equals that score are opened too, as they may
hold documents of equal score and smaller id.

Over the blocks this is done in two rounds, which read the index only: every task
names the few blocks with the highest bounds for each query, these are searched,
and the k-th score found is a floor for the second round, in which a block is
opened only where its bound reaches the floor of the query.  The best k of all
blocks are then ranked by windows.

Queries come in sets of at most ``ITEMS`` with at most ``VOCABULARY`` bytes of
distinct terms, so what is sent to every task (terms, weights, floors) has a
bound; each set takes a pass of its own over the documents.

Defined cases: null or empty texts hold no term and are never found; a null id is
found under null, behind all other ids of equal score; rows that repeat an id are
documents of their own, in the order of the index where scores are equal; queries
without a term find nothing; ties go to the smaller id; a very long text is one
row of one batch; other columns are ignored, whatever they are called; an empty
table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, documents_only, materialize, slices, utf8

#: Documents of a block and children of a range; BLOCK is a power of FAN.
BLOCK, FAN = 4096, 16
#: Terms times documents of a block: what its lowest level holds.
CELLS = 1 << 24
#: Queries of one pass, and bytes of their distinct terms.
ITEMS, VOCABULARY = 1000, 4 << 20
#: Blocks that a task names for each query in the first round.
FIRST = 2
#: Fixed values of the score: percent of length normalisation, saturation, scale.
LENGTH, SATURATION, SCALE = 25, 12, 1_000_000_000

_SPACED = bytes(c if 0x30 <= c <= 0x39 or 0x41 <= c <= 0x5A or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def terms(text: bytes) -> list[bytes]:
    """Runs of ASCII letters, digits and anything beyond ASCII; A-Z lower-cased."""
    return text.translate(_SPACED).lower().split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def length_factor(n: int, n_docs: int, n_terms: int) -> int:
    return 100 - LENGTH + (LENGTH * n * n_docs) // n_terms


def block_for(terms_asked: int, most: int = BLOCK) -> int:
    while most > FAN and most * terms_asked > CELLS:
        most //= FAN
    return most


def _index(vocabulary: dict[bytes, int], block: int):
    """Documents to blocks: ids, numbers of terms, and postings by term in order of
    the vocabulary (term, document's place, occurrences)."""

    def packed(held: list[tuple]) -> pa.RecordBatch:
        held.sort(key=lambda x: (x[0] is None, x[0]))
        term, tf = (np.concatenate([x[2][i] for x in held]) for i in (0, 1))
        at = np.repeat(np.arange(len(held)), [len(x[2][0]) for x in held])
        order = np.argsort(term, kind="stable")
        n = [x[1] for x in held]
        raw = [x[order].astype(kind).tobytes() for x, kind in ((term, np.int32), (at, np.int16), (tf, np.int32))]
        return pa.RecordBatch.from_arrays([pa.array([[x[0] for x in held]], pa.list_(pa.int64())), pa.array([n], pa.list_(pa.int64())), *(pa.array([x], pa.binary()) for x in raw)], ["ids", "n", "term", "at", "tf"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in slices(batches, "text"):
            for ident, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                found = terms(text)
                if not found:
                    continue
                asked = {vocabulary[t]: c for t, c in Counter(found).items() if t in vocabulary}
                held.append((ident, len(found), (np.fromiter(asked, np.int32, len(asked)), np.fromiter(asked.values(), np.int32, len(asked)))))
                if len(held) == block:
                    yield packed(held)
                    held = []
        if held:
            yield packed(held)

    return run


_BLOCKS = "ids array<long>, n array<long>, term binary, at binary, tf binary"


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """term, df of the blocks of a task."""
    total: Counter = Counter()
    for b in batches:
        for raw in b.column(0).to_pylist():
            term, df = np.unique(np.frombuffer(raw, np.int32), return_counts=True)
            total.update(dict(zip(term.tolist(), df.tolist(), strict=True)))
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.int64())], ["term", "df"])


class Tree:
    """The maxima of a block, level by level; the last level is its documents."""

    def __init__(self, row: dict, n_docs: int, n_terms: int):
        self.ids = row["ids"]
        term, at, tf = (np.frombuffer(row[c], k) for c, k in (("term", np.int32), ("at", np.int16), ("tf", np.int32)))
        m = np.array([length_factor(n, n_docs, n_terms) for n in row["n"]], np.int64)
        impact = (SCALE * tf.astype(np.int64)) // (1000 * tf.astype(np.int64) + SATURATION * m[at])
        self.row = {int(t): i for i, t in enumerate(np.unique(term))}
        place = np.searchsorted(np.unique(term), term)
        depth = 0
        while FAN**depth < len(self.ids):
            depth += 1
        leaves = np.zeros((len(self.row), FAN**depth), np.int32)  # an impact is under a million
        leaves[place, at] = impact
        self.levels = [leaves]
        while self.levels[0].shape[1] > 1:
            below = self.levels[0]
            self.levels.insert(0, below.reshape(len(self.row), -1, FAN).max(axis=2))

    def prepared(self, query: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the query's terms that the block has, and their weights."""
        here = [(self.row[t], w) for t, w in query.items() if t in self.row and w]
        return np.array([x[0] for x in here], np.int64), np.array([x[1] for x in here], np.int64)

    def bounds(self, rows: np.ndarray, w: np.ndarray, level: int, first: int, last: int) -> np.ndarray:
        return w @ self.levels[level][rows, first:last].astype(np.int64) if len(rows) else np.zeros(last - first, np.int64)

    def best(self, query: dict[int, int], k: int, floor: int = 1, opened: list | None = None) -> list[tuple[int, int]]:
        """The k best (score, document's place) with scores of at least ``floor``, equal
        scores by place; ``opened``, if given, gets the ranges opened."""
        rows, w = self.prepared(query)
        leaf = len(self.levels) - 1
        heap = [(-int(self.bounds(rows, w, 0, 0, 1)[0]), 0, 0)]
        found: list[tuple[int, int]] = []
        while heap:
            bound, level, at = heapq.heappop(heap)
            bound = -bound
            if bound < floor or len(found) >= k and bound < found[k - 1][0]:
                break
            if level == leaf:
                found.append((bound, at))
                continue
            if opened is not None:
                opened.append((level, at))
            below = self.bounds(rows, w, level + 1, at * FAN, (at + 1) * FAN)
            for i in np.flatnonzero(below >= floor):
                heapq.heappush(heap, (-int(below[i]), level + 1, at * FAN + int(i)))
        return sorted(found, key=lambda x: (-x[0], x[1]))[:k]


def _named(queries: list[dict[int, int]], n_docs: int, n_terms: int):
    """For each query the FIRST blocks of a task with the highest bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top: list[list[tuple[int, int]]] = [[] for _ in queries]
        for b in batches:
            for row in b.to_pylist():
                tree = Tree(row, n_docs, n_terms)
                for q, query in enumerate(queries):
                    bound = int(tree.bounds(*tree.prepared(query), 0, 0, 1)[0])
                    if bound > 0:
                        top[q] = heapq.nlargest(FIRST, [*top[q], (bound, row["block"])])
        rows = [(q, *x) for q, xs in enumerate(top) for x in xs]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int32(), pa.int64(), pa.int64()))], ["q", "bound", "block"])

    return run


def _searched(queries: list[dict[int, int]], n_docs: int, n_terms: int, k: int, floors: list[int], only: dict[int, list[int]] | None):
    """q, score, doc_id, block, at: the best of each block, for the queries of ``only`` or
    those whose floor the block's bound reaches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                tree = Tree(row, n_docs, n_terms)
                asked = range(len(queries)) if only is None else only.get(row["block"], ())
                rows = [(q, score, tree.ids[at], row["block"], at) for q in asked for score, at in tree.best(queries[q], k, floors[q])]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32()))], ["q", "score", "doc_id", "block", "at"])

    return run


_FOUND = "q int, score long, doc_id long, block long, at int"


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last(), "block", "at")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _search(docs: DataFrame, items: list[tuple], k: int, most: int) -> DataFrame:
    """One pass: q, rank, doc_id, score for the items (q, terms) of a set."""
    spark = docs.sparkSession
    vocabulary = {t: i for i, t in enumerate(sorted({t for _, ts in items for t in ts}))}
    blocks = materialize(docs.mapInArrow(_index(vocabulary, block_for(len(vocabulary), most)), _BLOCKS).withColumn("block", F.monotonically_increasing_id()), "blocks")
    n_docs, n_terms = blocks.agg(F.coalesce(F.sum(F.size("n")), F.lit(0)), F.coalesce(F.sum(F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0))).first()
    df = {r.term: r.df for r in blocks.select("term").mapInArrow(_frequencies, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()}
    w = {i: weight(n_docs, df[i]) for i in df}
    queries = [{i: c * w[i] for i, c in Counter(vocabulary[t] for t in ts).items() if i in w} for _, ts in items]
    bounds = blocks.mapInArrow(_named(queries, n_docs, n_terms), "q int, bound long, block long")
    first = bounds.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("bound"), "block"))).where(F.col("r") <= FIRST)
    only: dict[int, list[int]] = {}
    for r in first.collect():  # FIRST rows a query at most
        only.setdefault(r.block, []).append(r.q)
    floors = [1] * len(items)
    some = blocks.where(F.col("block").isin(list(only))).mapInArrow(_searched(queries, n_docs, n_terms, k, floors, only), _FOUND)
    for r in _top(some, k).where(F.col("rank") == k).collect():  # one row a query at most
        floors[r.q] = r.score
    found = materialize(_top(blocks.mapInArrow(_searched(queries, n_docs, n_terms, k, floors, None), _FOUND), k), "found", k * len(items))
    discard(blocks)
    names = spark.createDataFrame([(q, ident) for q, (ident, _) in enumerate(items)], "q int, item long")
    return found.join(F.broadcast(names), "q").select(F.col("item").alias("item_id"), "rank", "doc_id", "score")


def item_sets(items: Iterator, most_items: int = ITEMS, most_bytes: int = VOCABULARY) -> Iterator[list[tuple]]:
    """Items (id, terms) in sets within both bounds; an item too large for them is a set of its own."""
    held, size = [], 0
    for ident, text in items:
        found = terms((text or "").encode())
        more = sum(map(len, set(found)))
        if held and (len(held) == most_items or size + more > most_bytes):
            yield held
            held, size = [], 0
        held.append((ident, found))
        size += more
    if held:
        yield held


def search(docs: DataFrame, items: DataFrame, k: int = 20, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", block: int = BLOCK) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: for each item the k documents with the
    highest scores above zero."""
    spark = docs.sparkSession
    texts = documents_only(docs, doc_id, doc_text)
    asked = documents_only(items, item_id, item_text)
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for some in item_sets((r.doc_id, r.text) for r in asked.toLocalIterator()):
        out = out.unionByName(_search(texts, some, k, block))
    return out


def op11_max_tree_search(spark, sf_dir: str) -> DataFrame:
    """The contract's columns: all documents ranked for every item of ``benchmark``."""
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP11_SQL = r"""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM documents),
tf AS (SELECT doc_id, t, count(*) AS tf FROM w GROUP BY ALL),
n AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY ALL),
g AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM n),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY ALL),
q AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
r AS (SELECT item_id, t, count(*) AS r FROM q GROUP BY ALL),
s AS (SELECT item_id, doc_id, sum(r * floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM r JOIN df USING (t) JOIN tf USING (t) JOIN n USING (doc_id), g GROUP BY ALL),
k AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM k WHERE rank <= 20
"""
