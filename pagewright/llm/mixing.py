"""Mixing sources to target weights by min-cost flow over membership patterns.

Documents are aggregated by the set of sources they belong to (the pattern).
On the driver, where there is one row a pattern, a min-cost flow routes each
pattern's words to the quotas of its sources; every further repetition of a
pattern costs more than the one before (convex), so repeats are used only where
a quota can't be met without.  Each pattern's flow is then spread over its
documents: all of them ``flow // words`` times, and in a seeded order a prefix
once more up to the remainder.

What reaches the driver is one row a pattern, whose number follows the sources
and not the documents.  The flow is found level by level of the repetition costs,
each a maximum flow by blocking flows, so many patterns take no long search each.

In the seeded order only the hash bucket in which a pattern's remainder ends needs
an order within; documents before it are taken once more and those after it
aren't, so no others are sorted or moved.

Defined cases: a null or empty text has size 0; a null source is a source of its own,
last in order; documents of size 0 are taken 0 times; ids that repeat are
ordered by size too, so reruns agree; a very long text is one document, taken in
part at most once a pattern; other columns, whatever they are called, go along; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import boxed, materialize, unboxed

#: Documents in a hash bucket of the seeded order, about: one bucket a pattern is sorted.
BUCKET_ROWS = 20_000
#: Patterns whose plan is broadcast at most, some hundred bytes each.
BROADCAST_PATTERNS = 10_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: dict, weights: Sequence[float], share: float, cap: float) -> dict:
    """Targets by source: ``share`` of all sizes dealt by weight, none above
    ``cap`` times its source's size, the excess dealt again by weight."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), list(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > cap * sizes[s]]
        if not over:
            out |= {s: left * weight[s] / total for s in open_}
            break
        out |= {s: float(cap * sizes[s]) for s in over}
        left -= sum(cap * sizes[s] for s in over)
        open_ = [s for s in open_ if s not in out]
    return out


def min_cost_flow(patterns: list[tuple[frozenset, int]], quotas: dict, repeats: int) -> list[dict]:
    """For each pattern, the words that each of its sources gets from it.

    The e-th repetition of a word costs e - 1 and all other arcs cost nothing, so a
    shortest path costs what its first arc does: with the room of each level added
    in turn, maximum flows (by Dinic's blocking flows) are flows of least cost.
    Words are whole numbers.
    """
    n, names = len(patterns), list(quotas)
    at = {s: 1 + n + i for i, s in enumerate(names)}
    end = 1 + n + len(names)
    to: list[int] = []
    room: list[int] = []
    graph: list[list[int]] = [[] for _ in range(end + 1)]

    def arc(a: int, b: int, most: int) -> int:
        graph[a].append(len(to))
        graph[b].append(len(to) + 1)
        to.extend((b, a))
        room.extend((most, 0))
        return len(to) - 2

    supply = [arc(0, 1 + i, 0) for i in range(n)]
    routes: list[list[tuple]] = []
    for i, (members, size) in enumerate(patterns):
        routes.append([(s, arc(1 + i, at[s], (size or 0) * repeats)) for s in sorted((m for m in members if m in at), key=lambda m: (m is None, m or ""))])
    for s in names:
        arc(at[s], end, quotas[s])

    def levels() -> list[int]:
        far, line = [-1] * (end + 1), [0]
        far[0] = 0
        for a in line:
            for e in graph[a]:
                if room[e] and far[to[e]] < 0:
                    far[to[e]] = far[a] + 1
                    line.append(to[e])
        return far

    for _ in range(repeats):
        for i, (_, size) in enumerate(patterns):
            room[supply[i]] += size or 0
        while (far := levels())[end] >= 0:
            after, path, a = [0] * (end + 1), [], 0
            while True:
                if a == end:
                    sent = min(room[e] for e in path)
                    for e in path:
                        room[e] -= sent
                        room[e ^ 1] += sent
                    full = next(k for k, e in enumerate(path) if not room[e])
                    a = to[path[full] ^ 1]
                    del path[full:]
                while after[a] < len(graph[a]) and not (room[e := graph[a][after[a]]] and far[to[e]] == far[a] + 1):
                    after[a] += 1
                if after[a] < len(graph[a]):
                    path.append(e)
                    a = to[e]
                elif path:
                    a = to[path.pop() ^ 1]
                    after[a] += 1
                else:
                    break
    return [{s: room[e ^ 1] for s, e in own if room[e ^ 1]} for own in routes]


def _key(sources: Column) -> Column:
    """A pattern as text: the sorted distinct members, null last."""
    return F.to_json(F.array_sort(F.array_distinct(sources)), {"ignoreNullFields": "false"})


def _keyed(docs: DataFrame, seed: str, sources: Column | None, id_col: str, extra: list[Column]) -> DataFrame:
    """doc_id, members, pattern and h, the place in the seeded order, of each row, and ``extra``."""
    sources = F.array(F.col("source").cast("string")) if sources is None else sources
    rows = docs.select(*extra, F.col(id_col).cast("long").alias("doc_id"), sources.alias("members"))
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    return rows.withColumn("pattern", F.coalesce(_key(F.col("members")), F.lit("[]"))).withColumn("h", order)


def _planned(rows: DataFrame, weights: Sequence[float], share: float, repeats: int) -> tuple[DataFrame, int, dict]:
    """A plan (pattern, whole, edge, left): how often all of a pattern is taken, the
    hash bucket in which its remainder ends and how much of that bucket belongs to it
    (null without a remainder); the digits of buckets; sizes and targets by source."""
    found = rows.groupBy("pattern").agg(F.sum("size").alias("size"), F.first("members").alias("members"), F.count("*").alias("n")).collect()  # a row a pattern
    found.sort(key=lambda r: r.pattern)
    patterns = [(frozenset(r.members or ()), r["size"]) for r in found]
    sizes: dict = {}
    for members, size in patterns:
        for s in members:
            sizes[s] = sizes.get(s, 0) + size
    targets = source_targets(sizes, weights, share, repeats)
    flows = min_cost_flow(patterns, {s: int(t + 0.5) for s, t in targets.items()}, repeats)
    digits = 1
    while found and max(r["n"] for r in found) > BUCKET_ROWS << 4 * digits:
        digits += 1
    words = [sum(f.values()) for f in flows]
    rest = [(r.pattern, w // r["size"], w % r["size"]) if r["size"] else (r.pattern, 0, 0) for r, w in zip(found, words, strict=True)]
    plan = rows.sparkSession.createDataFrame(rest, "pattern string, whole long, rest long")
    upto = F.sum("s").over(Window.partitionBy("pattern").orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    sums = rows.withColumn("b", F.substring("h", 1, digits)).groupBy("pattern", "b").agg(F.sum("size").alias("s")).withColumn("upto", upto)
    ends = sums.join(plan, "pattern").where((F.col("rest") > 0) & (F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("s") <= F.col("rest")))
    plan = plan.join(ends.select("pattern", F.col("b").alias("edge"), (F.col("rest") - F.col("upto") + F.col("s")).alias("left")), "pattern", "left")
    plan = materialize(plan.select("pattern", "whole", "edge", "left"), "plan", len(rest))
    if len(rest) <= BROADCAST_PATTERNS:
        plan = F.broadcast(plan)
    return plan, digits, {s: (sizes[s], targets[s]) for s in sizes}


def _before() -> Column:
    """Words of the same pattern's bucket that come first in the seeded order."""
    return F.sum("size").over(Window.partitionBy("pattern").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")


_CLEAR = "edge is null or b <> edge"
#: What a document before the edge is taken beside whole repetitions: once more.
_ONCE_MORE = "case when b < edge then 1 else 0 end"


def mixture(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, repeats: int = 2, seed: str = "mix", sources: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, pattern, members and taken (words, repeats counted).

    ``sources``: an array column of the sources a document belongs to; the
    default is the single column source.  ``weights`` repeat over the sources by
    code point.  The result's attribute ``targets`` maps a source to (size,
    target).
    """
    rows = materialize(_keyed(docs, seed, sources, id_col, [word_count(F.col(text_col)).alias("size")]), "sizes")
    plan, digits, targets = _planned(rows, weights, share, repeats)
    rows = rows.withColumn("b", F.substring("h", 1, digits)).join(plan, "pattern")
    own = ["doc_id", "size", "pattern", "members"]
    clear = rows.where(_CLEAR).select(*own, ((F.col("whole") + F.expr(_ONCE_MORE)) * F.col("size")).cast("long").alias("taken"))
    part = F.greatest(F.lit(0), F.least(F.col("left") - F.col("before"), F.col("size")))
    close = rows.where("b = edge").withColumn("before", _before()).select(*own, (F.col("whole") * F.col("size") + part).cast("long").alias("taken"))
    out = clear.unionByName(close)
    out.targets = targets
    return out


def mix_documents(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, repeats: int = 2, seed: str = "mix", sources: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it.

    A document of which only a part is taken beyond its whole repetitions (there
    is one a pattern) is rounded to the nearer number; documents without words
    take no room and stay once.  Rows stay where they are but for those of one
    hash bucket a pattern, which are put in order.
    """
    text = F.col(text_col)
    sizes = materialize(_keyed(docs, seed, sources, id_col, [word_count(text).alias("size")]), "sizes")
    plan, digits, _ = _planned(sizes, weights, share, repeats)
    rows = _keyed(docs, seed, sources, id_col, [boxed(docs), text.alias("text")]).withColumn("b", F.substring("h", 1, digits)).join(plan, "pattern")
    blank = ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    clear = rows.where(_CLEAR).select("row", F.when(blank, 1).otherwise(F.col("whole") + F.expr(_ONCE_MORE)).cast("int").alias("times"))
    close = rows.where("b = edge").withColumn("size", word_count(F.col("text"))).withColumn("before", _before())
    part = F.greatest(F.lit(0), F.least(F.col("left") - F.col("before"), F.col("size")))
    rounded = F.col("whole") + F.floor((2 * part + F.col("size")) / (2 * F.greatest("size", F.lit(1))))
    close = close.select("row", F.when(F.col("size") == 0, 1).otherwise(rounded).cast("int").alias("times"))
    out = clear.unionByName(close).where("times > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select(*unboxed(docs.columns))


def op10_source_mix(spark, sf_dir: str) -> DataFrame:
    """The contract's columns for all documents, one source each."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    out = mixture(docs)
    of = spark.createDataFrame([(s, int(n), float(t)) for s, (n, t) in out.targets.items()], T.StructType([T.StructField("s", T.StringType()), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType())]))
    return out.join(of, F.col("members")[0].eqNullSafe(F.col("s"))).select("doc_id", "size", "source_size", "target", "taken")


OP10_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, (CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END)::BIGINT AS weight FROM s),
r AS (SELECT *, row_number() OVER (ORDER BY 2.0 * source_size / weight, source NULLS LAST) AS k FROM w),
p AS (SELECT *, 1.5 * (sum(source_size) OVER ()) - 2 * coalesce(sum(source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b_left,
  (sum(weight) OVER ()) - coalesce(sum(weight) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w_left FROM r),
f AS (SELECT min(k) AS k FROM p WHERE b_left::DOUBLE * weight / w_left::DOUBLE <= 2 * source_size),
t AS (SELECT p.source, p.source_size, CASE WHEN p.k < f.k THEN 2.0::DOUBLE * p.source_size ELSE (SELECT b_left::DOUBLE FROM p q WHERE q.k = f.k) * p.weight / (SELECT w_left::DOUBLE FROM p q WHERE q.k = f.k) END AS target FROM p, f),
x AS (SELECT d.doc_id, d.size, t.source_size, t.target, floor(t.target + 0.5)::BIGINT AS quota,
  (sum(d.size) OVER (PARTITION BY d.source ORDER BY md5('mix:' || coalesce(d.doc_id::VARCHAR, '')), d.doc_id, d.size ROWS UNBOUNDED PRECEDING))::BIGINT AS upto
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target::DOUBLE AS target,
  (CASE WHEN source_size = 0 THEN 0 ELSE (quota // source_size) * size + greatest(0, least(quota % source_size - (upto - size), size)) END)::BIGINT AS taken FROM x
"""
