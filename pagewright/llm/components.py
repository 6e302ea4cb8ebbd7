"""Connected components of an edge table, without gathering edges anywhere.

Each round is a large-star and a small-star step (Kiveris et al., "Connected
Components in MapReduce and Beyond", 2014): every node links its larger
neighbours, then its smaller ones, to the smallest node it knows.  The minima
are map-side combined and the joins are plain equi-joins that AQE can split, so
a node with a large share of all edges doesn't land in one task.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def spanning(pairs: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Edges (root, node) of a forest with the components of ``pairs``."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        r = x
        while (p := up.get(r, r)) != r:
            r = p
        while (p := up.get(x, x)) != r:
            up[x] = r
            x = p
        return r

    for a, b in pairs:
        a, b = top(a), top(b)
        if a != b:
            a, b = min(a, b), max(a, b)
            up[b] = a
            up.setdefault(a, a)
    return [(top(x), x) for x in up if top(x) != x]


def _thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest of each batch's edges: no more rows than came."""
    for b in batches:
        kept = spanning(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in kept], pa.int64()), pa.array([y for _, y in kept], pa.int64())], ["u", "v"])


def _sum(df: DataFrame) -> tuple[int, int]:
    r = df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    return r[0], int(r[1] or 0)


def connected_components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v), both long; ``rows``: about how many edges there are at most.

    component is the smallest node reachable.  Null ends and self-loops are
    dropped, repeated edges count once; an empty table gives an empty table.
    """
    e = edges.select(F.least("u", "v").cast("long").alias("u"), F.greatest("u", "v").cast("long").alias("v")).where("u is not null and v is not null and u < v")
    e = e.mapInArrow(_thin, "u long, v long").distinct()
    e = materialize(e, "edges", rows)
    seen = _sum(e)
    while seen[0]:  # ends: every round but the last lowers an end of some edge
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").where("v <> m").select(F.col("m").alias("u"), "v").distinct()
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").select(F.explode(F.array(F.struct(F.col("m").alias("u"), "v"), F.struct(F.least("m", "u").alias("u"), F.greatest("m", "u").alias("v")))).alias("e")).select("e.*").where("u < v")
        before, e = e, materialize(small.distinct(), "edges", 2 * seen[0])
        discard(before)
        now = _sum(e)
        if now == seen:
            break
        seen = now
    return e.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("component")).unionByName(e.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())


def with_components(nodes: DataFrame, id_col: str, edges: DataFrame) -> DataFrame:
    """``nodes`` with component: its own id where ``edges`` don't reach it."""
    cc = connected_components(edges)
    return nodes.join(cc.withColumnRenamed("node", id_col), id_col, "left").withColumn("component", F.coalesce("component", F.col(id_col)))
