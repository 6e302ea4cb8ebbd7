"""Near-duplicate vectors by PCA-ordered tiled comparison.

Equal vectors are one class.  The classes' unit vectors are rotated into the
order of their principal components (of the d x d second moments, all that the
driver gets beside a bounded sample).  A k-d tree over the leading ``LEAD``
components, fitted on ``SAMPLE`` vectors at most, deals them into tiles that are
small boxes; the sample only shapes the tiles, never the result.  Two tiles are
compared only if their boxes come closer than two unit vectors at the threshold
can be, which is decided on the boxes alone before any vector moves.  In a pair
of tiles the products of the leading dimensions are accumulated first; what the
others can add is bounded by the product of the suffix norms, and a pair is given
up as soon as it can't reach the threshold.  Survivors are confirmed by the
cosine of the original vectors in double precision.

Tiles that lie together in the tree are compared in blocks of ``SIDE`` by
``SIDE``, so a tile is sent once to a block and not once to a partner.  A block
returns, for each vector, how many it links (weighted by the classes' sizes) and
a spanning forest of its links, never the links themselves.

Defined cases: vectors that are null, empty, zero, or hold a null or a
non-finite component link with nothing; all others link, however large or small
their components are; vectors of different lengths aren't compared; rows that
repeat an id count as vectors of their own and share the component; ties need no
order, as a component's name is its smallest id; a very long vector makes its
tiles' blocks smaller, down to one pair of tiles; other columns are ignored,
whatever they are called; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, materialize
from .components import connected_components

TILE = 2048
#: Components that shape the tiles, vectors that shape the tree, and tiles on a side of a block.
LEAD = 8
SAMPLE = 16_384
SIDE = 4
BLOCK_BYTES = 4 << 20
STEPS = (8, 16, 32, 64, 128, 256, 512)
#: What single precision may miss before a pair is confirmed in double.
SLACK = 1e-4


def prepared(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, dim, key, raw of each row; the last three are null for vectors that can't link."""
    wide = not isinstance(vectors.schema[vector_col].dataType.elementType, T.FloatType)
    kind = np.float64 if wide else np.float32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims, keys, raws = [], [], []
            col = b.column(1)
            for i in range(len(col)):
                x = col[i].values if col[i].is_valid else None
                ok = x is not None and len(x) and not x.null_count
                v = x.to_numpy(zero_copy_only=False).astype(kind) + kind(0) if ok else None  # + 0: one zero only
                ok = ok and bool(np.isfinite(v).all()) and bool(v.any())
                dims.append(len(v) if ok else None)
                keys.append(xxhash.xxh3_128_digest(v.tobytes()) if ok else None)
                raws.append(v.tobytes() if ok else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(dims, pa.int32()), pa.array(keys, pa.binary()), pa.array(raws, pa.binary())], ["vec_id", "dim", "key", "raw"])

    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>" if wide else "array<float>").alias("x"))
    return rows.mapInArrow(run, "vec_id long, dim int, key binary, raw binary")


def units(raw: list[bytes], wide: bool, rows: int | None = None) -> np.ndarray:
    """Unit vectors in double precision, from a string each or from ``rows`` in one;
    scaled by their largest component first, so that no square over- or underflows."""
    x = np.frombuffer(b"".join(raw), np.float64 if wide else np.float32).astype(np.float64).reshape(rows or len(raw), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def principal(reps: DataFrame, dim: int, wide: bool) -> np.ndarray:
    """The rotation whose columns are the eigenvectors of the second moments, largest first."""
    upper = np.triu_indices(dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                y = units(b.column(0)[at : at + 4096].to_pylist(), wide)
                total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(upper[0]))), pa.array(total[upper])], ["i", "x"])

    found = reps.select("raw").mapInArrow(run, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).toPandas()
    m = np.zeros((dim, dim))
    m[upper[0][found.i], upper[1][found.i]] = found.x
    _, v = np.linalg.eigh(m + np.triu(m, 1).T)
    return v[:, ::-1].copy()


_TILE = np.dtype([("id", "<i8"), ("m", "<i8")])


def reach_of(cosine: float) -> float:
    """How far unit vectors with that cosine can be apart in one coordinate."""
    return float(np.sqrt(max(0.0, 2 - 2 * cosine)) + 1e-6)


class Tree:
    """A k-d tree that halves a sample: the splits in heap order, leaves from left to right."""

    def __init__(self, points: np.ndarray, leaves: int):
        self.depth = max(0, int(np.ceil(np.log2(max(1, leaves)))))
        while self.depth and len(points) < 2 << self.depth:  # two of the sample to a leaf at least
            self.depth -= 1
        self.axis, self.cut = np.zeros(1 << self.depth, np.int64), np.zeros(1 << self.depth)
        own = {1: points}
        for i in range(1, 1 << self.depth):
            x = own.pop(i)
            if len(x):
                self.axis[i] = int(np.argmax(x.max(axis=0) - x.min(axis=0)))
                self.cut[i] = float(np.median(x[:, self.axis[i]]))
            low = x[:, self.axis[i]] <= self.cut[i]
            own[2 * i], own[2 * i + 1] = x[low], x[~low]

    def leaf(self, points: np.ndarray) -> np.ndarray:
        at = np.ones(len(points), np.int64)
        for _ in range(self.depth):
            at = 2 * at + (points[np.arange(len(points)), self.axis[at]] > self.cut[at])
        return at - (1 << self.depth)


def tiles_of(reps: DataFrame, basis: np.ndarray, wide: bool, count: int) -> DataFrame:
    """A row for each tile: its leaf and number there, the box of its leading
    components, ids and sizes, and vectors."""
    axes = basis[:, :LEAD].copy()
    sample = reps.where(F.pmod(F.xxhash64("key", F.lit(7)), F.lit(max(1, -(-count // (SAMPLE // 2))))) == 0).select("raw").limit(SAMPLE).toPandas()["raw"].tolist()
    tree = Tree(units(sample, wide) @ axes if sample else np.zeros((0, axes.shape[1])), -(-count // TILE))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield b.append_column("leaf", pa.array(tree.leaf(units(b.column(2).to_pylist(), wide) @ axes)))

    def block(table: pa.Table) -> pa.Table:
        table = table.take(pa.array(np.argsort(table.column("vec_id").to_numpy(), kind="stable")))
        head = np.empty(table.num_rows, _TILE)
        head["id"], head["m"] = table.column("vec_id").to_numpy(), table.column("m").to_numpy()
        raw = table.column("raw").to_pylist()
        y = units(raw, wide) @ axes
        leaf, sub = (table.column(c)[0].as_py() for c in ("leaf", "sub"))
        columns = ([leaf], [sub], [y.min(axis=0).tolist()], [y.max(axis=0).tolist()], [head.tobytes()], [b"".join(raw)])
        types = (pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.binary(), pa.binary())
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["leaf", "sub", "low", "high", "head", "body"])

    dealt = materialize(reps.select("vec_id", "m", "raw").mapInArrow(deal, "vec_id long, m long, raw binary, leaf long"), "dealt")
    # leaves that ties make larger than the sample foretold are cut by hash, each by its own size
    parts = dealt.groupBy("leaf").agg(F.ceil(F.count("*") / (2 * TILE)).alias("parts"))
    cut = dealt.join(parts, "leaf").withColumn("sub", F.pmod(F.xxhash64("vec_id", "raw"), F.col("parts"))).drop("parts")
    tiles = materialize(cut.groupBy("leaf", "sub").applyInArrow(block, "leaf long, sub long, low array<double>, high array<double>, head binary, body binary"), "tiles")
    discard(dealt)
    return tiles


def near_tiles(tiles: DataFrame, reach: float, side: int) -> DataFrame:
    """Pairs of tiles (a, b structs of leaf and sub, a <= b) whose boxes come within
    ``reach``, and the blocks that they belong to."""
    bins = lambda x: F.floor(x / reach).cast("long")
    box = tiles.select(F.struct("leaf", "sub").alias("t"), "low", "high", bins(F.col("low")[0] - reach / 2).alias("first"), bins(F.col("high")[0] + reach / 2).alias("last"))
    one = lambda p: box.select(*(F.col(c).alias(f"{p}_{c}") for c in ("t", "low", "high", "first")), F.explode(F.sequence("first", "last")).alias("bin"))
    pairs = one("a").join(one("b"), "bin").where((F.col("a_t") <= F.col("b_t")) & (F.col("bin") == F.greatest("a_first", "b_first")))
    gaps = F.zip_with(F.zip_with("b_low", "a_high", lambda x, y: x - y), F.zip_with("a_low", "b_high", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0)))
    pairs = pairs.where(F.aggregate(gaps, F.lit(0.0), lambda acc, g: acc + g * g) <= reach * reach)
    group = lambda t: F.struct(F.floor(F.col(f"{t}.leaf") / side).cast("long").alias("leaf"), F.floor(F.col(f"{t}.sub") / side).cast("long").alias("sub"))
    return pairs.select(F.struct(group("a_t").alias("a"), group("b_t").alias("b")).alias("block"), F.col("a_t").alias("a"), F.col("b_t").alias("b"))


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index of each index's component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def linked(x: np.ndarray, y: np.ndarray | None, basis: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of the unit rows of x and y (of x alone, i < j) with the cosine or more."""
    a = (x @ basis).astype(np.float32)
    b = a if y is None else (y @ basis).astype(np.float32)
    dim = a.shape[1]
    stops = [s for s in STEPS if s < dim] + [dim]
    tail = lambda m: [np.sqrt(np.square(m[:, s:], dtype=np.float64).sum(axis=1)).astype(np.float32) for s in stops]
    ta, tb, at_least = tail(a), tail(b), np.float32(cosine - SLACK)
    found_i, found_j = [], []
    for r in range(0, len(a), 256):
        own, first = a[r : r + 256], stops[0]
        part = own[:, :first] @ b[:, :first].T
        i, j = np.nonzero(part + ta[0][r : r + 256, None] * tb[0][None, :] >= at_least)
        if y is None:
            later = j > i + r
            i, j = i[later], j[later]
        part = part[i, j]
        for k in range(1, len(stops)):
            if not len(i):
                break
            low, high = stops[k - 1], stops[k]
            for c in range(0, len(i), 1 << 16):
                s = slice(c, c + (1 << 16))
                part[s] += np.einsum("ij,ij->i", own[i[s], low:high], b[j[s], low:high])
            keep = part + ta[k][r + i] * tb[k][j] >= at_least
            i, j, part = i[keep], j[keep], part[keep]
        other = x if y is None else y
        for c in range(0, len(i), 1 << 15):
            ii, jj = i[c : c + (1 << 15)] + r, j[c : c + (1 << 15)]
            keep = np.einsum("ij,ij->i", x[ii], other[jj]) >= cosine
            found_i.append(ii[keep]), found_j.append(jj[keep])
    none = np.zeros(0, np.int64)
    return np.concatenate(found_i or [none]), np.concatenate(found_j or [none])


def compare(tiles: DataFrame, basis: np.ndarray, wide: bool, cosine: float) -> DataFrame:
    """u, v, n: for v null, how many vectors u links; else an edge of a tile pair's forest."""
    side = max(1, min(SIDE, BLOCK_BYTES // (TILE * len(basis) * (8 if wide else 4))))
    pairs = near_tiles(tiles, reach_of(cosine), side)
    # what a block needs: each tile once, with the partners that it is compared with
    first = pairs.groupBy("block", F.col("a").alias("t")).agg(F.collect_list("b").alias("with"))
    needed = first.unionByName(pairs.select("block", F.col("b").alias("t"), F.array().cast("array<struct<leaf:bigint,sub:bigint>>").alias("with")).distinct())
    needed = needed.groupBy("block", "t").agg(F.flatten(F.collect_list("with")).alias("with"))
    sent = needed.join(tiles.select(F.struct("leaf", "sub").alias("t"), "head", "body"), "t").select("block", "t", "with", "head", "body")

    def run(table: pa.Table) -> pa.Table:
        rows = {(r["t"]["leaf"], r["t"]["sub"]): r for r in table.to_pylist()}
        out = []
        for at, r in sorted(rows.items()):
            if not r["with"]:
                continue
            ha = np.frombuffer(r["head"], _TILE)
            x = units([r["body"]], wide, len(ha))
            for other in sorted((t["leaf"], t["sub"]) for t in r["with"]):
                hb, same = np.frombuffer(rows[other]["head"], _TILE), other == at
                y = None if same else units([rows[other]["body"]], wide, len(hb))
                i, j = linked(x, y, basis, cosine)
                if not len(i):
                    continue
                ids, m = (ha["id"], ha["m"]) if same else (np.concatenate((ha["id"], hb["id"])), np.concatenate((ha["m"], hb["m"])))
                if not same:
                    j = j + len(ha)
                n = np.bincount(i, m[j], len(ids)) + np.bincount(j, m[i], len(ids))
                root = _roots(len(ids), i, j)
                who, edge = np.flatnonzero(n), np.flatnonzero(root != np.arange(len(ids)))
                v = pa.array([None] * len(who) + ids[edge].tolist(), pa.int64())
                out.append(pa.table({"u": pa.array(np.concatenate((ids[who], ids[root[edge]]))), "v": v, "n": pa.array(np.concatenate((n[who].astype(np.int64), np.zeros(len(edge), np.int64))))}))
        none = pa.array([], pa.int64())
        return pa.concat_tables(out) if out else pa.table({"u": none, "v": none, "n": none})

    return sent.groupBy("block").applyInArrow(run, "u long, v long, n long")


def near_vectors(vectors: DataFrame, cosine: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component of each row of ``vectors``."""
    rows = materialize(prepared(vectors, id_col, vector_col), "vectors")
    good = rows.where("key is not null and vec_id is not null")
    counted = good.groupBy("dim", "key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("m"))
    # the numbers are read back as written, so they are the same wherever they are used
    classes = materialize(counted.select(F.monotonically_increasing_id().alias("cls"), "dim", "key", "rep", "m"), "classes")
    wide = not isinstance(vectors.schema[vector_col].dataType.elementType, T.FloatType)
    found, scratch = None, []
    for r in classes.groupBy("dim").count().orderBy("dim").collect():  # one row a vector length
        reps = good.where(F.col("dim") == r["dim"]).join(classes.select(F.col("rep").alias("vec_id"), "key", "cls", "m"), ["vec_id", "key"]).dropDuplicates(["key"]).select(F.col("cls").alias("vec_id"), "key", "m", "raw")
        basis = principal(reps, r["dim"], wide)
        scratch.append(tiles := tiles_of(reps, basis, wide, r["count"]))
        one = compare(tiles, basis, wide, cosine)
        found = one if found is None else found.unionByName(one)
    spark = vectors.sparkSession
    found = materialize(found, "links") if found is not None else spark.createDataFrame([], "u long, v long, n long")
    discard(*scratch)
    links = found.where("v is null").groupBy(F.col("u").alias("cls")).agg(F.sum("n").alias("links"))
    rep = lambda c: classes.select(F.col("cls").alias(c), F.col("rep").alias(f"{c}_rep"))
    edges = found.where("v is not null").select("u", "v").join(rep("u"), "u").join(rep("v"), "v").select(F.col("u_rep").alias("u"), F.col("v_rep").alias("v"))
    # an id with several vectors ties their classes together
    several = good.groupBy("vec_id").agg(F.min("key").alias("a"), F.max("key").alias("b")).where("a <> b").select("vec_id")
    ties = good.join(several, "vec_id").join(classes.select("key", "rep"), "key").select(F.col("rep").alias("u"), F.col("vec_id").alias("v")).distinct()
    cc = connected_components(edges.unionByName(ties)).withColumnRenamed("node", "rep")
    of = classes.join(links, "cls", "left").join(cc, "rep", "left").select("key", (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    return rows.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("key")).alias("key")).join(of, "key", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component"))


def op7_pca_vector_dedup(spark, sf_dir: str) -> DataFrame:
    """The contract's columns for all embeddings at a cosine of 0.95."""
    found = near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    return found.select("vec_id", "n_links", F.col("component").alias("component_id"), F.coalesce(F.col("vec_id") == F.col("component"), F.lit(True)).alias("kept"))


OP7_SQL = r"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND list_aggregate(list_transform(embedding, lambda c: abs(c)), 'max') > 0),
p AS (SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.95),
r(node, root) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT p.v, r.root FROM r JOIN p ON p.u = r.node),
c AS (SELECT node, min(root) AS component_id FROM r GROUP BY node),
n AS (SELECT u, count(*) AS n FROM p GROUP BY u)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN c ON c.node = e.vec_id LEFT JOIN n ON n.u = e.vec_id
"""
