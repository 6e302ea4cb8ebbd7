"""Every operator and every stage of the pipeline on input that is allowed but odd."""

import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

import corpus_pipeline as cp
from pagewright.llm import ctw, lines, minhash, mixing, packing, quality, secrets, tiff, vectors, warc

#: Names that operators use inside, names with dots and blanks, and names of results.
CLASHES = ("row", "_bad", "_hash", "a.b", "a b", "pages", "page", "h", "b", "f", "m", "th", "cls", "bucket", "shard", "pattern", "size", "taken", "score", "held_out", "component", "lines", "clean", "x", "key", "n", "u", "v")
LONG = " ".join(f"word{i % 997}" for i in range(60_000))
TEXTS = [(1, None), (2, ""), (3, " \t\n\r "), (4, "one two"), (5, "one two"), (5, "one two"), (5, "other text here"), (6, LONG), (None, "one two"), (None, None), (7, "nul\0in a\0word \0 \0\0"), (8, "é中 \U0001f600 x"), (9, "a" * 70_000), (10, "same line here, long enough to count\n" * 3 + "ok\nok"), (11, "same line here, long enough to count\nok"), (12, "user: bob password=abcdef1 host: db.example.com AKIA" + "Z" * 16)]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", None if i is None else f"s{i % 3}", len(t or ""), *(["c"] * len(CLASHES))) for i, t in TEXTS]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)
    return spark.createDataFrame(rows, schema).repartition(3)


OPERATORS = {
    "tiff": lambda d: tiff.with_payload(tiff.store(d), "media"),
    "ctw": ctw.ctw_scores,
    "minhash": minhash.near_duplicates,
    "secrets": secrets.scan,
    "quality": lambda d: quality.scores(d, quality.fit(d, d.sparkSession.read.parquet(f"{SMALL}/labels.parquet"))),
    "packing": lambda d: packing.pack(d, packing.default_tokenizer()),
    "mixing": mixing.mixture,
    "lines": lines.cleaned,
    "warc": lambda d: warc.assemble(warc.read_records(warc.write_archives(d.select(F.col("doc_id").alias("page_id"), F.lit("u\r\nv").alias("url"), F.col("text").alias("html"))))),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_operator(odd, name):
    got = OPERATORS[name](odd)
    rows = got.collect()
    if name == "packing":  # a row a piece
        assert {r.doc_id for r in rows} == {i for i, _ in TEXTS} and sum(r.start == 0 for r in rows) == len(TEXTS)
    else:
        assert len(rows) == len(TEXTS)
    assert OPERATORS[name](odd.limit(0)).count() == 0


@pytest.mark.parametrize("name, stage", cp.STAGES, ids=[n for n, _ in cp.STAGES])
def test_stage(spark, odd, name, stage):
    out = stage(spark, odd, SMALL)
    if name != "packing":
        assert out.columns == odd.columns
        assert {r["a.b"] for r in out.collect()} == {"c"}
    else:
        assert out.count() >= len(TEXTS)
    assert stage(spark, odd.limit(0), SMALL).count() == 0


def test_equal_texts_have_equal_results(odd):
    for r in (OPERATORS["tiff"](odd).select("payload", "feature"), OPERATORS["ctw"](odd).where("n_tokens = 3 and n_bytes = 8").select("score")):
        assert r.count() > 1
    scores = {x.score for x in OPERATORS["ctw"](odd).where("n_tokens = 3 and n_bytes = 8").collect()}
    assert len(scores) == 1


def test_pages_with_clashing_names(spark):
    df = spark.createDataFrame([(1, tiff.write(b"x" * 192 * 600), "p", "q", "r"), (2, None, "p", "q", "r"), (3, b"II", "p", "q", "r")], "id long, media binary, page string, `a.b` string, pages string")
    got = tiff.tiff_pages(df, "media")
    assert got.columns[:4] == ["id", "page_file", "a.b", "pages"] and got.columns.count("page") == 1
    assert sorted((r.id, r.page, r["a.b"], r.error is None) for r in got.collect()) == [(1, 0, "q", True), (1, 1, "q", True), (3, 0, "q", False)]
    assert tiff.with_pages(df, "media").columns == ["id", "media", "page", "a.b", "pages"]


def test_vectors_with_clashing_names(spark):
    rows = [(i, [float(i % 3 == k) for k in range(3)], "c", "c", "c") for i in range(9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, key string, rep string, dim string")
    assert {(r.vec_id, r.n_links, r.component) for r in vectors.near_vectors(df).collect()} == {(i, 2, i % 3) for i in range(9)}


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    from pagewright.llm import common

    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)
        getConf = staticmethod(lambda: {})

    class Session:
        conf = {}
        sparkContext = Context

    with pytest.raises(RuntimeError, match="checkpoint"):
        common.shared_dir(Session)


# ---- op8 against plain arithmetic


def test_ranking_is_the_minimum_of_its_loss(monkeypatch):
    """The weights make the pairwise logistic loss stationary, by finite differences of
    the loss written out; scores order as weighted features; the threshold is the quantile."""
    monkeypatch.setattr(quality, "FIT_PAIRS", 400)
    rng = np.random.default_rng(4)
    y = (np.arange(80) % 4 > 0).astype(int)
    x = rng.normal(size=(80, 3)) + y[:, None] * [0.8, -0.3, 0.0]
    r = quality.Ranking(x, y)
    z = np.clip((x - x.mean(axis=0)) / (x.std(axis=0) + 1e-6), -6, 6)
    draw = np.random.default_rng(7)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    pairs = list(zip(draw.choice(good, 400), draw.choice(bad, 400), strict=True))

    def loss(w):
        total = 0.0
        for a, b in pairs:
            total += np.log1p(np.exp(-sum(w[k] * (z[a][k] - z[b][k]) for k in range(3))))
        return total + 0.5 * quality.RIDGE * len(pairs) * float(w @ w)

    best = loss(r.weights)
    for k in range(3):
        step = np.eye(3)[k] * 1e-3
        assert loss(r.weights + step) > best - 1e-7 and loss(r.weights - step) > best - 1e-7
        assert abs(loss(r.weights + step) - loss(r.weights - step)) < 1e-4 * len(pairs)
    own = np.array([sum(z[i][k] * r.weights[k] for k in range(3)) for i in range(80)])
    assert (np.argsort(own) == np.argsort(r(x), kind="stable")).all()
    assert int((r(x) < 0.5).sum()) == int((y == 0).sum())


def test_quality_scores_equal_plain_python(spark):
    """Scores of documents are the ranking of their features, one by one."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").limit(40)
    ranking = quality.fit(spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet"))
    rows = docs.collect()
    got = {r.doc_id: r.score for r in quality.scores(docs, ranking).collect()}
    for r in rows:
        f = quality.features((r.text or "").encode())
        z = [max(-6.0, min(6.0, (a - m) / s)) for a, m, s in zip(f, ranking.mean, ranking.scale, strict=True)]
        want = 1 / (1 + np.exp(-(sum(a * w for a, w in zip(z, ranking.weights, strict=True)) - ranking.threshold) * ranking.slope))
        assert abs(got[r.doc_id] - want) < 1e-9


# ---- op1 against vectors that its own encoders didn't make


def test_lzw_of_the_specification():
    """Nine pixels and their codes, as the format's description lists them."""
    codes = [256, 7, 258, 8, 8, 258, 6, 6, 257]
    bits = "".join(f"{c:09b}" for c in codes)
    data = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    assert tiff.lzw_decode(data) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])


def test_packbits_of_the_specification():
    data = bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA")
    assert tiff.packbits_decode(data) == bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22" + "AA" * 10)


def test_difference_hash():
    rising = np.tile(np.arange(64, dtype=np.uint8)[None, :, None], (16, 1, 3))
    assert tiff.difference_hash(rising) == "f" * 16 and tiff.difference_hash(rising[:, ::-1]) == "0" * 16


def test_page_that_declares_too_much():
    """A small file that declares a huge page is refused before its size is reserved."""
    import struct

    fields = [(256, 4, 60_000), (257, 4, 60_000), (258, 3, 8), (259, 3, 8), (273, 4, 8), (277, 3, 1), (278, 4, 60_000), (279, 4, 20)]
    data = b"II*\0" + struct.pack("<I", 28) + b"\0" * 20 + struct.pack("<H", len(fields)) + b"".join(struct.pack("<HHIHH" if k == 3 else "<HHII", t, k, 1, *((v, 0) if k == 3 else (v,))) for t, k, v in fields) + b"\0" * 4
    (page,) = tiff.read(data)
    assert page["error"] == "data is cut off" and page["pixels"] is None
