"""Operators against brute force, and their defined cases."""

import itertools
import math
import random
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagewright.llm import common, components, ctw, lines, minhash, mixing, packing, quality, secrets, tiff, vectors, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, u string, label string, score string"


def docs_of(spark, rows):
    """Documents with columns whose names clash with those that operators use."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "r", "u", "l", "s") for i, t, s in rows], DOCS)


WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, blank, tied, repeated and very long texts, null ids and sources."""
    rng = random.Random(5)
    long = " ".join(rng.choice(WORDS) for _ in range(30_000))
    base = " ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(60))
    rows = [(1, None, "a"), (2, "", "a"), (3, " \t\n", None), (4, "one two", "b"), (5, "one two", "b"), (5, "one two", "b"), (6, long, "c"), (7, base, "c"), (8, base + " end", "c"), (9, base.upper(), None), (None, base, "a"), (10, "x" * 5000, "a"), (11, "a\nb\n" + base + "\n" + base[:-1] + "?", "d")]
    return docs_of(spark, rows), rows


@pytest.fixture(scope="module")
def none(spark):
    return docs_of(spark, []), []


# ---- components


def brute_components(nodes, edges):
    up = {n: n for n in nodes}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(rng.randrange(100, 400), rng.randrange(100, 400)) for _ in range(150)] + [(1000, 1000 + i) for i in range(1, 60)] + [(7, 7)]
    df = spark.createDataFrame([*edges, edges[0], (None, 3)], "u long, v long")
    got = {r.node: r.component for r in components.connected_components(df).collect()}
    want = brute_components({x for e in edges for x in e if e[0] != e[1]}, [e for e in edges if e[0] != e[1]])
    assert got == want
    assert components.connected_components(df.limit(0)).count() == 0


# ---- op1


def big_endian_tiff(pixels, predictor, planar, compression, bits=8):
    """A strip TIFF by hand: rows x columns x samples of unsigned integers."""
    h, w, s = pixels.shape
    dt = f">u{bits // 8}"
    planes = [pixels[:, :, [k]] for k in range(s)] if planar == 2 else [pixels]
    parts = []
    for p in planes:
        q = np.diff(p, axis=1, prepend=np.zeros_like(p[:, :1])) if predictor == 2 else p
        parts.append(tiff.compress(q.astype(dt).tobytes(), compression))
    data, offsets = b"MM\0*\0\0\0\0", []
    for p in parts:
        offsets.append(len(data))
        data += p
    data += b"\0" * (len(data) % 2)
    at = len(data)
    fields = [(256, 3, [w]), (257, 3, [h]), (258, 3, [bits] * s), (259, 3, [compression]), (262, 3, [2]), (273, 4, offsets), (277, 3, [s]), (278, 3, [h]), (279, 4, [len(p) for p in parts]), (284, 3, [planar]), (317, 3, [predictor])]
    head, extra, behind = b"", b"", at + 2 + 12 * len(fields) + 4
    for tag, kind, values in fields:
        raw = struct.pack(f">{len(values)}{'H' if kind == 3 else 'I'}", *values)
        where = raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack(">I", behind + len(extra))
        extra += raw if len(raw) > 4 else b""
        head += struct.pack(">HHI", tag, kind, len(values)) + where
    data = data[:4] + struct.pack(">I", at) + data[8:]
    return data + struct.pack(">H", len(fields)) + head + struct.pack(">I", 0) + extra


@pytest.mark.parametrize("planar", [1, 2])
@pytest.mark.parametrize("compression", [1, 5, 8, 32773])
@pytest.mark.parametrize("bits", [8, 16])
def test_tiff_variants(planar, compression, bits):
    pixels = np.random.default_rng(1).integers(0, 200, (7, 64, 3)).astype(f">u{bits // 8}")
    for predictor in (1, 2):
        (page,) = tiff.read(big_endian_tiff(pixels, predictor, planar, compression, bits))
        assert page["error"] is None and page["pixels"] == pixels.tobytes()


def test_float_predictor():
    x = np.random.default_rng(2).normal(size=(3, 5, 1)).astype(">f4")
    raw = np.ascontiguousarray(x).view(np.uint8).reshape(3, 5, 4).transpose(0, 2, 1).reshape(3, -1)
    coded = np.diff(raw, axis=1, prepend=np.zeros((3, 1), np.uint8))
    assert (tiff.undo_predictor(np.frombuffer(coded.tobytes(), ">f4").reshape(3, 5, 1), 3, ">") == x).all()


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000))
def test_codecs(data):
    assert tiff.packbits_decode(tiff.packbits_encode(data)) == data
    assert tiff.lzw_decode(tiff.lzw_encode(data)) == data


def test_tiff_damage(spark):
    good = tiff.write(b"x" * 192 * 600)
    assert [p["page"] for p in tiff.read(good)] == [0, 1]
    for bad in (b"", b"II*\0", good[:-40], b"\x89PNG"):
        assert any(p["error"] for p in tiff.read(bad))
    loop = bytearray(tiff.write(b"y" * 192))
    at = struct.unpack_from("<I", loop, 4)[0]
    n = struct.unpack_from("<H", loop, at)[0]
    struct.pack_into("<I", loop, at + 2 + 12 * n, at)
    assert len(tiff.read(bytes(loop))) == 1
    df = spark.createDataFrame([(1, good, "p"), (2, None, "p"), (3, b"no", "p")], "id int, media binary, page string")
    df = df.withColumnRenamed("page", "kept")
    assert sorted((r.id, r.page, r.error is None) for r in tiff.tiff_pages(df, "media").collect()) == [(1, 0, True), (1, 1, True), (3, 0, False)]


def test_tiff_store(odd, none):
    rows = tiff.with_pages(tiff.store(odd[0]), "media").collect()
    assert sorted(b"".join(p.pixels for p in r.pages) for r in rows) == sorted((t or "").encode().ljust(max(192, -(-len((t or "").encode()) // 192) * 192)) for _, t, _ in odd[1])
    assert tiff.store(none[0]).count() == 0


# ---- op2


def brute_ctw(train, depth):
    """Predictive log10 probability by recursion over contexts, bit by bit."""
    counts: dict = {}
    for t in train:
        data = b"\n" * depth + t
        for i in range(depth, len(data)):
            for j in range(8):
                bit, prefix = data[i] >> (7 - j) & 1, (1 << j) | (data[i] >> (8 - j))
                for d in range(depth + 1):
                    counts.setdefault((data[i - d : i], prefix), [0, 0])[bit] += 1

    kt = lambda n: math.lgamma(n[0] + 0.5) + math.lgamma(n[1] + 0.5) - math.lgamma(sum(n) + 1) - math.log(math.pi)
    weighted: dict = {}
    for d in range(depth, -1, -1):
        for (c, p), n in counts.items():
            if len(c) == d:
                below = sum(v for (c2, p2), v in weighted.items() if len(c2) == d + 1 and c2[1:] == c and p2 == p)
                weighted[c, p] = kt(n) if d == depth else np.logaddexp(kt(n), below) - math.log(2)

    def score(t):
        data, total = b"\n" * depth + t, 0.0
        for i in range(depth, len(data)):
            for j in range(8):
                bit, prefix = data[i] >> (7 - j) & 1, (1 << j) | (data[i] >> (8 - j))
                chain = []
                for d in range(depth + 1):
                    c = data[i - d : i]
                    n = counts.get((c, prefix))
                    if n:
                        est = (n[bit] + 0.5) / (sum(n) + 1)
                        below = sum(v for (c2, p2), v in weighted.items() if len(c2) == d + 1 and c2[1:] == c and p2 == prefix)
                        chain.append((est, 1 / (1 + math.exp(min(700, below - kt(n)))) if d < depth else 1.0))
                    else:
                        chain.append((0.5, 0.5 if d < depth else 1.0))
                p = chain[-1][0]
                for e, w in reversed(chain[:-1]):
                    p = w * e + (1 - w) * p
                total += math.log10(p)
        return total

    return score


@pytest.mark.parametrize("depth, pieces", [(1, 1), (2, 6), (3, 1), (4, 6), (6, 1), (6, 6)])
def test_ctw_equals_recursion(spark, monkeypatch, depth, pieces):
    if pieces > 1:  # several buckets and shards
        monkeypatch.setattr(ctw, "BUCKET_BYTES", 12)
        monkeypatch.setattr(ctw, "SHARD_BYTES", 10)
        monkeypatch.setattr(ctw, "LOOK", 5)
    texts = {1: "abab abba", 2: "Ab aab", 3: "abc\0a abab", 5: "", 8: None, 9: "ba ab abab", 12: "zq \0", 16: "ab\0 \0\0", 20: "aba \u00e9b abab"}
    df = docs_of(spark, [(i, t, "s") for i, t in texts.items()])
    rows = {r.doc_id: r for r in ctw.ctw_scores(df, depth=depth).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    assert any(held.values()) and set(rows) == set(texts)
    as_bytes = {i: b" ".join((t or "").encode().lower().split()) + b"\n" for i, t in texts.items()}
    trained = [w for i, b in as_bytes.items() if not held[i] for w in [*b.split(), b"\n"]]
    score = brute_ctw([b for i, b in as_bytes.items() if not held[i]], depth)
    for i, r in rows.items():
        own = [*as_bytes[i].split(), b"\n"]
        assert r.held_out == held[i] and r.n_bytes == len(as_bytes[i])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(w in trained for w in own), len(trained))
        assert abs(r.base_score - sum(math.log10((trained.count(w) + 1) / (len(trained) + len(set(trained)) + 1)) for w in own)) < 1e-9
        assert abs(r.score - score(as_bytes[i])) < 1e-4


def test_log_kt():
    """Tables and series against the definition."""
    n0, n1 = np.array([0, 3, 20_000, 5]), np.array([0, 1, 7, 70_000])
    want = [math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi) for a, b in zip(n0.tolist(), n1.tolist(), strict=True)]
    assert np.allclose(ctw.log_kt(n0, n1), want, rtol=1e-9, atol=1e-9)


def test_entries():
    """Counts of any size survive the entries of one byte each."""
    keys, n = np.array([3, 5, 8, 9], np.uint64), np.array([0, 1, 255, 70_000])
    e = ctw.entries(keys, n)
    assert (np.diff(e.astype(object)) >= 0).all() and (ctw.unpacked_keys(ctw.packed_keys(e)) == e).all()
    for parts, times in (([e], 1), ([e, e[::-1]], 2)):
        k, m = ctw.counted(parts)
        assert k.tolist() == keys.tolist() and m.tolist() == (n * times).tolist()


def test_ctw_learns(spark):
    """On held-out documents of a corpus of some size the model codes better than the unigram base."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id < 4000")
    held = ctw.ctw_scores(docs).where("held_out").agg(F.sum("base_score"), F.sum("score")).first()
    assert held[1] > held[0]


def test_ctw_cases(odd, none):
    rows = ctw.ctw_scores(odd[0]).collect()
    assert len(rows) == len(odd[1]) and all(r.n_tokens == len((t or "").split()) + 1 for r in rows for i, t, _ in odd[1] if i == r.doc_id)
    assert ctw.ctw_scores(none[0]).count() == 0


# ---- op3


def brute_near(rows, percent):
    def shingles(t):
        w = (t or "").lower().split()
        return {" ".join(w)} if 0 < len(w) < 5 else {" ".join(w[i : i + 5]) for i in range(len(w) - 4)}

    sets = {i: shingles(t) for i, t in rows if i is not None}
    edges = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return brute_components(sets, edges), sets


def test_near_duplicates(spark):
    rng = random.Random(7)
    rows, doc = [], 0
    for _ in range(25):
        words = [rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(rng.randrange(3, 120))]
        for _ in range(rng.randrange(1, 9)):
            own = list(words)
            for _ in range(rng.randrange(0, 3)):
                own[rng.randrange(len(own))] = "new" + str(rng.randrange(99))
            rows.append((doc, " ".join(own)))
            doc += 1
    rng.shuffle(rows)
    for percent in (80, 85):
        got = {r.doc_id: (r.component, r.n_shingles) for r in minhash.near_duplicates(docs_of(spark, [(i, t, "s") for i, t in rows]), percent).collect()}
        want, sets = brute_near(rows, percent)
        assert got == {i: (c, len(sets[i])) for i, c in want.items()}


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_near_duplicates_repeated_ids(spark, parts):
    """An id with several texts is linked with what any of them is linked with."""
    z, w = " ".join(f"z{i}" for i in range(60)), [f"w{i}" for i in range(60)]
    rows = [(1, z), (1, " ".join(w)), (2, " ".join([*w[:30], "other", *w[31:]])), (3, z), (4, "a\0b c\0 d e f"), (5, "a\0b c\0 d e f"), (6, "a b c d e f"), (1, z)]
    got = sorted((r.doc_id, r.component, r.n_shingles) for r in minhash.near_duplicates(docs_of(spark, [(i, t, "s") for i, t in rows]).repartition(parts), 80).collect())
    assert got == sorted([(1, 1, 56), (1, 1, 56), (1, 1, 56), (2, 1, 56), (3, 1, 56), (4, 4, 1), (5, 4, 1), (6, 6, 2)])


def test_near_duplicates_in_blocks(spark, monkeypatch):
    """A bucket that is dealt in block pairs gives the same classes."""
    monkeypatch.setattr(minhash, "BLOCK", 3)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(24):  # a chain: neighbours are similar, ends aren't
        own = base[:]
        for k in range(i):
            own[(k * 3) % 80] = f"x{k}"
        rows.append((i, " ".join(own)))
    got = {r.doc_id: r.component for r in minhash.near_duplicates(docs_of(spark, [(i, t, "s") for i, t in rows]), 85).collect()}
    assert got == brute_near(rows, 85)[0]


def test_near_duplicate_cases(odd, none):
    rows = minhash.near_duplicates(odd[0], 85).collect()
    assert len(rows) == len(odd[1])
    got = {r.doc_id: r.component for r in rows}
    assert got[5] == 4 and got[9] == 7 and got[8] == 7 and got[1] == 1 and got[2] == 2 and got[3] == 3 and got[None] is None
    kept = minhash.drop_near_duplicates(odd[0], 85)
    assert kept.columns == odd[0].columns and sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 2, 3, 4, 6, 7, 10]  # 11 holds 7 twice, so its set is nearly the same
    assert minhash.near_duplicates(none[0], 85).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.sets(st.integers(0, 300), min_size=1), st.sets(st.integers(0, 300), min_size=1), st.integers(1, 100))
def test_similar(a, b, percent):
    x, y = (np.array(sorted(s), np.uint64) for s in (a, b))
    assert minhash.similar(x, y, percent) == (100 * len(a & b) >= percent * len(a | b))


# ---- op4


def test_secrets(spark):
    key = "AKIA" + "ABCDEFGH12345678"
    opaque = "wJalrXUtnFEMIK7MDENGbPxRfiCYEXAMPLEKEY1a"
    rows = [(1, f"x {key} and {opaque} at https://h.example/p", "s"), (2, f"just {opaque} here", "s"), (3, f"{key} " + "pad " * 200 + opaque, "s"), (4, "😀 token = abcdefgh", "s"), (5, "secret: token: abcdefgh pw password=abc", "s"), (6, None, "s"), (7, "login: bob password = hunter22 host=db.example", "s")]
    found = secrets.scan(docs_of(spark, rows))
    by = {r.doc_id: r for r in found.collect()}
    kinds = lambda i: [(x.kind, x.start, x.end) for x in by[i].strong]
    assert kinds(4) == [("assign", 2, 18)] and kinds(5) == [] and kinds(6) == [] and kinds(1) == [("access", 2, 22)]
    links = {(r.a.kind, r.b.kind, r.c.kind if r.c else None) for r in secrets.credentials(found).collect()}
    assert links == {("access", "opaque", "endpoint"), ("login", "assign", "endpoint")}
    assert secrets.credentials(secrets.scan(docs_of(spark, []))).count() == 0


# ---- op5


def test_warc(spark):
    pages = spark.createDataFrame([(1, "http://a/x", "<p>é</p>", 0), (2, "http://b", "<p>é</p>", 0), (3, None, None, 0), (None, "http://c\r\nX: y", "z", 0), (4, "http://d", "", 0), (4, "http://d", "", 0)], "page_id long, url string, html string, payload int")
    rows = warc.assemble(warc.read_records(warc.write_archives(pages), payloads=True)).collect()
    got = sorted((r.metadata[0].page_id or 0, r.response.type, r.response.payload_bytes, bytes(r.response.payload or b"") if r.response.type == "response" else None) for r in rows)
    body = "<p>é</p>".encode()
    assert got == [(0, "response", 1, b"z"), (1, "revisit", len(body), None), (2, "response", len(body), body), (3, "revisit", 0, None), (4, "response", 0, b""), (4, "response", 0, b"")]
    assert all(len(r.requests) == 1 for r in rows if r.metadata[0].page_id not in (4,)) and all(r.response.verified in (True, None) for r in rows)
    assert warc.write_archives(pages.limit(0)).count() == 0


def test_warc_damage():
    whole = warc.capture("1", "1", "http://a", b"body", None)
    assert [h["warc-type"] for h, _ in warc.records(whole)] == ["request", "response", "metadata"]
    assert [h["warc-type"] for h, _ in warc.records(whole[:-20])] == ["request", "response"]
    assert list(warc.records(b"")) == [] and list(warc.records(b"junk\r\n\r\n")) == []


# ---- op6


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=14), st.binary(max_size=14), st.integers(0, 4))
def test_banded_distance(a, b, k):
    a, b = bytes(x & 3 for x in a), bytes(x & 3 for x in b)
    assert lines.within(a, b, k) == (levenshtein(a, b) <= k)


@settings(max_examples=80, deadline=None)
@given(st.binary(min_size=24, max_size=40), st.lists(st.tuples(st.integers(0, 39), st.integers(0, 2), st.integers(0, 255)), max_size=2))
def test_close_lines_share_a_key(a, edits):
    b = bytearray(a)
    for at, kind, c in edits:
        at = min(at, len(b) - 1)
        if kind == 0:
            b[at] = c
        elif kind == 1:
            b.insert(at, c)
        else:
            del b[at]
    long, short = sorted((a, bytes(b)), key=len, reverse=True)
    keys = lambda x, plan: {(n, i, x[p : p + k]) for n, i, p, k in plan}
    own = keys(short, lines.probes(len(short), 2)[:3])
    assert own & keys(long, lines.probes(len(long), 2)) or own & keys(long, lines.probes(len(long), 2)[:3])


def brute_lines(rows, edits, repeats, least):
    every = [(i, n, x.strip()) for i, t in rows for n, x in enumerate((t or "").encode().lower().split(b"\n")) if x.strip()]
    kinds = sorted({x for *_, x in every})
    at = {x: k for k, x in enumerate(kinds)}
    comp = brute_components(range(len(kinds)), [(a, b) for a, b in itertools.combinations(range(len(kinds)), 2) if min(len(kinds[a]), len(kinds[b])) >= least and abs(len(kinds[a]) - len(kinds[b])) <= edits and levenshtein(kinds[a], kinds[b]) <= edits])
    groups: dict = {}
    for i, n, x in every:
        groups.setdefault(comp[at[x]], []).append((i, n))
    return {i: sorted(n for g in groups.values() if len(g) >= max(2, repeats) for j, n in sorted(g)[1:] if j == i) for i, _ in rows}


def test_line_dedup(spark):
    rng = random.Random(3)
    bases = [" ".join(rng.choice(WORDS) for _ in range(rng.randrange(3, 9))) for _ in range(12)]

    def line():
        x = list(rng.choice(bases))
        for _ in range(rng.randrange(0, 4)):
            x[rng.randrange(len(x))] = rng.choice("abcxyz")
        return "".join(x)

    rows = [(i, "\n".join(line() for _ in range(rng.randrange(1, 7)))) for i in range(40)]
    for repeats in (2, 3):
        got = {r.doc_id: r.lines for r in lines.repeated_lines(docs_of(spark, [(i, t, "s") for i, t in rows]), repeats=repeats).collect()}
        assert got == {i: x for i, x in brute_lines(rows, 2, repeats, lines.MIN_BYTES).items() if x}


@pytest.mark.parametrize("most, shared", [(4, 2), (2, 1), (10_000, 3), (6, 10_000)])
def test_line_dedup_crowded(spark, monkeypatch, most, shared):
    """Keys that many lines share: met within a slice, cut again, dealt in blocks."""
    monkeypatch.setattr(lines, "MOST", most)
    monkeypatch.setattr(lines, "SHARED", shared)
    rng = random.Random(9)
    rows = []
    for i in range(45):
        tail = "".join(rng.choice("abcdef") for _ in range(rng.randrange(14, 17))) if i % 3 else "mmmmmmmmmmmmmm"
        own = [f"2024-01-01 00:00:00 info {tail}", "ok", f"n{i % 7}"]
        if i % 4 == 0 and rows:
            x = list(rng.choice(rows)[1].split("\n")[0])
            for _ in range(rng.randrange(0, 3)):
                x[rng.randrange(len(x))] = rng.choice("xyz")
            own[0] = "".join(x)
        rows.append((i, "\n".join(own)))
    got = {r.doc_id: r.lines for r in lines.repeated_lines(docs_of(spark, [(i, t, "s") for i, t in rows]).repartition(3)).collect()}
    assert got == {i: x for i, x in brute_lines(rows, 2, 2, lines.MIN_BYTES).items() if x}


def test_line_dedup_one_prefix(spark):
    """Many lines with one prefix and nothing else in common finish quickly."""
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(49)), lambda i: F.concat(F.lit("2024-01-01 12:00:00 request "), F.substring(F.sha2(F.concat_ws("-", "id", i).cast("binary"), 256), 1, 24))), "\n").alias("text"))
    assert lines.repeated_lines(docs).count() == 0


def test_line_cases(odd, none):
    out = lines.drop_repeated_lines(odd[0])
    assert out.columns == odd[0].columns
    by = {r.doc_id: r.text for r in out.collect() if r.doc_id != 5}
    assert by[1] is None and by[6] == next(t for i, t, _ in odd[1] if i == 6) and by[11] == "a\nb"
    assert lines.drop_repeated_lines(none[0]).count() == 0


# ---- op7


def test_vectors(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(20, 12))
    v = [(int(i), [float(x) for x in (base[i % 20] + rng.normal(size=12) * rng.choice([0.02, 0.2, 0.6])).astype(np.float32)]) for i in range(240)]
    v += [(500, v[3][1]), (501, v[3][1]), (502, None), (503, []), (504, [0.0] * 12), (505, [float("nan")] * 12), (506, [None] * 12), (507, [1.0, 2.0]), (508, [2.0, 4.0])]
    df = spark.createDataFrame([(i, x, "z") for i, x in v], "vec_id long, embedding array<float>, key string")
    ok = {i: np.array(x, float) for i, x in v if x and None not in x and np.isfinite(np.array(x, float)).all() and np.any(np.array(x, float))}
    edges = [(a, b) for a, b in itertools.combinations(sorted(ok), 2) if len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] / (np.linalg.norm(ok[a]) * np.linalg.norm(ok[b])) >= 0.95]
    comp = brute_components([i for i, _ in v], edges)
    links = {i: sum(i in e for e in edges) for i, _ in v}
    got = {r.vec_id: (r.n_links, r.component) for r in vectors.near_vectors(df).collect()}
    assert got == {i: (links[i], comp[i]) for i, _ in v}
    assert vectors.near_vectors(df.limit(0)).count() == 0


@pytest.mark.parametrize("kind", ["float", "double"])
def test_near_vectors_extremes(spark, kind):
    """Finite vectors of any size link; an id may have several vectors."""
    big, small = (3e38, 1e-44) if kind == "float" else (1e300, 1e-310)
    rows = [(1, [big, big]), (2, [1.0, 1.0]), (3, [small, small]), (4, [0.0, 0.0]), (5, [1.0, float("inf")]), (6, [1.0, None]), (7, None), (8, [1.0, -1.0]), (8, [1.0, 0.0]), (9, [2.0, -2.0]), (10, [big, 0.0]), (11, []), (12, [1.0])]
    got = sorted((r.vec_id, r.n_links, r.component) for r in vectors.near_vectors(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")).collect())
    assert got == [(1, 2, 1), (2, 2, 1), (3, 2, 1), (4, 0, 4), (5, 0, 5), (6, 0, 6), (7, 0, 7), (8, 1, 8), (8, 1, 8), (9, 1, 8), (10, 1, 8), (11, 0, 11), (12, 0, 12)]


def test_tree_deals_everything():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1000, 3))
    for leaves in (1, 5, 300):
        leaf = vectors.Tree(x, leaves).leaf(np.concatenate((x, x * 100)))
        assert leaf.min() >= 0 and leaf.max() < 512
    assert vectors.Tree(np.zeros((0, 3)), 8).leaf(x).tolist() == [0] * 1000
    assert len(set(vectors.Tree(np.ones((50, 3)), 4).leaf(np.ones((9, 3))).tolist())) == 1


def test_vector_tiles(spark, monkeypatch):
    monkeypatch.setattr(vectors, "TILE", 16)
    rng = np.random.default_rng(6)
    v = [(int(i), [float(x) for x in rng.normal(size=4)]) for i in range(200)]
    df = spark.createDataFrame(v, "vec_id long, embedding array<double>")
    x = np.array([e for _, e in v])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= 0.95) & ~np.eye(200, dtype=bool)
    comp = brute_components(range(200), list(zip(*np.nonzero(near), strict=True)))
    assert {r.vec_id: (r.n_links, r.component) for r in vectors.near_vectors(df).collect()} == {i: (int(near[i].sum()), comp[i]) for i in range(200)}


# ---- op8


def test_quality_cases(spark, odd, none):
    labels = spark.createDataFrame([(7, 1, None), (10, 0, 1), (4, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    ranking = quality.fit(odd[0], labels)
    rows = quality.scores(odd[0], ranking).collect()
    assert len(rows) == len(odd[1]) and all(0 <= r.score <= 1 for r in rows)
    kept = quality.keep_good(odd[0], labels, 0.0)
    assert kept.columns == odd[0].columns and kept.count() == len(odd[1])
    empty = quality.fit(odd[0], labels.limit(0))
    assert not empty.fitted and {r.score for r in quality.scores(odd[0], empty).collect()} == {0.5}
    assert quality.scores(none[0], ranking).count() == 0


# ---- op9


def brute_fill(lengths, window):
    """Total of each sequence, by the same rule on single pieces."""
    left, totals = sorted(lengths, reverse=True), []
    while left:
        first, rest = left[0], left[1:]
        best = {0: ()}
        for k, n in enumerate(rest):
            for s, picks in list(best.items()):
                if s + n <= window - first:
                    best.setdefault(s + n, (*picks, k))
        picks = best[max(best)]
        totals.append(first + max(best))
        left = [n for k, n in enumerate(rest) if k not in picks]
    return totals


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=30))
def test_fillings(lengths):
    counts = [0] * 41
    for n in lengths:
        counts[n] += 1
    out = packing.fill(counts, 40)
    used = [0] * 41
    for times, picks in out:
        assert sum(n * c for n, c in picks) <= 40
        for n, c in picks:
            used[n] += times * c
    assert used == counts
    assert out == [] or sum(n * c for n, c in out[0][1]) == max(brute_fill(lengths, 40)[:1])
    left = [n for n, k in enumerate(counts) for _ in range(k)]
    for times, picks in out:  # every filling is the best for the longest piece that is left
        longest = max(left)
        sums = {longest}
        for n in sorted(left)[:-1]:
            sums |= {s + n for s in sums if s + n <= 40}
        assert picks[0][0] == longest and sum(n * c for n, c in picks) == max(sums)
        for n, c in picks:
            for _ in range(times * c):
                left.remove(n)
    assert not left


def test_packing_cases(spark, odd, none):
    from test_llm_queries import check_packing

    own = odd[0].where("doc_id is not null").dropDuplicates(["doc_id"])
    rows = packing.pack(own, packing.default_tokenizer(), window=64).collect()
    check_packing(rows, [(r.doc_id, r.text or "") for r in own.collect()], 64)
    assert packing.pack(odd[0], packing.default_tokenizer()).count() >= len(odd[1])
    assert packing.pack(none[0], packing.default_tokenizer()).count() == 0


TEXTS = ["AB'S don't it'S ÀÉ²³ ½x 12ab <|endoftext|> a<|startoftext|>b ﬁ Σας ΟΔΟΣ İx é", "ª º µ ß Ÿ÷× a\x85b\xa0c \x0b\x0c d_e-f...!!, ~ \x7f\x00\x01 \\ ] ^ [ - ''s ''ll", "", "  ", "日本語 🙂🙂 ทำงาน", "a\x1cb", None]


def test_part_ids(monkeypatch):
    monkeypatch.setattr(packing, "MEMORY", 50)
    k, rng = packing.PartIds(packing.default_tokenizer()), random.Random(3)
    assert [k.whole(t or "").tolist() for t in TEXTS] == [x.tolist() for x in k.texts(pa.array(TEXTS))]
    for _ in range(20):
        xs = [" ".join(rng.choice(["ab", "cde", "É.", "12", "don't", "zz!"]) + rng.choice("abcdefgh") for _ in range(40)) for _ in range(4)]
        assert [k.whole(x).tolist() for x in xs] == [x.tolist() for x in k.texts(pa.array(xs))]


def test_other_tokenizers():
    import public_tokenizers

    k = packing.PartIds(public_tokenizers.path("byte_bpe_50k.json"))
    assert k.ends is None and [k.whole(t or "").tolist() for t in TEXTS] == [x.tolist() for x in k.texts(pa.array(TEXTS))]


# ---- op10


def test_flow_overlap():
    """Overlapping sources: quotas are met, and repeats are used only where needed."""
    patterns = [(frozenset("a"), 10), (frozenset("ab"), 10), (frozenset("b"), 4)]
    got = mixing.min_cost_flow(patterns, {"a": 12, "b": 10}, 2)
    assert sum(f.get("a", 0) for f in got) == 12 and sum(f.get("b", 0) for f in got) == 10
    assert [sum(f.values()) <= n for f, (_, n) in zip(got, patterns, strict=True)] == [True] * 3
    best = min(sum(max(0, t - n) for t, n in zip((x, y, z), (10, 10, 4), strict=True)) for x in range(21) for y in range(21) for z in range(9) if x + y + z == 22 and x <= 12 and z <= 10)
    assert sum(max(0, sum(f.values()) - n) for f, (_, n) in zip(got, patterns, strict=True)) == best == 0
    short = mixing.min_cost_flow([(frozenset("a"), 3)], {"a": 10}, 2)
    assert short == [{"a": 6}]


def test_targets():
    t = mixing.source_targets({"a": 100, "b": 1000, "c": 10, None: 50}, (5, 2, 1), 1.5, 2.0)
    assert t["a"] == 200 and abs(sum(t.values()) - 1.5 * 1160) < 1e-9 and all(t[s] <= 2 * n + 1e-9 for s, n in {"a": 100, "b": 1000, "c": 10, None: 50}.items())
    assert mixing.source_targets({}, (1,), 1.5, 2) == {}


def test_mix_cases(odd, none):
    rows = mixing.mixture(odd[0]).collect()
    again = mixing.mixture(odd[0].repartition(7)).collect()
    key = lambda r: (r.doc_id or 0, r.size, r.taken)
    assert sorted(map(key, rows)) == sorted(map(key, again)) and len(rows) == len(odd[1])
    assert all(0 <= r.taken <= 2 * r.size for r in rows)
    mixed = mixing.mix_documents(odd[0])
    assert mixed.columns == odd[0].columns and mixed.count() > 0
    assert mixing.mixture(none[0]).count() == 0 and mixing.mix_documents(none[0]).count() == 0


def test_overlapping_members(spark):
    df = docs_of(spark, [(i, "w " * 10, "a" if i % 2 else "b") for i in range(40)]).withColumn("members", F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array("source")))
    out = mixing.mixture(df, sources=F.col("members"))
    quota = sum(int(t + 0.5) for _, t in out.targets.values())  # shared documents count for each of their sources
    assert out.groupBy().sum("taken").first()[0] == min(quota, 2 * 400)


# ---- shared


def test_slices():
    b = pa.RecordBatch.from_arrays([pa.array(["x" * n for n in (5, 0, 900, 3, 3)])], ["t"])
    got = list(common.slices([b.slice(1), b.slice(0, 0), b], "t", 10))
    assert [x for g in got for x in g.column(0).to_pylist()] == ["x" * n for n in (0, 900, 3, 3, 5, 0, 900, 3, 3)]
    assert list(common.slices([], "t")) == []
