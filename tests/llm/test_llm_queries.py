"""The registered queries on the smallest tables: those with SQL equal DuckDB's rows."""

import zlib

import numpy as np
import pytest
from conftest import SMALL, same_as_sql

from pagewright.llm import ctw, packing, registry, tiff


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    same_as_sql(spark, duck, registry.queries()[name], registry.oracle_sql()[name])


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}


def test_op1_reads_back_what_was_stored(spark, texts):
    import hashlib

    rows = registry.queries()["op1_tiff_pages"](spark, SMALL).collect()
    assert len(rows) == len(texts)
    for r in rows:
        raw = texts[r.doc_id].encode()
        padded = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        media = tiff.write(padded)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]))
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest()) and r.feature


def test_op2_base_and_model(spark, texts):
    rows = registry.queries()["op2_context_tree_scores"](spark, SMALL).collect()
    held = lambda d: zlib.crc32(str(d).encode()) % 7 == 2
    low = lambda t: t.encode().lower().split() + [b"\n"]
    counts: dict = {}
    for d, t in texts.items():
        if not held(d):
            for w in low(t):
                counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    for r in rows:
        tokens = low(texts[r.doc_id])
        base = sum(np.log10((counts.get(w, 0) + 1) / (n + v + 1)) for w in tokens)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(tokens), sum(w in counts for w in tokens), n)
        assert abs(r.base_score - base) < 1e-6 * max(1, abs(base)) and r.score < 0


def test_op2_deeper_is_better(spark):
    """On held-out documents every depth gains over the one before it."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    total = [ctw.ctw_scores(docs, depth).where("held_out").groupBy().sum("score").first()[0] for depth in (2, 3, ctw.DEPTH)]
    assert total == sorted(total)


def test_op8_on_the_held_out_fold(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    rows = [r for r in registry.queries()["op8_quality_ranking"](spark, "/root/testdata/sf0.1").collect() if r.held_out and r.doc_id in labels]
    good, bad = ([r.score for r in rows if labels[r.doc_id] == k] for k in (1, 0))
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert np.mean([g > b for g in good for b in bad]) > 0.95
    assert np.mean([r.predicted == labels[r.doc_id] for r in rows]) > 0.95


def test_op9_pieces(spark, texts):
    check_packing(registry.queries()["op9_bin_slack_packing"](spark, SMALL).collect(), sorted(texts.items()), 4096)


def check_packing(rows, docs, window):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    ids = {d: t.encode(x, add_special_tokens=False).ids + [2] for d, x in docs}
    by_doc, by_seq = {}, {}
    for r in rows:
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert len(own) == r.length and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(own, "<u4").tobytes())
        by_doc.setdefault(r.doc_id, []).append((r.start, r.length))
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for d, own in ids.items():
        at = 0
        for s, n in sorted(by_doc[d]):
            assert s == at
            at += n
        assert at == len(own)
    total = 0
    for pieces in by_seq.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        assert at <= window
        total += at
    assert len(by_seq) <= -(-total // window) + max(2, len(by_seq) // 50)
