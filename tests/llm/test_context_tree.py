"""op2's step on one bucket: the bytes of its texts, where keys are, and what it holds."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa

from pagewright.llm import ctw

TEXTS = ["  Ab  c\t", None, "", "x", " \n ", "é Zz", "a b\x1cc", "\0 a", "B\r\nb\x0b\x0cb"]


def test_texts_are_laid_out_as_by_python():
    for texts, depth in ((TEXTS, 1), (TEXTS, 6), ([None], 3), (TEXTS[1:3], 6), (TEXTS[5:], 2)):
        column = pa.array(["zz", *texts, "zz"], pa.string()).slice(1, len(texts))
        data, padding, words, n_words, n_bytes = ctw.laid_out(column, depth)
        tokens = [(t or "").encode().lower().split() for t in texts]
        own = [b" ".join(t) + b"\n" for t in tokens]
        assert data.tobytes()[:-8] == b"".join(b"\n" * depth + x for x in own)
        assert words.to_pylist() == [w for t in tokens for w in t]
        assert n_words.tolist() == [len(t) for t in tokens] and n_bytes.tolist() == [len(x) for x in own]
        before = [i for n, x in enumerate(own) if n for start in [sum(len(y) + depth for y in own[:n])] for i in range(start, start + depth)]
        assert padding.tolist() == before


def test_places(monkeypatch):
    rng = np.random.default_rng(3)
    for size in (0, 1, 5, 70_000):
        keys = np.unique(rng.integers(0, 1 << 56, size, dtype=np.uint64))
        many = rng.permutation(np.r_[keys, keys])
        assert (ctw.Places(keys)(many) == np.searchsorted(keys, many)).all()
        with monkeypatch.context() as m:  # every key meets another in each table
            m.setattr(ctw.Places, "FACTORS", (np.uint64(0),) * 2)
            assert (ctw.Places(keys)(many) == np.searchsorted(keys, many)).all()


def bucket(size):
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randrange(2, 9))) for _ in range(20_000)]
    texts, left = [], size
    while left > 0:
        texts.append(" ".join(rng.choices(words, k=400)))
        left -= len(texts[-1])
    n = len(texts)
    return pa.table({"doc_id": pa.array(range(n), pa.int64()), "text": texts, "held_out": [i % 7 == 2 for i in range(n)], "bucket": pa.array([0] * n, pa.int64())}), words


def test_a_bucket_is_held_in_few_bytes_a_byte_of_text():
    """Several workers share an executor's memory beside its heap."""
    table, _ = bucket(6 << 20)
    peaks = []

    def measured(f, *args):
        tracemalloc.start()
        try:
            out = f(*args)
            peaks.append(tracemalloc.get_traced_memory()[1] / (6 << 20))
            return out
        finally:
            tracemalloc.stop()

    asked = measured(ctw.ask(3, 6), table).to_pylist()
    replies = [{"shard": r["shard"], "kind": r["kind"], "bucket": 0, "asked": r["counts"]} for r in asked]
    for r, a in zip(replies, asked, strict=True):
        if a["kind"] == ctw.GRAMS:
            keys = ctw.distinct([ctw.unpacked_keys(a["asked"]) >> np.uint64(8)])
            r["asked"] = (-1 - (keys & np.uint64(255)).astype(np.float32) / 256).tobytes()
    got = measured(ctw.score(3, 6), table, pa.Table.from_pylist(replies)).to_pylist()
    for r, text in zip(got, table.column("text").to_pylist(), strict=True):
        data = np.frombuffer(text.encode() + b"\n", np.uint8)
        assert r["n_bytes"] == len(data) and abs(r["score"] + len(data) + data.sum() / 256) < 1e-6 * len(data)
    assert max(peaks) < 28, peaks
