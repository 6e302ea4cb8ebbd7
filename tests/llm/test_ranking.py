"""Ranked search: trees against scoring everything, ties, odd input, sets of queries."""

import random
import re
from collections import Counter

import numpy as np
from test_odd_input import LONG, TEXTS, odd  # noqa: F401

from pagewright.llm import ranking

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOW))


def brute(docs, items, k):
    tf = [(i, Counter(terms(t))) for i, t in docs]
    tf = [(i, c) for i, c in tf if c]
    n_docs, n_terms = len(tf), sum(c.total() for _, c in tf)
    df = Counter(t for _, c in tf for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c in tf:
            m = ranking.length_factor(c.total(), n_docs, n_terms)
            score = sum(r * ranking.weight(n_docs, df[t]) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t, r in Counter(terms(text)).items() if t in c)
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, rank + 1, x[3], -x[0]) for rank, x in enumerate(sorted(found)[:k])]
    return out


def rows_of(df):
    return sorted((r.item_id, r.rank, r.doc_id, r.score) for r in df.collect())


def test_terms():
    for t in ("A-b_c9 É中x\0y\x7fz", "", " \n", LONG[:50], "[`{@/:x^~"):
        assert ranking.terms(t.encode()) == [x.encode() for x in terms(t)]


def test_a_tree_finds_the_best_and_opens_little():
    rng = random.Random(5)
    n = 3000
    held = [(t, at, 1 + (rng.random() < 0.02) * 5) for t in range(40) for at in range(n) if rng.random() < (0.3 if t < 5 else 0.01)]
    term, at, tf = (np.array(x) for x in zip(*held, strict=True))
    row = {"ids": list(range(n)), "n": [100 + i % 7 for i in range(n)], "term": term.astype(np.int32).tobytes(), "at": at.astype(np.int16).tobytes(), "tf": tf.astype(np.int32).tobytes()}
    tree = ranking.Tree(row, n, 103 * n)
    for trial in range(20):
        query = {rng.randrange(45): rng.choice((0, 500, 3000, 8000)) for _ in range(6)}
        rows, w = tree.prepared(query)
        every = tree.bounds(rows, w, len(tree.levels) - 1, 0, n)
        want = sorted(((int(s), i) for i, s in enumerate(every) if s > 0), key=lambda x: (-x[0], x[1]))[:20]
        opened = []
        assert tree.best(query, 20, opened=opened) == want
        assert len(opened) < sum(level.shape[1] for level in tree.levels[:-1])
        if len(want) == 20:  # a floor from elsewhere loses nothing that reaches it
            assert tree.best(query, 20, want[10][0])[:11] == want[:11]


def test_ties_and_blocks(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(30)] + ["É", "中文"]
    docs = [(i, " ".join(rng.choices(words, k=rng.choice((1, 2, 5, 9))))) for i in range(400)] + [(1000 + i, "w1 W2, w3") for i in range(60)]
    items = [(i, " ".join(rng.choices(words, k=rng.choice((1, 3, 8))))) for i in range(12)] + [(50, "w1 w2 w3"), (51, None), (52, "nowhere"), (53, "w1 w1 w1 é")]
    want = brute(docs, items, 20)
    d, q = spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string")
    assert rows_of(ranking.search(d, q)) == sorted(want)
    assert rows_of(ranking.search(d, q, block=16)) == sorted(want)


def test_sets_of_items_have_a_bound():
    items = [(i, f"a{i} b{i} common") for i in range(10)]
    assert [len(s) for s in ranking.item_sets(iter(items), 4)] == [4, 4, 2]
    assert [x for s in ranking.item_sets(iter(items), 100, 25) for x, _ in s] == list(range(10))
    assert max(len(s) for s in ranking.item_sets(iter(items), 100, 25)) == 2
    assert ranking.block_for(10) == ranking.BLOCK and ranking.block_for(50_000) * 50_000 <= ranking.CELLS


def test_odd_documents(odd, spark):  # noqa: F811
    """Null, empty, repeated and very long texts, null ids, clashing columns."""
    items = [(1, "one two word7 WORD7 é"), (2, ""), (None, "a same line")]
    asked = spark.createDataFrame([(i, t, "x", "y") for i, t in items], "item_id long, text string, doc_id string, score string")
    got = ranking.search(odd, asked)
    want = brute(TEXTS, items, 20)
    key = lambda r: (str(r[0]), r[1])
    assert sorted(map(tuple, got.select("item_id", "rank", "doc_id", "score").collect()), key=key) == sorted(want, key=key)
    assert ranking.search(odd.limit(0), asked).count() == 0
    assert ranking.search(odd, asked.limit(0)).count() == 0
