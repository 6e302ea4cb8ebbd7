"""Suffix-array dedup: the sort, the prefixes and whole results against brute force."""

import random

import numpy as np
from test_odd_input import TEXTS, odd  # noqa: F401

from pagewright.llm import substrings as S


def test_two_stage_order_and_prefixes():
    rng = random.Random(3)
    for trial in range(200):
        n, letters = rng.choice((1, 2, 60, 200, 600)), rng.choice((1, 2, 4, 200))
        text = np.array([rng.randrange(letters) + rng.choice((0, 40, 55)) for _ in range(n)], np.uint8)
        if rng.random() < 0.3:
            text = np.repeat(text, rng.randrange(1, 70))[:900]  # long runs of one byte
        wanted = np.array([rng.random() < rng.choice((0.3, 1)) for _ in range(len(text))])
        wanted[0] = True
        order = S.suffix_order(text, wanted)
        assert sorted(order.tolist()) == np.flatnonzero(wanted).tolist(), trial
        heads = [(text.tobytes()[i : i + 56] + b"\0" * 56)[:56] for i in order]
        assert heads == sorted(heads), trial
        for i, same in enumerate(S.common_prefixes(text, order).tolist()):
            a, b = (heads[i - 1], heads[i]) if i else (b"", b"")
            assert same == next((k for k in range(len(a)) if a[k] != b[k]), len(a))


def test_contents_are_judged_alone():
    """No string across two contents counts; the smallest document keeps its strings."""
    rng = random.Random(4)
    base = ["".join(rng.choices("ab ", k=200)).encode() for _ in range(20)]
    contents = [(b := rng.choice(base))[(a := rng.randrange(130)) : a + 50 + rng.randrange(20)] for _ in range(2000)]
    docs = np.array(rng.choices(range(300), k=len(contents)))
    least: dict = {}
    for c, d in zip(contents, docs.tolist(), strict=True):
        for o in range(len(c) - 49):
            least[c[o : o + 50]] = min(d, least.get(c[o : o + 50], d))
    gone = [[] for _ in contents]
    text = np.frombuffer(b"".join(contents), np.uint8)
    for i, a, b in zip(*(x.tolist() for x in S.judged(text, np.array(list(map(len, contents))), docs)), strict=True):
        gone[i] += range(a, b)
    for c, d, got in zip(contents, docs.tolist(), gone, strict=True):
        assert got == [o for o in range(len(c) - 49) if least[c[o : o + 50]] < d]


def test_runs_cover_every_string_once_whatever_stands_around():
    rng = random.Random(5)
    passage = "".join(rng.choices("abcdefgh ", k=300)).encode()
    leads = (b"", b"x" * 17, "é".encode() * 40, b"ab" * 500, b"z" * 200_000)
    texts = [lead + passage + lead for lead in leads] + [b"short", b"", passage[:50]]
    of, seen = [np.zeros(max(0, len(t) - 49), np.uint64) for t in texts], [np.zeros(max(0, len(t) - 49), int) for t in texts]
    for r in S.runs(texts):
        for i, a, n, key, at in zip(r.text, r.first, r.n, r.key, r.at, strict=True):
            of[i][a : a + n] = key
            seen[i][a : a + n] += 1
            assert n <= S.RUN and r.raw[at : at + n + 49].tobytes() == texts[i][a : a + n + 49]
    assert all((x == 1).all() for x in seen)
    keys = [of[i][len(lead) : len(lead) + 251].tolist() for i, lead in enumerate(leads)]
    assert keys.count(keys[0]) == len(keys) and of[-1][0] == keys[0][0]


def brute(docs):
    least: dict = {}
    raw = [(i, (t or "").encode()) for i, t in docs]
    for i, b in raw:
        for o in range(len(b) - 49 if i is not None else 0):
            least[b[o : o + 50]] = min(i, least.get(b[o : o + 50], i))
    out = []
    for i, b in raw:
        gone = bytearray(len(b))
        for o in range(len(b) - 49 if i is not None else 0):
            if least[b[o : o + 50]] < i:
                gone[o : o + 50] = b"\1" * 50
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((-1 if i is None else i, len(b), sum(gone), runs, bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return sorted(out)


def rows_of(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in df.collect())


def test_whole_results(spark):
    """Copies, shared passages in many surroundings, periodic texts, a crowded anchor."""
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdefghijé", k=rng.randrange(2, 8))) for _ in range(300)]
    say = lambda n: " ".join(rng.choices(words, k=n))
    common, others = say(40), [say(25) for _ in range(5)]
    docs = [(i, f"{say(12)} {common} {say(12)}") for i in range(120)]
    docs += [(200 + i, f"{say(9)} {rng.choice(others)}{rng.choice(others)} {say(4)}") for i in range(60)]
    docs += [(300 + i, docs[i][1]) for i in range(10)] + [(5, docs[30][1]), (5, docs[31][1]), (5, docs[31][1])]
    docs += [(400, "a" * 5000), (401, "b" + "a" * 300), (402, "ab" * 200), (403, "xab" + "ab" * 60), (404, "a" * 49), (405, "a" * 50)]
    want = brute(docs)
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    assert rows_of(S.without_repeats(d)) == want
    assert rows_of(S.without_repeats(d, crowd=8)) == want


def test_odd_documents(odd):  # noqa: F811
    """Null, empty, repeated and very long texts, null ids, clashing columns."""
    assert rows_of(S.without_repeats(odd)) == brute(TEXTS)
    assert S.without_repeats(odd.limit(0)).count() == 0
