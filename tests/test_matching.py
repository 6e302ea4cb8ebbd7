"""Matching blocks and what stands on them, against the standard library's matcher."""

import difflib
import random
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagewright.functions import arrow as A
from pagewright.functions import matching as M
from pagewright.operators import html


def theirs(a, b):
    return [tuple(op) for op in difflib.SequenceMatcher(None, a, b).get_opcodes()]


def ours(a, b):
    return M.operations(a, b, M.matching(a, b))


@pytest.mark.parametrize("n", [0, 3, 20, 100, 199, 200, 400])
def test_texts(n):
    """Both sides of the length from which frequent characters start no run."""
    rng = random.Random(n)
    for _ in range(250):
        letters = "abcdefghij"[: rng.choice((1, 2, 10))] + ("klmnopqrstuvwxyz é\U0001f600" if rng.random() < 0.5 else "")
        a = "".join(rng.choices(letters, k=n))
        b = list(a)
        for _ in range(rng.randrange(9)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randrange(4)] = rng.choices(letters, k=rng.randrange(4))
        b = "".join(b) if rng.random() < 0.8 else "".join(rng.choices(letters, k=n))
        assert ours(a, b) == theirs(a, b)


def test_long_texts_list_no_pairs(monkeypatch):
    """The same whether runs are listed or the longest is searched for; long lines stay quick."""
    rng = random.Random(4)
    for limit in (0, 30):
        monkeypatch.setattr(M, "PAIRS", limit)
        for _ in range(200):
            letters = "abcdefghijklmnopqrstuvwxyz"[: rng.choice((1, 2, 5, 26))]
            a = "".join(rng.choices(letters, k=rng.choice((1, 30, 199, 300))))
            b = "".join(c for c in a if rng.random() < 0.9) + "".join(rng.choices(letters, k=rng.randrange(40)))
            assert ours(a, b) == theirs(a, b)
    monkeypatch.undo()
    long = "".join(rng.choices("etaoin shrdlucmfwypvbgkjqxz", [12, 9, 8, 8, 7, 7, 18, 6, 6, 6, 4, 4, 3, 3, 2, 2, 2, 2, 2, 1, 1.5, 2, 0.8, 0.2, 0.1, 0.2, 0.1], k=60_000))
    began = time.time()
    ops = ours(long, long.translate(str.maketrans("en", "aE", "o")))
    assert time.time() - began < 60 and sum(i1 - i0 for k, i0, i1, *_ in ops if k == "equal") > 5_000


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40), st.text(max_size=40))
def test_any_text(a, b):
    assert ours(a, b) == theirs(a, b)
    assert abs(M.similarity(a, b) - difflib.SequenceMatcher(None, a, b).ratio()) < 1e-12


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abc ", max_size=12), st.lists(st.text(alphabet="abc ", max_size=12), max_size=6))
def test_most_similar(text, among):
    ratios = [difflib.SequenceMatcher(None, o, text).ratio() for o in among]
    best = max(ratios, default=0)
    assert M.most_similar(text, among, 0.7) == ((ratios.index(best), best) if best >= 0.7 else None)


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="abcd", max_size=30), st.text(alphabet="abcd", max_size=30))
def test_diff_counts(a, b):
    want = dict.fromkeys(("substitutions", "insertions", "deletions", "unchanged"), 0)
    for tag, i0, i1, j0, j1 in theirs(a, b):
        k = min(i1 - i0, j1 - j0)
        want["unchanged" if tag == "equal" else "substitutions"] += k
        want["deletions"] += i1 - i0 - k
        want["insertions"] += j1 - j0 - k
    assert A.diff_counts(a, b) == {"raw": len(a), "corrected": len(b)} | want


def test_a_text_that_begins_with_the_other(monkeypatch):
    """As by the standard matcher, without listing or looking for runs."""
    rng, pairs = random.Random(9), []
    for n in (0, 1, 5, 40, 150, 199, 200, 260, 420) * 40:
        letters = "abcdefghijklmnopqrstuvwxyz "[: rng.choice((1, 2, 5, 27))]
        a = "".join(rng.choices(letters, k=n))
        b = a + (rng.choices(("x", a[: rng.randrange(n + 1)], "".join(rng.choices(letters, k=rng.randrange(30)))))[0])
        pairs += [(a, b), (b, a)]
    want = [theirs(a, b) for a, b in pairs]
    monkeypatch.setattr(M, "Pair", None)
    assert [ours(a, b) for a, b in pairs] == want


def test_many_texts_at_once(monkeypatch):
    """The same as one by one, in pieces or together, and much sooner."""
    rng = random.Random(6)
    olds, news = [], []
    for n in (0, 1, 3, 20, 100, 199, 200, 400) * 60:
        letters = "abcdefghij"[: rng.choice((1, 2, 10))] + ("klmnopqrstuvwxyz é\U0001f600" if rng.random() < 0.5 else "")
        a = "".join(rng.choices(letters, k=n))
        olds.append(a)
        news.append("".join(c for c in a if rng.random() < 0.9) + "".join(rng.choices(letters, k=rng.randrange(40))) if rng.random() < 0.8 else rng.choice(("", a, a[::-1])))
    want = [list(A.diff_counts(a, b).values()) for a, b in zip(olds, news, strict=True)]
    assert A.diff_counts_many(olds, news).tolist() == want and A.diff_counts_many([], []).tolist() == []
    for pairs, together in ((50, 4_000_000), (20_000, 1)):
        monkeypatch.setattr(M, "PAIRS", pairs)
        monkeypatch.setattr(M, "TOGETHER", together)
        assert A.diff_counts_many(olds, news).tolist() == want
    monkeypatch.undo()
    lines = ["".join(rng.choices("etaoin shrdlu", k=260)) for _ in range(1000)]
    changed = [x.translate(str.maketrans("en", "aE", "o")) for x in lines]
    began = time.process_time()
    A.diff_counts_many(lines, changed)
    middle = time.process_time()
    for a, b in zip(lines, changed, strict=True):
        A.diff_counts(a, b)
    assert 2 * (middle - began) < time.process_time() - middle


def test_lines_are_linked_as_by_the_standard_matcher(spark):
    rng = random.Random(8)
    words = ["one", "two", "three four five", "", "six seven eight nine", "ten eleven"]
    pages, final = {}, {}
    for page in range(30):
        n = rng.choice((0, 1, 5, 30, 230))
        old = [rng.choice(words) + (str(rng.randrange(40)) if rng.random() < 0.7 else "") for _ in range(n)]
        new = list(old)
        for _ in range(rng.randrange(8)):
            at = rng.randrange(len(new) + 1)
            new[at : at + rng.randrange(3)] = [x + "!" for x in new[at : at + 2]] if rng.random() < 0.5 else [rng.choice(words) + "zz"]
        pages[page], final[page] = old, new
    rows = lambda of: [(p, 10 * k, t) for p, ls in of.items() for k, t in enumerate(ls)]
    source = spark.createDataFrame([(p, o, t, f"b{o}") for p, o, t in rows(pages)], "page_id long, ord int, text string, block_id string")
    got = {(r.page_id, r.ord): (r.text, r.block_id, r.edited) for r in html.reconciled_lines(spark.createDataFrame(rows(final), "page_id long, ord int, text string"), source).collect()}
    want = {}
    for p, new in final.items():
        old = pages[p]
        for tag, i0, i1, j0, j1 in theirs(old, new):
            for j in range(j0, j1):
                link = (None, True)
                if tag == "equal":
                    link = (f"b{10 * (i0 + j - j0)}", False)
                elif tag == "replace":
                    ratios = [difflib.SequenceMatcher(None, old[i], new[j]).ratio() for i in range(i0, i1)]
                    if max(ratios) >= 0.7:
                        link = (f"b{10 * (i0 + ratios.index(max(ratios)))}", max(ratios) < 0.99)
                want[p, 10 * j] = (new[j], *link)
    assert got == want and len({x[1:] for x in got.values()} & {(None, True)}) == 1
    assert np.mean([e for _, b, e in got.values() if b]) > 0
