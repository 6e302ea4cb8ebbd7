"""Round trips and invariants over generated input."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st

from pagewright.functions import arrow as A
from pagewright.operators.translate import chunk_bounds
from pagewright.streaming.jobs import advance

lines = st.lists(st.text(st.characters(codec="utf-8"), max_size=60), max_size=60).map("\n".join)


@settings(max_examples=60, deadline=None)
@given(lines, st.integers(50, 400), st.integers(5, 60))
def test_chunks_rejoin(text, size, overlap):
    out, at = "", 0
    bounds = chunk_bounds(text, size, overlap)
    for s, e, _ in bounds:
        assert s <= at
        out += text[at:e]
        at = e
    assert out == text and [b[0] for b in bounds] == sorted({b[0] for b in bounds})


@settings(max_examples=80, deadline=None)
@given(st.text(max_size=80), st.lists(st.text(min_size=1, max_size=5), max_size=5))
def test_protected_text_comes_back(text, terms):
    if "PHASE_TOKEN" in text or any(t in "__PHASE_TOKEN_ABCDEFG__" for t in terms):
        return
    hidden, held = A.protect(text, [(t, t, True) for t in terms])
    back, missing = A.restore(hidden, held)
    assert not missing and back == text


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["cat", "dog", " ", "  ", "\n", "_", "and", "The"]), max_size=14).map("".join), st.lists(st.sampled_from(["cat", "do", "a", "Th"]), max_size=3))
def test_blanks_around_terms_stay(text, terms):
    hidden, held = A.protect(text, [(t, t.upper(), True) for t in terms])
    want = re.sub("|".join(sorted(map(re.escape, terms), key=lambda t: (-len(t), t))) or "(?!)", lambda m: m[0].upper(), text)
    assert A.restore(hidden, held) == (want, [])


@settings(max_examples=80, deadline=None)
@given(st.text(max_size=30), st.text(max_size=30))
def test_diff_covers_all(a, b):
    d = A.diff_counts(a, b)
    assert d["unchanged"] + d["substitutions"] + d["deletions"] == len(a)
    assert d["unchanged"] + d["substitutions"] + d["insertions"] == len(b)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 3), st.sampled_from(["queued", "running", "completed", "cancelled"])), max_size=12))
def test_state_counts_every_event(events):
    state, good, bad = advance(None, events)
    assert good + bad == len(events)
