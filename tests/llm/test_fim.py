"""Fill-in-middle: the scan against a regular expression, long documents against short ones."""

import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from test_odd_input import LONG, TEXTS, odd  # noqa: F401

from pagewright.llm import fim

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
MIXED = st.text(alphabet="ab é中\U0001f600 \t\n\r\x0b\x0c  ", max_size=60)


@given(MIXED, st.integers(1, 9))
@settings(max_examples=300, deadline=None)
def test_composed_chunks_equal_the_whole(text, size):
    raw, tokens = text.encode(), TOKEN.findall(text)
    parts = list(fim.pieces(raw, size))
    assert b"".join(parts) == raw
    for p in parts:
        p.decode()  # no character is cut
    total = fim.summary(b"")
    for p in parts:
        total = fim.compose(total, fim.summary(p))
    assert total[2] + bool(raw) == len(tokens) and total[4] == len(text)
    # any bracketing gives the same
    right = fim.summary(b"")
    for p in reversed(parts):
        right = fim.compose(fim.summary(p), right)
    assert right == total


@given(MIXED, st.integers(0, 1 << 32), st.integers(0, 1 << 32))
@settings(max_examples=300, deadline=None)
def test_cuts(text, h1, h2):
    tokens = TOKEN.findall(text)
    ends = [0]
    for t in tokens:
        ends.append(ends[-1] + len(t))
    a, b = sorted((h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)))
    assert fim.cuts_of(text.encode(), h1, h2) == (len(tokens), ends[a], ends[b])


def expected(doc_id, text):
    text, ident = text or "", "" if doc_id is None else str(doc_id)
    digest = hashlib.sha256(f"42:{ident}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    tokens = TOKEN.findall(text)
    a, b = sorted((h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return len(tokens), "plain", text
    return (len(tokens), "spm", f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 80 else (len(tokens), "psm", f"<P>{p}<S>{s}<M>{m}")


def test_odd_documents_whole_and_in_chunks(odd):  # noqa: F811
    """Null, empty, blank, repeated and very long texts, null ids, clashing columns."""
    want = sorted(expected(i, t) for i, t in TEXTS)
    for size in (fim.CHUNK, 100):
        got = fim.fill_in_middle(odd, size=size)
        assert got.columns == [*odd.columns, "fim"]
        rows = got.collect()
        assert sorted((r.fim.n, r.fim.form, r.fim.output) for r in rows) == want
        assert {r["a.b"] for r in rows} == {"c"}
    assert fim.fill_in_middle(odd.limit(0)).count() == 0


def test_every_form_is_restored(spark):
    rows = [(i, f" doc {i}  <P or P> é\n" * (i % 5) + "<" * (i % 3)) for i in range(200)] + [(900 + i, LONG[: 70_000 + i] + ("<M>" if i % 4 == 0 else "")) for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = fim.fill_in_middle(docs).withColumn("back", fim.restored(F.col("fim.output"), F.col("fim.form"))).collect()
    assert {r.fim.form for r in got} == {"plain", "spm", "psm"}
    for r in got:
        assert r.back == r.text and (r.fim.n, r.fim.form, r.fim.output) == expected(r.doc_id, r.text)
