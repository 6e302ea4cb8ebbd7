"""Queries that have no SQL, against brute force on small tables: every row and the whole of each text."""

import hashlib
import io
import zipfile
from html import escape

import pytest

from pagewright.operators import package
from pagewright.plans import registry

TEXTS = {1: "", 3: "a < b & c\n\x01second\nthird", 20: "\n".join(f"line {i} <i>" for i in range(25)), 21: "x\n\ny"}


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("small"))
    spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    return d


def brute_chapters(doc, text):
    """(title, body) of each chapter of a document under the levels that the plans invent."""
    blocks = [(n, {0: "h1", 1: "h3", 2: "h2"}.get((doc + n * 3) % 7, "p"), n // 10, x) for n, x in enumerate(text.split("\n"))]
    by_h1, out = any(tag == "h1" for _, tag, *_ in blocks), []
    for n, tag, page, x in blocks:
        if not out or (tag == "h1" if by_h1 else page != blocks[n - 1][2]):
            out.append([])
        out[-1].append((tag, page, x))
    shown = lambda x: escape(x.replace("\x01", ""), quote=False)
    return [(next((x for tag, _, x in c if tag != "p"), f"หน้า {c[0][1]}")[:200], "\n".join(f"<{tag}>{shown(x)}</{tag}>" for tag, _, x in c)) for c in out]


def test_epub_packages(spark, small):
    got = {r.doc_id: (r.n, r.h, r.errors) for r in registry.queries()["S17_V4_epub_packages"](spark, small).collect()}
    want = {}
    for doc, text in TEXTS.items():
        chapters = brute_chapters(doc, text)
        data = package.build(f"doc-{doc}", chapters[0][0], chapters)
        want[doc] = (len(data), hashlib.sha256(data).hexdigest(), 0)
        z = zipfile.ZipFile(io.BytesIO(data))
        assert sum(z.read(n).decode().count("line ") for n in z.namelist() if "chapter-" in n) >= text.count("line ")
    assert got == want


def test_diff_summary_has_every_line(spark, small):
    got = {(r.doc_id, r.ln): r for r in registry.queries()["A5_diff_summary"](spark, small).collect()}
    lines = {(d, n): x for d, t in TEXTS.items() for n, x in enumerate(t.split("\n"))}
    assert got.keys() == lines.keys()
    assert all(r.bounded and r.unchanged + r.substitutions + r.deletions == len(lines[k]) for k, r in got.items())
