"""The pipeline's stages: what they return, and that each agrees with brute force on its own input."""

import pytest
from conftest import SMALL

import corpus_pipeline as cp
from pagewright.llm import lines, mixing


@pytest.fixture(scope="module")
def stages(spark):
    from pagewright.llm.common import materialize

    docs, out = spark.read.parquet(f"{SMALL}/documents.parquet"), {}
    for name, stage in cp.STAGES:
        before, docs = docs, materialize(stage(spark, docs, SMALL), name)
        out[name] = (before, docs)
    return out


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_columns(stages):
    for name, (before, after) in stages.items():
        if name != "packing":
            assert after.columns == before.columns
    assert after.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_quality_keeps_good(spark, stages):
    before, after = stages["quality"]
    kept = {r["doc_id"] for r in rows(after)}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    good = [d for d, q in labels.items() if q == 1]
    assert kept <= {r["doc_id"] for r in rows(before)} and sum(d in kept for d in good) >= 0.95 * len(good)


def test_lines(stages):
    from test_operators import brute_lines

    before, after = stages["lines"]
    docs = rows(before)
    gone = brute_lines([(r["doc_id"], r["text"]) for r in docs], lines.EDITS, cp.LINE_REPEATS, lines.MIN_BYTES)
    want = {}
    for r in docs:
        text = "\n".join(x for i, x in enumerate(r["text"].split("\n")) if i not in set(gone[r["doc_id"]]))
        if not gone[r["doc_id"]] or text.strip(" \n"):
            want[r["doc_id"]] = text
    assert {r["doc_id"]: r["text"] for r in rows(after)} == want


def test_near_duplicates(stages):
    from test_operators import brute_near

    before, after = stages["near_duplicates"]
    classes, _ = brute_near([(r["doc_id"], r["text"]) for r in rows(before)], cp.NEAR_PERCENT)
    assert sorted(r["doc_id"] for r in rows(after)) == sorted(i for i, c in classes.items() if i == c)


def test_mixture(stages):
    before, after = stages["mixture"]
    size, source = ({r["doc_id"]: f(r) for r in rows(before)} for f in (lambda r: len(r["text"].encode().split()), lambda r: r["source"]))
    sums = {s: sum(n for d, n in size.items() if source[d] == s) for s in set(source.values())}
    target = mixing.source_targets(sums, (5, 2, 1), 1.5, 2)
    taken: dict = {}
    for r in rows(after):
        taken[r["source"]] = taken.get(r["source"], 0) + size[r["doc_id"]]
    longest = max(size.values())
    assert all(abs(taken.get(s, 0) - t) <= longest for s, t in target.items())


def test_packing(stages):
    before, after = stages["packing"]
    copies: dict = {}
    for r in rows(before):
        copies[r["doc_id"]] = copies.get(r["doc_id"], 0) + 1
    starts: dict = {}
    for r in rows(after):
        starts[r["doc_id"]] = starts.get(r["doc_id"], 0) + (r["start"] == 0)
    assert starts == copies
    total = sum(r["length"] for r in rows(after))
    assert len({r["sequence_id"] for r in rows(after)}) <= -(-total // 4096) + 3


def test_registered():
    import __spark_entry__ as e

    assert e.queries()["pipeline"] is cp.run
