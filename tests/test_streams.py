"""Streams: repeated and late events, timers, windows; merged documents; providers that fail."""

import datetime as dt
import json
import random

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagewright.operators import merge
from pagewright.sources import providers
from pagewright.streaming import progress as P
from pagewright.streaming import queue as Q
from pagewright.streaming.retention import watched_jobs


def test_a_repeated_event_starts_nothing_twice():
    state, begun = Q.advance(None, [(0, "queued", 5, False)] * 2, 2)
    assert begun == [5] and Q.advance(state, [(0, "queued", 5, False)], 2) == (state, [])


def test_late_events_get_their_place():
    state, begun = Q.advance(None, [(0, "queued", 1, False), (3, "queued", 4, False)], 1)
    state, more = Q.advance(state, [(1, "queued", 2, False), (2, "queued", 3, False)], 1)
    assert begun == [1] and more == [] and [j for _, j, _ in state.waiting] == [2, 3, 4] and (state.upto, state.beyond) == (3, [])
    # an end that comes before its start: the job never runs
    state, begun = Q.advance(None, [(1, "ended", 7, False)], 1)
    assert state.ended == [(1, 7)]
    state, begun = Q.advance(state, [(0, "queued", 7, False)], 1)
    assert begun == [] and state == Q.Queue([], [], [], 1, [])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["queued", "ended", "cancelled"]), st.integers(0, 4), st.booleans()), max_size=10), st.integers(1, 3), st.randoms())
def test_any_order_of_arrival_counts_every_event_once(events, capacity, rng):
    numbered = [(i, *e) for i, e in enumerate(events)]
    arrivals = numbered + rng.choices(numbered, k=4) if numbered else []
    rng.shuffle(arrivals)
    state, begun = None, []
    for at in range(0, len(arrivals), 3):
        state, some = Q.advance(state, sorted(arrivals[at : at + 3]), capacity)
        begun += some
        assert len(state.running) <= capacity and sum(m for *_, m in state.running) <= 1
    if state:
        assert state.upto == len(events) - 1 and state.beyond == [] and state.ended == []
        queued = [j for _, e, j, _ in numbered if e == "queued"]
        assert all(begun.count(j) <= queued.count(j) for j in begun)
        # what is left is what was queued after its last end
        last = {j: max([-1, *(i for i, e, k, _ in numbered if k == j and e != "queued")]) for j in queued}
        assert sorted(x[:2] for x in (*state.waiting, *state.running)) == [(i, j) for i, e, j, _ in numbered if e == "queued" and i > last[j]]


def ran(spark, frames, schema, query, mode):
    """What a stream gives that reads frames one after another."""
    import tempfile

    src, state = (tempfile.mkdtemp(prefix="spark-") for _ in range(2))
    collected = []
    for rows in frames:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        q = query(spark.readStream.schema(schema).parquet(src)).writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(lambda df, _: collected.extend(df.collect())).start()
        q.awaitTermination(120)
    return collected


DAY = dt.datetime(2024, 5, 1, tzinfo=dt.timezone.utc)


def at(hours):
    return DAY + dt.timedelta(hours=hours)


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(key, before)


def test_retention_and_heartbeats_by_timers(spark, rocks):
    frames = [
        [(1, at(0), "running"), (1, at(1), "completed"), (2, at(0), "completed"), (3, at(0), "running")],
        [(2, at(20), "queued"), (3, at(0.1), "running"), (1, at(0.5), "running")],  # 2 goes on in time; 1's is late
        [(9, at(30), "queued")],  # moves the clock
        [(9, at(60), "queued")],
    ]
    got = ran(spark, frames, "job_id long, ts timestamp, status string", lambda s: watched_jobs(s, late="1 hour"), "append")
    seen = {(r.job_id, r.what): r["at"].astimezone(dt.timezone.utc) for r in got}
    assert seen.keys() == {(1, "expired"), (3, "interrupted"), (3, "expired")} and len(got) == 3
    assert seen[1, "expired"] == at(25)
    assert abs(seen[3, "interrupted"] - at(0.1) - dt.timedelta(seconds=600)) < dt.timedelta(seconds=1)
    assert abs(seen[3, "expired"] - seen[3, "interrupted"] - dt.timedelta(days=1)) < dt.timedelta(seconds=1)


def test_progress_on_a_stream_equals_the_table(spark):
    rng = random.Random(3)
    schema = "event_id long, ts timestamp, job_id long, stage string, status string"
    events = [(i, at(i / 4 + rng.random() * 0.5), rng.randrange(3), rng.choice("abc"), rng.choice(["running", "completed", "failed"])) for i in range(120)]
    frames = [events[i : i + 30] + events[max(0, i - 3) : i] for i in range(0, 120, 30)]  # some come twice
    got = {(r.job_id, r.begins): tuple(r) for r in ran(spark, frames, schema, lambda s: P.progress(s, "6 hours", "2 hours"), "update")}
    want = {(r.job_id, r.begins): tuple(r) for r in P.progress(spark.createDataFrame(events, schema), "6 hours").collect()}
    assert got == want and sum(r[2] for r in got.values()) == 120


def test_merged_documents_and_pages_set_aside(spark, tmp_path):
    page = lambda *n: json.dumps({"pages": [{"page_id": i, "t": "é\"\n"} for i in n]})
    pages = [(1, 2, page(2), '{"n":2}'), (1, 1, page(1), None), (1, 3, '{"pages": [', "[1, 2]"), (1, 4, "[]", "nope"), (1, 5, '{"pages": 7}', '{"n":5}'), (1, 6, "{}", None), (2, 1, None, None), (3, 1, page(1, 2), "{}")]
    df = spark.createDataFrame(pages, "job_id long, page_id int, ocr string, changes string")
    jobs = spark.createDataFrame([(1,), (2,), (3,), (4,)], "job_id long")
    documents, aside = merge.merged_pages(jobs, df)
    got = {r.job_id: (json.loads(r.ocr), json.loads(r.changes)) for r in documents.collect()}
    entry = lambda i: {"page_id": i, "t": "é\"\n"}
    assert got[1] == ({"job_id": 1, "pages": [entry(1), entry(2)]}, {"job_id": 1, "pages": [{"n": 2}, [1, 2], {"n": 5}]})
    assert got[2] == ({"job_id": 2, "pages": []}, {"job_id": 2, "pages": []})
    assert got[3][0]["pages"] == [entry(1), entry(2)] and got[4][0] == {"job_id": 4, "pages": []}
    assert sorted((r.page_id, r.file, r.reason) for r in aside.collect()) == [(3, "ocr", "not_json"), (4, "changes", "not_json"), (4, "ocr", "not_an_object"), (5, "ocr", "no_list_of_pages")]

    path = str(tmp_path / "documents")
    merge.save_documents(documents, path, buckets=2)
    again, _ = merge.merged_pages(spark.createDataFrame([(3,)], "job_id long"), spark.createDataFrame([(3, 1, page(9), None)], df.schema))
    merge.save_documents(again, path, buckets=2)
    saved = {r.job_id: json.loads(r.ocr)["pages"] for r in merge.saved_documents(spark, path).collect()}
    assert saved == {1: [entry(1), entry(2)], 2: [], 3: [entry(9)], 4: []}


class Counted(providers.Identity):
    def __init__(self, bad=(), error=ValueError, cut=()):
        self.bad, self.error, self.cut, self.calls, self.asked = set(bad), error, set(cut), 0, 0

    def translate(self, texts):
        self.calls += 1
        self.asked += len(texts)
        if self.bad & set(texts):
            raise self.error("bad text")
        return [providers.Reply(t[:1], True) if t in self.cut else t for t in texts]


def test_one_bad_text_fails_alone():
    texts = pd.Series([f"t{i}" for i in range(10_000)])
    p = Counted(bad={"t7777"}, cut={"t5"})
    got = providers.outcomes(p, texts)
    assert got[7777] == ("failed", None, "bad text") and got[5] == ("truncated", "t", "truncated")
    assert all(o == ("translated", t, None) for o, t in zip(got, texts, strict=True) if t not in ("t7777", "t5"))
    assert p.calls < 40
    every = Counted(bad=set(texts))
    assert {o.status for o in providers.outcomes(every, texts)} == {"failed"} and every.calls <= providers.PATIENCE


def test_waits_cancelling_and_wrong_answers():
    slept, texts = [], pd.Series(["a"])
    slow = Counted(bad={"a"}, error=TimeoutError)
    assert providers.outcomes(slow, texts, sleep=slept.append) == [("failed", None, "bad text")] and slept == [0.25, 1.0]
    assert providers.outcomes(slow, pd.Series(["a", "b"]), sleep=slept.append, cancelled=lambda: True) == [("cancelled", None, "cancelled")] * 2

    class Short(providers.Identity):
        def translate(self, texts):
            return list(texts)[1:]

    assert providers.outcomes(Short(), pd.Series(["a", "b"])) == [("failed", None, "invalid_response")] * 2
    assert providers.outcomes(Short(), pd.Series([], dtype=object)) == []


def test_hybrid_asks_each_provider_once(spark, tmp_path):
    log = tmp_path

    class Logged(providers.Identity):
        def __init__(self, name, bad=""):
            self.name, self.bad = name, bad

        def translate(self, texts):
            import uuid

            (log / f"{self.name}-{len(texts)}-{uuid.uuid4().hex}").touch()
            if self.bad in list(texts):
                raise ValueError("no")
            return [f"{t}{self.name}" for t in texts]

    df = spark.createDataFrame([(str(i), f"x{i}") for i in range(100)], "id string, text string").coalesce(1)
    got = {r.id: r for r in providers.hybrid(df, Logged("f"), Logged("p", "x3f")).collect()}
    assert got["4"].translated == "x4fp" and (got["3"].translated, got["3"].status, got["3"].error) == ("x3f", "translated", "no")
    assert sum(int(p.name.split("-")[1]) for p in log.iterdir() if p.name.startswith("f-")) == 100


def test_replies_of_a_model(spark):
    def handler(prompt):
        if prompt == "boom":
            raise RuntimeError("no model")
        return providers.Reply(prompt[:2], True) if len(prompt) > 5 else prompt.upper()

    got = {r.p: tuple(r.answer) for r in providers.answers(spark.createDataFrame([("a",), ("boom",), ("longer one",)], "p string"), "p", handler).collect()}
    assert got == {"a": (True, "completed", "A", None), "boom": (False, "failed", None, "no model"), "longer one": (False, "truncated", "lo", "truncated")}
