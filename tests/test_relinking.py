"""Re-linking against the plain rule, and many documents in time."""

import random
import time

from pyspark.sql import functions as F

from pagewright.operators import toc


def brute(own, there):
    ids = {t["target_id"] for t in there}
    used = {e["target_id"] for e in own if e["target_id"] in ids}
    out = []
    for e in own:
        free = [t["target_id"] for t in there if t["match_key"] is not None and t["match_key"] == e["match_key"] and t["target_id"] not in used]
        if e["target_id"] in ids:
            out.append((e["entry_id"], e["target_id"], "ok"))
            continue
        one = free[0] if len(free) == 1 else None
        if one is not None:
            used.add(one)
        out.append((e["entry_id"], one, "rematched" if len(free) == 1 else "ambiguous" if free else "missing"))
    return out


def test_claims():
    r = random.Random(7)
    for _ in range(300):
        own = [{"entry_id": f"e{i}", "target_id": r.choice(["a", "b", "c", "x", None]), "match_key": r.choice(["k", "l", "m", None])} for i in range(r.randrange(12))]
        there = [{"target_id": r.choice("abcdefgh"), "match_key": r.choice(["k", "l", "m", "n", None])} for _ in range(r.randrange(8))]
        assert toc.claims(own, there) == brute(own, there)


def test_many_documents(spark):
    own = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("e").alias("entry_id"), F.lit("old").alias("target_id"), F.lit("k").alias("match_key"), F.lit(0).alias("ord"))
    start = time.monotonic()
    got = toc.relinked(own, own.where("doc_id % 2 = 0").withColumn("target_id", F.lit("new")))
    assert {(r.state, r.target_id): r["count"] for r in got.groupBy("state", "target_id").count().collect()} == {("rematched", "new"): 10_000, ("missing", None): 10_000}
    assert time.monotonic() - start < 30
