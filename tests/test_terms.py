"""Glossary terms against plain containment, for a short and a long glossary, and how many rows that takes."""

import pytest

from pagewright.operators import translate

TEXTS = ["The cat and é ด", "", None, "xyz" * 50, "DE de ß", "a" * 300 + " term7 TERM8", "term1 term12"]


@pytest.mark.parametrize("n", [3, 300])
def test_term_states(spark, n):
    terms = [("the", "le", False), ("de", "DE", True), ("é ด", "x", True), ("", "e", False), *((f"{chr(97 + i % 26)}{chr(97 + i // 26)}q", "z", False) for i in range(n)), *((f"term{i}", "t", bool(i % 2)) for i in range(13))]
    g = spark.createDataFrame([(a, b, c, False, "translated") for a, b, c in terms], "source string, target string, case_sensitive boolean, do_not_translate boolean, mode string")
    pairs = spark.createDataFrame([(i, t, "le t") for i, t in enumerate(TEXTS)], "pair_id long, source string, target string")
    got = sorted((r.pair_id, r.term) for r in translate.term_states(pairs, g).collect())
    assert got == sorted((i, a) for i, t in enumerate(TEXTS) if t for a, _, c in terms if a and (a in t if c else a.lower() in t.lower()))


def test_a_short_glossary_multiplies_no_text(spark):
    """No row a gram of a text: what is exploded are the glossary's grams that it holds."""
    g = spark.createDataFrame([("the", "le", False, False, "translated")], "source string, target string, case_sensitive boolean, do_not_translate boolean, mode string")
    pairs = spark.createDataFrame([(1, "x", "y")], "pair_id long, source string, target string")
    plan = translate.term_states(pairs, g)._jdf.queryExecution().analyzed().toString()
    assert "regexp_extract_all" not in plan
