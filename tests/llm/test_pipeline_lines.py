"""The line stage removes a class's later occurrences from the second on."""

from test_operators import brute_lines, docs_of

import corpus_pipeline as cp
from pagewright.llm import lines

SHARED = "a long passage line that two documents share"
ROWS = [(1, f"{SHARED}\nthe first document goes on in its own way"), (2, f"something else opens the second document\n{SHARED.upper()}!"), (3, "a third document that has nothing in common with them"), (4, f"{SHARED}s\nwhat is left of the fourth document here")]


def test_second_occurrence_goes(spark):
    for rows in (ROWS[:3], ROWS):
        gone = brute_lines(rows, lines.EDITS, 2, lines.MIN_BYTES)
        assert sum(map(len, gone.values())) == len(rows) - 2
        want = {i: "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[i]) for i, t in rows}
        got = cp.drop_lines(spark, docs_of(spark, [(i, t, "s") for i, t in rows]), "")
        assert {r.doc_id: r.text for r in got.collect()} == want
