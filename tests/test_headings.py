"""Heading levels of lines that end in a letter and a full stop."""

import duckdb

from pagewright.plans import registry

LINES = ["Ñieco osas. Ciónción.", "Einer für b.", "veröö für.", "a_b.", "Kapitel é.", "x 1.", "1.", "éa.", "plain", "."]


def test_heading_inference_after_letters_beyond_ascii(spark, tmp_path):
    docs = [(d, "\n".join(LINES)) for d in range(40)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.page_id, r.ord): r.level for r in registry.queries()["P23_heading_inference"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = {(p, o): level for p, o, level in con.execute(f"select page_id, ord, level from ({registry.oracle_sql()['P23_heading_inference']})").fetchall()}
    assert got == want
    assert any(level for (_, o), level in got.items() if o == 0)
