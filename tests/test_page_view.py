"""The page view's jobs and texts, against brute force on small tables."""

import duckdb

from pagewright.plans import registry

#: job, state of its order; the last has pages and no order
ORDERS = {0: "F", 6: "O", 7: "F", 14: "P", 21: "O", 22: None}
STATES = {"F": "completed", "O": "queued", "P": "running"}


def test_page_view_has_the_state_of_every_order(spark, tmp_path):
    pages = [(job, page, float(job + page), "R", "F") for job in ORDERS for page in range(1, 5)]
    spark.createDataFrame(pages, "l_orderkey long, l_linenumber int, l_quantity double, l_returnflag string, l_linestatus string").write.parquet(f"{tmp_path}/lineitem.parquet")
    orders = [(job, s) for job, s in ORDERS.items() if s]
    spark.createDataFrame(orders, "o_orderkey long, o_orderstatus string").selectExpr("*", "timestamp'2020-01-01' AS o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    got = {(r.job_id, r.page_id): r for r in registry.queries()["S22_page_view"](spark, str(tmp_path)).collect()}
    assert {k: r.job_status for k, r in got.items()} == {(job, page): STATES.get(ORDERS[job]) for job, page, *_ in pages}
    for (job, page), r in got.items():
        raw = "" if page == 3 else ("direct_text", "ocr_image", "hybrid")[(job + page) % 3]
        final = raw if job % 3 else ("completed", "none")[(job + page) % 2]  # without a final text the raw one, also where there is a corrected one
        assert (r.raw, r.corrected, r.final) == (raw, raw if page % 2 else "blank", final)
    con = duckdb.connect()
    for n in ("lineitem", "orders"):
        con.execute(f"create view {n} as select * from read_parquet('{tmp_path}/{n}.parquet/*.parquet')")
    sql = con.execute(f"select job_id, page_id, job_status, raw, corrected, final, changed from ({registry.oracle_sql()['S22_page_view']})").fetchall()
    assert sorted(map(str, sql)) == sorted(str(tuple(r)) for r in got.values())
