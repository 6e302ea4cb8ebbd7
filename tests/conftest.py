import os
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(REPO))
os.environ["PYTHONPATH"] = f"{REPO}:{os.environ.get('PYTHONPATH', '')}"

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "6g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for n in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {n} as select * from read_parquet('{SMALL}/{n}.parquet')")
    return con


def canonical(columns, rows):
    """Rows as sorted tuples of text, columns by name, floats to nine places."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def one(x):
        if x is None or x != x:
            return "null"
        return repr(round(x, 9)) if isinstance(x, float) else str(x)

    return sorted(tuple(one(r[i]) for i in order) for r in rows)


def same_as_sql(spark, duck, fn, sql):
    df = fn(spark, SMALL)
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    cur = duck.execute(sql)
    names = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(names)
    assert got == canonical(names, cur.fetchall())
