"""The five feeds of one job deal their lines to responses once; results against the SQL, with repeated and missing keys."""
import datetime as dt

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import rows_of

FEEDS = ["united_feeds", "united_feed_counts", "feed_lever", "feed_ashby", "feed_smartrecruiters", "feed_greenhouse", "feed_workday"]
LINE = (f"l_{n} {t}" for n, t in (("orderkey", "long"), ("partkey", "long"), ("suppkey", "long"), ("linenumber", "int"), ("returnflag", "string"),
                                  ("linestatus", "string"), ("shipdate", "timestamp")))
TABLES = {
    "supplier": ("s_suppkey long, s_name string", [*((k, f"Supplier#{k}") for k in range(4)), (3, "Again#3"), (None, "None#")]),
    "part": ("p_partkey long, p_name string, p_type string, p_brand string, p_size int",
             [*((k, f"red gear {k}", "SMALL", f"Brand#{k}", 5 * k) for k in range(11)), (7, "again", "LARGE", "Brand#7", 30), (None, "x", "y", "z", 1)]),
    "lineitem": (", ".join(LINE), [(k * 700, k % 12, k % 6 if k % 9 else None, k % 4, "ARN"[k % 3], "FO"[k % 2], dt.datetime(2001, 5, 1 + k % 28))
                                   for k in [*range(90), 17, 17]]),
}


@pytest.fixture(scope="module")
def few(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("feeds")
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for name, (schema, rows) in TABLES.items():
        spark.createDataFrame(rows, schema).write.parquet(str(top / f"{name}.parquet"))
        con.execute(f"create view {name} as select * from '{top}/{name}.parquet/*.parquet'")
    return str(top), con


@pytest.mark.parametrize("name", FEEDS)
def test_equals_sql(spark, few, name):
    top, con = few
    df = entry.queries()[name](spark, top)
    res = con.execute(entry.oracle_sql()[name])
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of([c[0] for c in res.description], res.fetchall())


@pytest.mark.parametrize("name", ["united_feeds", "united_feed_counts"])
def test_lines_are_dealt_once(spark, few, name):
    df = entry.queries()[name](spark, few[0])
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning(l_suppkey" in line]
    assert len(dealt) == 5 and sum("ReusedExchange" not in line for line in dealt) == 1
