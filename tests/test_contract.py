"""Registered queries against their SQL on the smallest tables. FULL_CHECK=0 runs the headline ones alone."""
import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from bench import HEADLINE
from jobspan.checks import ORACLES, QUERIES
from tools.check import TABLES, rows_of

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[:3] == ["rank", "total", "id"]
    assert df.count() > 0


def test_registry_without_session():
    """The registry can be read before any session exists."""
    code = "import __spark_entry__ as e; print(len(e.queries()), set(e.oracle_sql()) - set(e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120,
                         cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    assert out.returncode == 0 and out.stdout.strip().endswith("set()")


def test_rest_without_the_optional_part(tmp_path):
    """Without the training-data operators and their pipeline all other queries are there."""
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(os.path.join(top, "jobspan"), tmp_path / "jobspan", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(top, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; print(sorted(e.queries()), sorted(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120, cwd=tmp_path,
                         env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert out.stdout.strip() == f"{sorted(QUERIES)} {sorted(ORACLES)}"


@pytest.mark.parametrize("name", HEADLINE if os.environ.get("FULL_CHECK") == "0" else sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if name not in entry.oracle_sql():
        return
    res = con.execute(entry.oracle_sql()[name])
    assert got == rows_of([c[0] for c in res.description], res.fetchall())
