import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from jobspan.session import build_session  # noqa: E402


# Started on import, since the tests name columns at module level.
SESSION = build_session("tests", **{
    "spark.master": "local[8]", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "4g", "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false"})
SESSION.sparkContext.setLogLevel("OFF")


@pytest.fixture(scope="session")
def spark():
    yield SESSION
    SESSION.stop()


@pytest.fixture(scope="session")
def ev(spark):
    """Value of an expression over one row of named strings or other values."""
    def run(build, **values):
        row = spark.createDataFrame([tuple(values.values())], ", ".join(
            f"{k} {_kind(v)}" for k, v in values.items())) if values else spark.range(1)
        return row.select(build.alias("x")).first()[0]

    return run


def _kind(v):
    if isinstance(v, list):
        return "array<string>"
    return {int: "int", float: "double"}.get(type(v), "string")
