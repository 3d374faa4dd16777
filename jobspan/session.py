"""Session settings and the shared scratch folder."""
from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# What every job here wants: adaptive plans with skew handling, and UTC so that event times compare.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(name: str = "jobspan", **settings) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    for key, value in {**SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives the workers this package, once per application, so that Python operators run from any folder."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    # The driver serves the file from where it lies, for as long as the application runs.
    name = os.path.join(tempfile.mkdtemp(prefix="jobspan-package-"), "jobspan-package")
    sc.addPyFile(shutil.make_archive(name, "zip", top, "jobspan"))
    _SHIPPED.add(sc.applicationId)


def scratch_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder under the cluster's shared checkpoint folder.

    Only a session in local mode without that setting gets a folder of its own; a cluster must name one.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return os.path.join(tempfile.mkdtemp(prefix="jobspan-"), purpose)


def written(df: DataFrame, purpose: str) -> DataFrame:
    """The rows written to the shared scratch folder and read back: computed once, and the lineage ends there."""
    path = scratch_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
