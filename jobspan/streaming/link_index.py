"""Links of a stored table by hash bucket, kept up to date from the files that the table gains."""
from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 256


class LinkIndex:
    """(link, origin) under ``bucket``, the hash of the link, and ``sync``, the pass that has read it.

    ``sync`` is a stream over the table's files with a checkpoint of its own, so each file is read once, whatever has written it.
    ``known`` reads only the buckets that the asked links hash to, as a filter on the partitions. ``origin`` is the folder of a
    stream and its batch, if the file lies in one: a repeated batch leaves out what it has stored itself.
    """

    def __init__(self, spark: SparkSession, table: str, path: str, buckets: int = BUCKETS):
        self.spark, self.table, self.path, self.buckets = spark, table.rstrip("/"), path.rstrip("/"), buckets

    def _bucket(self, link: str = "link") -> Column:
        return F.pmod(F.xxhash64(link), F.lit(self.buckets)).cast("int")

    def sync(self) -> None:
        """Adds the links of files that have come since the last call."""
        try:
            files = (self.spark.readStream.schema("link string").option("recursiveFileLookup", True).parquet(self.table)
                     .select("link", F.regexp_extract("_metadata.file_path", r"(run=[^/]+/batch=\d+)/", 1).alias("origin")))
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "DATA_SOURCE_NOT_FOUND"):
                raise
            return  # nothing has been stored yet

        def add(rows: DataFrame, number: int) -> None:
            rows = rows.where(F.col("link").isNotNull()).withColumn("bucket", self._bucket()).withColumn("sync", F.lit(number))
            (rows.repartition("bucket").write.partitionBy("bucket", "sync").mode("overwrite")
             .option("partitionOverwriteMode", "dynamic").parquet(f"{self.path}/links"))

        query = (files.writeStream.foreachBatch(add).option("checkpointLocation", f"{self.path}/checkpoint")
                 .trigger(availableNow=True).start())
        query.awaitTermination()

    def known(self, keys: DataFrame, but: str = "", key: str = "link") -> DataFrame:
        """Those of some links that the table holds, each once, without rows whose origin is ``but``. Reads the buckets of the links
        alone; at most ``buckets`` numbers pass through the driver."""
        asked = keys.select(F.col(key).alias("link")).where("link is not null").distinct()
        touched = sorted(r.b for r in asked.select(self._bucket().alias("b")).distinct().collect())
        try:
            rows = self.spark.read.schema("link string, origin string, bucket int, sync long").parquet(f"{self.path}/links")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            rows = self.spark.createDataFrame([], "link string, origin string, bucket int, sync long")
        rows = rows.where(F.col("bucket").isin(touched))
        if but:
            rows = rows.where(F.col("origin") != but)
        return asked.join(rows.select("link"), "link", "left_semi")
