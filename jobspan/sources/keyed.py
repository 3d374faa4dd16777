"""Tables in folders by a part of their key: lookups read, and updates rewrite, only the parts that their keys fall into."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobspan.operators.keys import apply_updates
from jobspan.session import written

PART = "part"


def hashed(parts: int) -> Callable[[Column], Column]:
    """Keys spread evenly, for lookups by any key."""
    return lambda key: F.pmod(F.xxhash64(key), F.lit(parts))


def ranged(width: int) -> Callable[[Column], Column]:
    """Whole numbers that lie near each other, for updates of what has come lately."""
    return lambda key: F.floor(key / F.lit(width))


class KeyedTable:
    """A Parquet table unique on ``key``, in one folder per part. The numbers of the parts that a set of keys falls into pass through
    the driver, at most one per part; rows never do."""

    def __init__(self, spark: SparkSession, path: str, key: str, part: Callable[[Column], Column]):
        self.spark, self.path, self.key, self.part = spark, path, key, part

    def _placed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn(PART, self.part(F.col(self.key)).cast("long"))

    def write(self, rows: DataFrame) -> KeyedTable:
        """Writes all rows into a new folder; a row without a key can't be looked up and is left out."""
        rows = self._placed(rows.where(F.col(self.key).isNotNull())).repartition(PART)
        rows.sortWithinPartitions(PART, self.key).write.partitionBy(PART).parquet(self.path)
        return self

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path).drop(PART)

    def _touched(self, keys: DataFrame) -> list[int]:
        parts = self._placed(keys.select(self.key).where(F.col(self.key).isNotNull())).select(PART).distinct()
        return sorted(r[PART] for r in parts.collect())

    def of(self, keys: DataFrame) -> DataFrame:
        """The rows of all parts that the keys fall into: a filter on folders, which a join on the key follows."""
        return self.spark.read.parquet(self.path).where(F.col(PART).isin(self._touched(keys))).drop(PART)

    def at(self, keys: DataFrame) -> DataFrame:
        """The rows of the keys alone. Keys are written first, so that Spark knows how few they are and filters where it reads: what a
        lookup moves grows with its keys, not with the table, however many parts they fall into."""
        asked = written(keys.select(self.key).where(F.col(self.key).isNotNull()).distinct(), "keys")
        return self.of(asked).join(asked, self.key, "left_semi")

    def update(self, updates: DataFrame, columns: list[str], only_found: bool = False) -> None:
        """Changes columns by key, as ``apply_updates``. The parts with an update are written anew to the shared folder first, then in
        place of the old ones; other parts are neither read nor written. A failed update may be repeated."""
        touched = self._touched(updates)
        if not touched:
            return
        old = self.spark.read.parquet(self.path).where(F.col(PART).isin(touched))
        new = written(apply_updates(old, updates, self.key, columns, only_found), "updated-parts")
        (new.repartition(PART).sortWithinPartitions(PART, self.key).write.partitionBy(PART).mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").parquet(self.path))
