"""Helpers that several operators share: scratch tables, Arrow batches, gapless ranks and connected components."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobspan.session import scratch_folder


_KEPT: dict[str, None] = {}  # scratch tables that lie there still, oldest first


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """The rows written to the shared scratch folder and read back: computed once, and the lineage ends there."""
    path = scratch_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    _KEPT[path] = None
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing reads any more."""
    for table in tables:
        _delete(table.sparkSession, table.scratch)


def kept_tables() -> list[str]:
    """The paths of the scratch tables that lie there still."""
    return list(_KEPT)


def delete_tables(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    if path in _KEPT:
        del _KEPT[path]
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def free_name(name: str, taken: list[str]) -> str:
    """The name, with underscores before it until no column has it."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = "_" + name
    return name


def utf8(column: pa.Array) -> list[bytes]:
    """Each text's UTF-8 bytes; a null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def portions(batch: pa.RecordBatch, text: int, most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most`` bytes of the text column each, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes, dtype=np.int64) // most)) + 1
    for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
        if b > a:
            yield batch.slice(int(a), int(b - a))


BITMAP_WORDS = 1 << 20  # 64 bits each: 8 MB, whatever the corpus; a full bitmap costs time, not results


def bitmap(wanted: DataFrame) -> np.ndarray:
    """A bit for each value of the column h1."""
    place = F.shiftrightunsigned("h1", 6).bitwiseAND(F.lit(BITMAP_WORDS - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("h1").bitwiseAND(F.lit(63)).cast("int"))
    table = wanted.groupBy(place.alias("at")).agg(F.bit_or(bit).alias("bits")).toArrow()  # at most BITMAP_WORDS rows
    words = np.zeros(BITMAP_WORDS, np.uint64)
    words[table["at"].to_numpy()] = table["bits"].to_numpy().view(np.uint64)
    return words


def in_bitmap(batches, shared) -> Iterator[pa.RecordBatch]:
    """The rows whose first column, h1, has its bit."""
    words = shared.value
    for batch in batches:
        h = batch.column(0).to_numpy().view(np.uint64)
        bits = words[(h >> np.uint64(6)) & np.uint64(len(words) - 1)] >> (h & np.uint64(63))
        yield batch.filter(pa.array((bits & np.uint64(1)).astype(bool)))


def name_of(h1: str, h2: str) -> Column:
    return F.concat(F.lpad(F.hex(h1), 16, "0"), F.lpad(F.hex(h2), 16, "0"))


def numbered(df: DataFrame, order: list[str], name: str, purpose: str) -> DataFrame:
    """Adds the row's gapless place (from 0) in the given total order.

    The rows are range-partitioned and sorted, so no task sees more than its range, and equal leading columns spread over
    tasks by the later ones. Only one row per partition is gathered to add the ranges up.
    """
    local = F.monotonically_increasing_id()  # partition << 33 | row, after the sort
    at = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", local), purpose)
    part = F.shiftright("_at", 33)
    sizes = at.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    # One row per partition of the table: bounded by the number of tasks, whatever the number of rows.
    return (at.withColumn("_part", part).join(F.broadcast(starts), "_part")
            .withColumn(name, F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
            .drop("_part", "_start", "_at"))


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, root) of every node of an undirected graph given as (a, b); root is the component's smallest node.

    Alternates the large-star and small-star steps (Kiveris and others, "Connected Components in MapReduce and Beyond"):
    each step joins edges with one minimum per node, so hubs are pre-aggregated and skewed joins can be split. Every round is
    written to the shared folder.
    """
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = _mark(now)
    for _ in range(rounds):
        if mark[0] == 0:
            break
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        old, now = now, stored(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
        discard(old)
        mark, last = _mark(now), mark
        if mark == last:
            break
    else:
        raise RuntimeError(f"components have not settled in {rounds} rounds")
    out = now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
    out.scratch = now.scratch  # for who stores the result
    return out


def _mark(edges: DataFrame) -> tuple:
    """Number of edges and an order-free sum of their hashes: equal when a round has changed nothing."""
    return tuple(edges.select(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first())


def held_out(doc_id: Column, parts: int, which: int) -> Column:
    """crc32 of the id as text, modulo ``parts``, is ``which``; a missing id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(parts)) == which


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
