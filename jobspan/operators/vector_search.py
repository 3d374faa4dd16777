"""Many query vectors against all item vectors: exactly, or through inverted lists.

Both sides are packed into blocks of about a megabyte, written once to the shared folder. A block product deals them to cells:
every cell holds a bounded part of the queries and a bounded part of the items, so what a task holds depends on neither side's
size, and nothing passes through the driver. Cells keep the k best per query, which are merged in two steps.
"""
from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobspan.functions.vectors import SIM_DIGITS, unit
from jobspan.session import scratch_folder, written

BLOCK_BYTES = 1 << 20  # vectors of a stored block
CELL_BYTES = 64 << 20  # vectors of one side in a cell, about
MAX_KEPT = 4 << 20  # results of a cell, which bound its queries besides their bytes
TILE_CELLS = 4 << 20  # similarities held at a time in a task
NO_ID = np.iinfo(np.int64).min  # stands for a missing id within a task
_BLOCK = "at long, n int, dim int, ids binary, vectors binary"


def vector_blocks(df: DataFrame, row_id: str, vector: str, purpose: str = "vectors") -> DataFrame:
    """The rows that have a vector, packed by position: (at, n, dim, ids, vectors), some rows of one dimension per block.

    Ids are longs, numbers keep their width; rows without an id share blocks whose ids are null. Blocks are dealt by ``at``, so
    repeated ids spread like any others.
    """
    wide = df.schema[vector].dataType.elementType.typeName() == "double"
    rows = df.where(F.col(vector).isNotNull()).select(F.col(row_id).cast("long"), vector)
    return written(rows.mapInArrow(partial(_pack, wide=wide), _BLOCK).withColumn("wide", F.lit(wide)), purpose)


def _pack(batches: Iterator[pa.RecordBatch], wide: bool) -> Iterator[pa.RecordBatch]:
    kind = np.float64 if wide else np.float32
    place, count = TaskContext.get().partitionId() << 32, 0
    for batch in batches:
        lengths = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
        unnamed = batch.column(0).is_null().to_numpy(zero_copy_only=False)
        ids = pc.fill_null(batch.column(0), NO_ID).to_numpy(zero_copy_only=False)
        flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(kind)
        ends = np.concatenate([[0], np.cumsum(lengths)])
        at = 0
        while at < len(ids):
            # As many rows of the first one's dimension as fit.
            dim = int(lengths[at])
            end = at + max(1, BLOCK_BYTES // max(1, 8 * dim))
            other = (lengths[at:end] != dim) | (unnamed[at:end] != unnamed[at])
            n = int(np.argmax(other)) or len(other)
            yield pa.RecordBatch.from_arrays(
                [pa.array([place + count], pa.int64()), pa.array([n], pa.int32()), pa.array([dim], pa.int32()),
                 pa.array([None if unnamed[at] else ids[at:at + n].tobytes()], pa.binary()), pa.array([flat[ends[at]:ends[at + n]].tobytes()], pa.binary())],
                names=["at", "n", "dim", "ids", "vectors"])
            at, count = at + n, count + 1


def _size(blocks: DataFrame) -> tuple[int, int, int]:
    """Number of vectors, least and greatest dimension."""
    return blocks.agg(F.coalesce(F.sum("n"), F.lit(0)), F.min("dim"), F.max("dim")).first()


def batch_top_k(items: DataFrame, queries: DataFrame, k: int, query_id: str = "query_id", item_id: str = "id",
                item_vec: str = "embedding", query_vec: str = "vec", max_query_bytes: int = CELL_BYTES,
                max_item_bytes: int = CELL_BYTES, max_kept: int = MAX_KEPT, salts: int = 32) -> DataFrame:
    """Exact k most similar items of every query: (query_id, item_id, vec_score). Ties go to the smaller id.

    Rows without a vector, on either side, give nothing; vectors of different lengths are refused.
    """
    schema = f"{query_id} long, {item_id} long, vec_score double"
    asked = vector_blocks(queries, query_id, query_vec, "query-vectors")
    n, least, dim = _size(asked)
    if not n or not dim:
        return items.sparkSession.createDataFrame([], schema)
    if least != dim:
        raise ValueError(f"query vectors have {least} to {dim} numbers")
    given = vector_blocks(items, item_id, item_vec, "item-vectors")
    m, low, high = _size(given)
    if m and (low, high) != (dim, dim):
        raise ValueError(f"item vectors have {low} to {high} numbers, not {dim}")
    across = max(1, -(-n * dim * 8 // max_query_bytes), -(-n * k // max_kept))
    down = max(1, -(-m * dim * 8 // max_item_bytes))
    left = asked.select(_part("at", across).alias("q"), F.explode(_each(down)).alias("i"), "ids", "vectors", "wide")
    right = given.select(F.explode(_each(across)).alias("q"), _part("at", down).alias("i"), "ids", "vectors", "wide")
    found = left.groupBy("q", "i").cogroup(right.groupBy("q", "i")).applyInArrow(
        partial(_cell, dim=dim, k=k), "q long, i long, s double")
    return _merged(found, k, salts).select(F.col("q").alias(query_id), F.col("i").alias(item_id), F.col("s").alias("vec_score"))


def _part(column: str, parts: int | Column) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(parts) if isinstance(parts, int) else parts).cast("long")


def _each(parts: int | Column) -> Column:
    return F.sequence(F.lit(0).cast("long"), (F.lit(parts) if isinstance(parts, int) else parts).cast("long") - 1)


def _merged(found: DataFrame, k: int, salts: int) -> DataFrame:
    """The k best (i, s) per q, in two steps, so no task sees the survivors of all cells at once."""
    order = [F.desc(F.round("s", SIM_DIGITS)), F.col("i")]
    for keys in (["q", F.pmod(F.xxhash64("i"), F.lit(salts))], ["q"]):
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        found = found.withColumn("__n", place).where(F.col("__n") <= k).drop("__n")
    return found


def _unpacked(table: pa.Table, dim: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and unit vectors, block by block."""
    for ids, vectors, wide in zip(*(table.column(c) for c in ("ids", "vectors", "wide"))):
        numbers = np.frombuffer(vectors.as_py(), np.float64 if wide.as_py() else np.float32).astype(np.float64).reshape(-1, dim)
        yield np.frombuffer(ids.as_py(), np.int64) if ids.is_valid else np.full(len(numbers), NO_ID), unit(numbers)


def _cell(left: pa.Table, right: pa.Table, dim: int, k: int) -> pa.Table:
    """k best items of every query of a cell. Items come block by block; once a query has k, only what reaches its k-th counts. Queries
    without an id share the null one."""
    best = (np.array([], np.int64), np.array([], np.int64), np.array([]))
    unnamed = np.zeros(0, bool)
    if left.num_rows and right.num_rows:
        ids, vectors = zip(*_unpacked(left, dim))
        asked, queries = np.concatenate(ids), np.concatenate(vectors)
        unnamed = np.repeat(left["ids"].is_null().to_numpy(), [len(x) for x in ids])
        floor = np.full(len(queries), -np.inf)
        waiting, held = [], 0
        for ids, units in _unpacked(right, dim):
            tile = max(1, TILE_CELLS // max(1, len(ids)))  # queries at a time
            for at in range(0, len(queries), tile):
                sims = queries[at:at + tile] @ units.T
                least = floor[at:at + tile]
                if len(ids) >= k and np.isneginf(least).any():
                    least = np.maximum(least, -np.partition(-sims, k - 1, axis=1)[:, k - 1])
                rows, cols = np.nonzero(sims >= least[:, None] - 10.0 ** -SIM_DIGITS)
                waiting.append((rows + at, ids[cols], sims[rows, cols]))
                held += len(rows)
                if held > max(1 << 20, 2 * k * len(queries)):
                    best = _best(*(np.concatenate(c) for c in zip(best, *waiting)), k)
                    waiting, held = [], 0
                    floor = _floor(best, len(queries), k)
        q, items, sims = _best(*(np.concatenate(c) for c in zip(best, *waiting)), k)
        best, unnamed = (asked[q], items, sims), unnamed[q]
    return pa.table([pa.array(best[0], pa.int64(), mask=unnamed), pa.array(best[1], pa.int64()), pa.array(best[2], pa.float64())], ["q", "i", "s"])


def _best(q: np.ndarray, ids: np.ndarray, sims: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """First k of every query by (similarity, id); the inputs are parallel arrays."""
    order = np.lexsort((ids, -np.round(sims, SIM_DIGITS), q))
    q, ids, sims = q[order], ids[order], sims[order]
    starts = np.flatnonzero(np.diff(q, prepend=-1))
    keep = np.arange(len(q)) - np.repeat(starts, np.diff(starts, append=len(q))) < k
    return q[keep], ids[keep], sims[keep]


def _floor(best: tuple[np.ndarray, ...], n: int, k: int) -> np.ndarray:
    """Similarity of the k-th of each query; minus infinity for those that have fewer."""
    q, _, sims = best
    floor = np.full(n, -np.inf)
    ends = np.flatnonzero(np.diff(q, append=n))
    full = np.bincount(q, minlength=n)[q[ends]] == k
    floor[q[ends[full]]] = sims[ends[full]]
    return floor


# ------------------------------------------------------------------ inverted lists
class ListIndex:
    """Every item under its nearest of some centroids. Centroids are fitted on a bounded sample; lists hold all rows.

    Kept as a folder: ``lists`` has the packed vectors with their list, ``centroids`` one row per list. A list of any size is
    many blocks, so one that holds a third of all items is searched by many tasks.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.lists = spark.read.parquet(f"{path}/lists")
        rows = spark.read.parquet(f"{path}/centroids").orderBy("list").toArrow()  # one row per list, a parameter
        self.dim, self.copies = len(rows["center"][0]), rows["copies"][0].as_py()
        self.centers = np.array(rows["center"].to_pylist(), np.float64)

    @classmethod
    def build(cls, items: DataFrame, n_lists: int, path: str | None = None, item_id: str = "id", item_vec: str = "embedding",
              sample: int = 50_000, seed: int = 1, copies: int = 1) -> ListIndex:
        """Fits ``n_lists`` centroids by k-means of unit vectors on the ``sample`` items with the smallest hashes, then writes all
        items under the most similar one, or under so many ``copies``, which finds more at the cost of space (an id is then found
        once, however often it is in the table). Rows without a vector are left out; vectors of different lengths are refused."""
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        spark = items.sparkSession
        path = path or scratch_folder(spark, "vector-lists")
        blocks = vector_blocks(items, item_id, item_vec)
        m, low, dim = _size(blocks)
        if not m or low != dim or not dim:
            raise ValueError(f"the vectors to index have {low} to {dim} numbers")
        learned = (items.where(F.col(item_vec).isNotNull()).select(item_id, F.col(item_vec).cast("array<double>").alias("v"))
                   .where(F.exists("v", lambda x: x != 0)).orderBy(F.xxhash64(F.lit(seed), item_id, "v")).limit(sample))
        learned = written(learned.select(array_to_vector("v").alias("features")), "vector-sample")
        kmeans = KMeans(k=n_lists, seed=seed, maxIter=15, initMode="random", distanceMeasure="cosine")
        centers = unit(np.array(kmeans.fit(learned).clusterCenters()))
        spark.createDataFrame([(k, c.tolist(), copies) for k, c in enumerate(centers)],
                              "list int, center array<double>, copies int").write.parquet(f"{path}/centroids")
        parts = blocks.mapInArrow(partial(_listed, centers=centers, probes=copies), f"list int, {_BLOCK}, wide boolean")
        parts = parts.repartition("list", _part("at", 64)).sortWithinPartitions("list")  # a list's parts, from 64 places at most
        parts.mapInArrow(_joined, f"list int, {_BLOCK}, wide boolean").write.parquet(f"{path}/lists")
        return cls(spark, path)

    def top_k(self, queries: DataFrame, k: int, probes: int, query_id: str = "query_id", item_id: str = "id", query_vec: str = "vec",
              cell_bytes: int = CELL_BYTES, max_kept: int = MAX_KEPT, salts: int = 32) -> DataFrame:
        """(query_id, item_id, vec_score) of the k most similar items in the ``probes`` lists whose centroids are nearest to each
        query: exact if these are all lists. Similarities are exact, what another list holds is missed."""
        schema = f"{query_id} long, {item_id} long, vec_score double"
        asked = vector_blocks(queries, query_id, query_vec, "query-vectors")
        n, low, dim = _size(asked)
        if not n:
            return self.spark.createDataFrame([], schema)
        if (low, dim) != (self.dim, self.dim):
            raise ValueError(f"query vectors have {low} to {dim} numbers, not {self.dim}")
        pairs = asked.mapInArrow(partial(_listed, centers=self.centers, probes=probes), f"list int, {_BLOCK}, wide boolean")
        pairs = written(pairs, "query-lists")
        # One row per list: how many parts its queries and its items are dealt to.
        count = lambda df, name: df.groupBy("list").agg(F.sum("n").alias(name))
        sizes = count(self.lists, "m").join(count(pairs, "n_asked"), "list").select(
            "list", F.ceil(F.col("m") * dim * 8 / cell_bytes).alias("down"),
            F.ceil(F.greatest(F.col("n_asked") * dim * 8 / cell_bytes, F.col("n_asked") * k / max_kept)).alias("across"))
        sizes = F.broadcast(sizes)  # at most one row per list, a parameter
        left = pairs.join(sizes, "list").select("list", _part("at", F.col("across")).alias("q"),
                                                F.explode(_each(F.col("down"))).alias("i"), "ids", "vectors", "wide")
        right = self.lists.join(sizes, "list").select("list", F.explode(_each(F.col("across"))).alias("q"),
                                                      _part("at", F.col("down")).alias("i"), "ids", "vectors", "wide")
        keys = ["list", "q", "i"]
        found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(
            partial(_cell, dim=dim, k=k), "q long, i long, s double")
        if self.copies > 1:
            found = found.groupBy("q", "i").agg(F.max("s").alias("s"))
        return _merged(found, k, salts).select(F.col("q").alias(query_id), F.col("i").alias(item_id), F.col("s").alias("vec_score"))


def _listed(batches: Iterator[pa.RecordBatch], centers: np.ndarray, probes: int = 1) -> Iterator[pa.RecordBatch]:
    """Blocks split by the lists of the nearest centroids."""
    dim, probes = centers.shape[1], min(probes, len(centers))
    for batch in batches:
        for k, (ids, units) in enumerate(_unpacked(pa.table(batch), dim)):
            sims = units @ centers.T
            near = np.argsort(-sims, axis=1, kind="stable")[:, :probes]
            wide = batch.column("wide")[k].as_py()
            raw = np.frombuffer(batch.column("vectors")[k].as_py(), np.float64 if wide else np.float32).reshape(-1, dim)
            lists, rows = near.ravel(), np.repeat(np.arange(len(ids)), probes)
            order = np.argsort(lists, kind="stable")
            cuts = np.flatnonzero(np.diff(lists[order])) + 1
            parts = [p for p in np.split(order, cuts) if len(p)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(lists[p[0]]) for p in parts], pa.int32()), pa.array([batch.column("at")[k].as_py()] * len(parts), pa.int64()),
                 pa.array([len(p) for p in parts], pa.int32()), pa.array([dim] * len(parts), pa.int32()),
                 pa.array([ids[rows[p]].tobytes() for p in parts], pa.binary()),
                 pa.array([raw[rows[p]].tobytes() for p in parts], pa.binary()), pa.array([wide] * len(parts))],
                names=["list", "at", "n", "dim", "ids", "vectors", "wide"])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of one list that follow each other, joined to blocks of about a megabyte."""
    place, count, held, size = TaskContext.get().partitionId() << 32, 0, [], 0
    for row in (r for batch in batches for r in batch.to_pylist()):
        if held and (row["list"] != held[0]["list"] or size >= BLOCK_BYTES):
            yield _one(held, place + count)
            count, held, size = count + 1, [], 0
        held.append(row)
        size += len(row["vectors"])
    if held:
        yield _one(held, place + count)


def _one(parts: list[dict], at: int) -> pa.RecordBatch:
    row = parts[0] | {"at": at, "n": sum(p["n"] for p in parts), **{c: b"".join(p[c] for p in parts) for c in ("ids", "vectors")}}
    kinds = {"list": pa.int32(), "at": pa.int64(), "n": pa.int32(), "dim": pa.int32(), "ids": pa.binary(), "vectors": pa.binary(),
             "wide": pa.bool_()}
    return pa.RecordBatch.from_arrays([pa.array([row[c]], t) for c, t in kinds.items()], names=list(kinds))
