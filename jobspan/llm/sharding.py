"""Shards of nearly equal bytes: longest-processing-time scheduling of groups that must stay together.

Groups, largest first, go to the least loaded shard, which a heap gives. Groups of one size are interchangeable, so the plan
needs only how many groups there are of each size: a run of equal groups is dealt to all shards at once, up to the level that
the heap would reach. The histogram of sizes that the driver sees has at most sqrt(2 * total bytes) rows, since sizes that
differ add up; no group, id or text passes through it.
"""
from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobspan.llm.common import numbered, stored


def plan(histogram: list[tuple[int, int]], shards: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """For each (size, number of groups), largest size first: how many of them each shard gets, as (shard, number).

    Equal to taking the groups one by one: the least loaded shard, on ties the smallest number, gets the next.
    """
    heap = [(0, k) for k in range(shards)]
    out = []
    for size, n in sorted(histogram, reverse=True):
        got: dict[int, int] = {}
        if n > 4 * shards:
            loads = dict((k, load) for load, k in heap)
            # The largest level that needs no more than n groups when each shard takes groups while it is below the level.
            low, high = min(loads.values()), max(loads.values()) + (n + 1) * size
            need = lambda level: sum(max(0, -(-(level - x) // size)) for x in loads.values())
            while high - low > 1:
                mid = (low + high) // 2
                low, high = (mid, high) if need(mid) <= n else (low, mid)
            got = {k: -(-(low - x) // size) for k, x in loads.items() if x < low}
            n -= sum(got.values())
            heap = [(x + got.get(k, 0) * size, k) for k, x in loads.items()]
            heapq.heapify(heap)
        for _ in range(n):
            load, k = heap[0]
            heapq.heapreplace(heap, (load + size, k))
            got[k] = got.get(k, 0) + 1
        out.append((size, sorted(got.items())))
    return out


def shard(docs: DataFrame, shards: int = 40, overhead: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size (UTF-8 bytes and ``overhead``), text_crc32, law ``bytes``, shard, slot (gapless in the shard, in the order
    of ids), grown_shard (null: the law isn't ``key``).

    Documents of equal text are a group and share a shard. A null text is empty. Repeated rows are rows of their own; a null
    id is ordered first. Fewer groups than shards leave shards empty, and no rows give no rows. Other columns are not read.

    A group that holds a third of all rows is one row of the plan; its rows meet again in a join that splits skewed keys.
    """
    if shards < 1 or overhead < 1:
        raise ValueError("shards and overhead are positive")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = stored(docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2")), "shard-rows")
    groups = rows.groupBy("h1", "h2").agg(F.sum("size").alias("group_size"))
    order = numbered(groups.withColumn("down", -F.col("group_size")), ["down", "h1", "h2"], "place", "shard-groups")
    order = order.drop("down")
    histogram = order.groupBy("group_size").agg(F.count("*").alias("n")).collect()  # at most sqrt(2 * bytes) rows
    dealt = plan([(r.group_size, r.n) for r in histogram], shards)
    spark, table, first = docs.sparkSession, [], 0
    for size, got in dealt:
        ends, at = [], 0
        for _, n in got:
            at += n
            ends.append(at)
        table.append((size, first, ends, [k for k, _ in got]))
        first += at
    classes = spark.createDataFrame(table, "group_size long, first long, ends array<long>, shards array<int>")
    classes = stored(classes, "shard-classes")
    within = F.col("place") - F.col("first")
    taken = F.size(F.filter("ends", lambda e: e <= within))
    placed = order.join(classes, "group_size").select("h1", "h2", F.get("shards", taken).alias("shard"))
    sharded = rows.join(placed, ["h1", "h2"]).drop("h1", "h2")
    sharded = numbered(sharded, ["shard", "doc_id", "text_crc32", "size"], "place", "shard-slots")
    # One row per shard.
    starts = sharded.groupBy("shard").agg(F.min("place").alias("start"))
    return sharded.join(F.broadcast(starts), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("place") - F.col("start")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))
