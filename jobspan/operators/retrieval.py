"""Finding and ordering postings: vector top-k, title aliases, source mix, pages."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobspan import vocab
from jobspan.functions.names import ilike_any
from jobspan.functions.scores import instant
from jobspan.functions.vectors import SIM_DIGITS
from jobspan.operators.vector_search import batch_top_k  # noqa: F401
from jobspan.session import scratch_folder


def search_predicates(location: str | None = None, max_hours_old: int | None = None, sources: list[str] = (),
                      now=None) -> Column:
    """Only the tests that are asked for; a missing, empty or zero parameter adds none."""
    test = F.col("embedding").isNotNull()
    if location:
        test = test & ilike_any(F.col("location"), [location])
    if max_hours_old:
        since = instant(now) - F.make_dt_interval(F.lit(0), F.lit(max_hours_old))
        test = test & (F.col("posted_date").cast("timestamp") >= since)
    if sources:
        test = test & F.col("source").isin(list(sources))
    return test


def top_k(df: DataFrame, score: str, k: int, row_id: str = "id") -> DataFrame:
    """Best k rows; each task keeps its own k before anything moves."""
    return df.orderBy(F.desc(F.round(score, SIM_DIGITS)), row_id).limit(k)


def with_aliases(candidates: DataFrame, scored: DataFrame, aliases: list[str], limit: int = vocab.ALIAS_LIMIT
                 ) -> DataFrame:
    """Candidates followed by rows whose title has one of the aliases (first ``limit`` by id), each id once.

    Adds ``origin``: 0 for candidates, 1 for aliases. Both sides are limited, so the merge handles a few hundred rows.
    """
    base = candidates.withColumn("origin", F.lit(0))
    if not aliases:
        return base
    extra = scored.where(ilike_any(F.col("title"), aliases)).orderBy("id").limit(limit)
    both = base.unionByName(extra.withColumn("origin", F.lit(1)))
    seen = Window.partitionBy("id").orderBy("origin")
    return both.withColumn("__n", F.row_number().over(seen)).where("__n = 1").drop("__n")


def source_caps(n: int, shares: dict[str, float] = vocab.SOURCE_SHARES) -> dict[str, int]:
    return {source: max(1, round(n * share)) for source, share in shares.items()}


def diversify(df: DataFrame, n: int, order: list[Column], per: list[str] = (),
              shares: dict[str, float] = vocab.SOURCE_SHARES) -> DataFrame:
    """Up to a share of n rows per source in the given order, the rest filled with what overflowed, in that order.

    Adds ``pool_rank``. ``per`` names the query columns when many searches are ranked at once. No source can put more
    than n rows into the pool, so each task first drops what lies beyond its n best per source.
    """
    src = F.lower(F.coalesce("source", F.lit("other")))
    cap = F.lit(n)
    for source, most in source_caps(n, shares).items():
        cap = F.when(src == source, most).otherwise(cap)
    place = F.row_number().over(Window.partitionBy(*per, src).orderBy(*order))
    top = df.withColumn("__place", place).where(F.col("__place") <= n).withColumn("__over", F.col("__place") > cap)
    pool = Window.partitionBy(*per).orderBy("__over", *order)
    out = top.withColumn("pool_rank", F.row_number().over(pool)).where(F.col("pool_rank") <= n)
    return out.drop("__over", "__place")


def page(pool: DataFrame, number: int, size: int, order: list[Column], per: list[str] = ()) -> DataFrame:
    """One page of a pool in the given order, with ``rank`` and the pool's ``total``."""
    w = Window.partitionBy(*per)
    return (
        pool.withColumn("rank", F.row_number().over(w.orderBy(*order)))
        .withColumn("total", F.count("*").over(w))
        .where((F.col("rank") > (number - 1) * size) & (F.col("rank") <= number * size))
    )


def page_count(total: Column, size: int = 20, most: int = 5) -> Column:
    return F.least(F.ceil(total / size), F.lit(most))


def sort_results(df: DataFrame, by: str = "match") -> DataFrame:
    """Best match first, or most recent first with undated postings last."""
    if by == "recent":
        return df.orderBy(F.asc_nulls_last("hours_since_posted"), "rank")
    return df.orderBy(F.desc("vec_score"), "rank")


def placed(df: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """Adds each row's gapless place (from 1) in a total order, over all rows: a range-partitioned sort, so no task sees more than
    its range; one row per partition is gathered to add the ranges up."""
    path = scratch_folder(df.sparkSession, "placed")
    df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()).write.parquet(path)
    at = df.sparkSession.read.parquet(path).withColumn("__part", F.shiftright("__at", 33))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = at.groupBy("__part").agg(F.count("*").alias("__n")).select(
        "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    place = F.col("__start") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return at.join(F.broadcast(starts), "__part").withColumn(name, place).drop("__part", "__start", "__at")


def rerank(candidates: DataFrame, ranking: DataFrame, n: int, prior: str = "rank", per: list[str] = ()) -> DataFrame:
    """Candidates in the order of a ranked id list, then those it leaves out in prior order; top n per query.

    ``ranking`` has the query columns and ``ids``; an id listed twice counts once, and a missing or unusable list leaves
    the prior order.
    """
    listed = ranking.select(*per, F.posexplode("ids").alias("pos", "id"))
    listed = listed.groupBy(*per, "id").agg(F.min("pos").alias("__pos"))
    both = candidates.join(listed, [*per, "id"], "left")
    w = Window.partitionBy(*per).orderBy(F.asc_nulls_last("__pos"), prior)
    return both.withColumn("new_rank", F.row_number().over(w)).where(F.col("new_rank") <= n).drop("__pos")
